"""DuckDB twins of the fixed-effects regressions, written out as SQL text.

The SQL shares nothing with the engine's method: singletons are pruned in
unrolled rounds, the fixed effects are removed by unrolled alternating
demeaning (sweeps of window averages until the change is far below the compared
digits), the normal equations are solved by Gauss-Jordan elimination over named
columns, and the cluster scores are summed per cluster.
"""

from __future__ import annotations

PRUNE_ROUNDS, SWEEPS = 4, 24
#: Expansion of the t quantile around the normal one, for the 95 % interval (error below 1e-9 from 60 degrees of freedom on).
_Z = 1.959963984540054


def t_quantile(df: str, z: float = _Z) -> str:
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    return f"({z!r} + {g1!r} / ({df}) + {g2!r} / power({df}, 2) + {g3!r} / power({df}, 3) + {g4!r} / power({df}, 4))"


def _cols(fe) -> list[str]:
    return [fe] if isinstance(fe, str) else list(fe)


def pruned(name: str, source: str, fes, rounds: int = PRUNE_ROUNDS) -> list[str]:
    """CTEs that end in ``name``: ``source`` without singletons."""
    out, last = [], source
    for k in range(rounds):
        here = name if k == rounds - 1 else f"{name}_p{k}"
        keep = " AND ".join(f"count(*) OVER (PARTITION BY {', '.join(_cols(f))}) > 1" for f in fes)
        out.append(f"{here} AS MATERIALIZED (SELECT * FROM {last} QUALIFY {keep})")
        last = here
    return out


def demeaned(name: str, source: str, cols: list[str], fes, sweeps: int = SWEEPS) -> list[str]:
    """CTEs that end in ``name``: ``source`` with ``cols`` residualised on the fixed effects."""
    out, last = [], source
    for k in range(sweeps):
        for j, f in enumerate(fes):
            final = k == sweeps - 1 and j == len(fes) - 1
            here = name if final else f"{name}_d{k}_{j}"
            by = ", ".join(_cols(f))
            out.append(f"{here} AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}' for c in cols)}) FROM {last})")
            last = here
    return out


def inverse(name: str, source: str, a: str, n: int) -> list[str]:
    """CTEs that end in ``name`` (one row): columns i{r}_{c}, the inverse of the columns {a}{r}_{c} of one-row ``source``."""
    row = [f"{a}{min(r, c)}_{max(r, c)}::DOUBLE AS m{r}_{c}" for r in range(n) for c in range(n)]
    row += [f"{float(r == c)}::DOUBLE AS m{r}_{n + c}" for r in range(n) for c in range(n)]
    out, last = [f"{name}_e AS MATERIALIZED (SELECT {', '.join(row)} FROM {source})"], f"{name}_e"
    for p in range(n):
        here = f"{name}_e{p}"
        cells = [f"m{p}_{c} / m{p}_{p} AS m{p}_{c}" if r == p else f"m{r}_{c} - m{r}_{p} * m{p}_{c} / m{p}_{p} AS m{r}_{c}"
                 for r in range(n) for c in range(2 * n)]
        out.append(f"{here} AS MATERIALIZED (SELECT {', '.join(cells)} FROM {last})")
        last = here
    out.append(f"{name} AS MATERIALIZED (SELECT {', '.join(f'm{r}_{n + c} AS i{r}_{c}' for r in range(n) for c in range(n))} FROM {last})")
    return out


def _sum(terms) -> str:
    return " + ".join(terms) or "0"


def regression(name: str, source: str, y: str, exog, endog=(), instruments=(), fes=(), cluster="cust", model: str | None = None,
               omitted=(), levels=None, prune: bool = True, carry=(), sweeps: int = SWEEPS, redundant: str = "0", graph=()) -> list[str]:
    """CTEs that end in ``{name}``: a row per term with estimate, standard error, t, the
    95 % interval, N, G, K, both R-squared; and ``{name}_fit``, one row with all of them.

    ``levels``: the FEs whose levels count for K (those not nested in the cluster).
    ``omitted``: terms that the engine has to leave out; they come last here.
    ``redundant``: scalar over the sample, the levels among them that do not count; ``graph``: CTEs over ``{name}_k`` that it needs.
    """
    x = [*endog, *exog]
    w = [*exog, *instruments] if endog else list(exog)
    cols = list(dict.fromkeys([y, *x, *w]))
    n, m = len(x), len(w)
    keys = list(dict.fromkeys([c for f in fes for c in _cols(f)] + [cluster, *carry]))
    levels = [f for f in fes if cluster not in _cols(f)] if levels is None else levels
    out = [f"{name}_s AS MATERIALIZED (SELECT {', '.join(keys)}, {', '.join(f'{c}::DOUBLE AS {c}' for c in cols)} FROM {source} "
           f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in keys + cols)})"]
    out += pruned(f"{name}_k", f"{name}_s", fes) if prune else [f"{name}_k AS MATERIALIZED (SELECT * FROM {name}_s)"]
    out += graph
    out += demeaned(f"{name}_r", f"{name}_k", cols, fes, sweeps)
    prod = lambda a, b: f"sum({a} * {b})"
    out.append(f"{name}_m AS MATERIALIZED (SELECT " + ", ".join(
        [f"{prod(w[a], w[b])} AS ww{a}_{b}" for a in range(m) for b in range(a, m)] + [f"{prod(w[a], x[b])} AS wx{a}_{b}" for a in range(m) for b in range(n)]
        + [f"{prod(w[a], y)} AS wy{a}" for a in range(m)] + [f"{prod(y, y)} AS yy"]) + f" FROM {name}_r)")
    out += inverse(f"{name}_wi", f"{name}_m", "ww", m)
    out.append(f"{name}_pi AS MATERIALIZED (SELECT " + ", ".join(f"{_sum(f'i{a}_{c} * wx{c}_{b}' for c in range(m))} AS pi{a}_{b}" for a in range(m) for b in range(n))
               + f" FROM {name}_wi, {name}_m)")
    out.append(f"{name}_xx AS MATERIALIZED (SELECT " + ", ".join(
        [f"{_sum(f'wx{c}_{a} * pi{c}_{b}' for c in range(m))} AS xx{a}_{b}" for a in range(n) for b in range(a, n)]
        + [f"{_sum(f'pi{c}_{a} * wy{c}' for c in range(m))} AS xy{a}" for a in range(n)]) + f" FROM {name}_pi, {name}_m)")
    out += inverse(f"{name}_xi", f"{name}_xx", "xx", n)
    out.append(f"{name}_b AS MATERIALIZED (SELECT " + ", ".join(f"{_sum(f'i{a}_{c} * xy{c}' for c in range(n))} AS b{a}" for a in range(n)) + f" FROM {name}_xi, {name}_xx)")
    u = f"({y} - ({_sum(f'b{a} * {x[a]}' for a in range(n))}))"
    hat = [f"({_sum(f'pi{c}_{a} * {w[c]}' for c in range(m))})" for a in range(n)]
    out.append(f"{name}_u AS MATERIALIZED (SELECT r.*, {u} AS resid, {', '.join(f'{hat[a]} * {u} AS sc{a}' for a in range(n))} FROM {name}_r r, {name}_b, {name}_pi)")
    out.append(f"{name}_c AS MATERIALIZED (SELECT {', '.join(f'sum(sc{a}) AS s{a}' for a in range(n))} FROM {name}_u GROUP BY {cluster})")
    out.append(f"{name}_v AS MATERIALIZED (SELECT count(*) AS g, " + ", ".join(f"sum(s{a} * s{b}) AS t{a}_{b}" for a in range(n) for b in range(n)) + f" FROM {name}_c)")
    lv = _sum([f"count(DISTINCT ({', '.join(_cols(f))}))" for f in levels])
    out.append(f"{name}_n AS MATERIALIZED (SELECT count(*) AS n, {n} + {lv} - {redundant} AS k, var_pop({y}) * count(*) AS tss, avg({y}) AS ymean, stddev_samp({y}) AS ysd FROM {name}_k)")
    out.append(f"{name}_q AS MATERIALIZED (SELECT sum(resid * resid) AS rss FROM {name}_u)")
    var = lambda a, b: _sum(f"i{a}_{c} * t{c}_{d} * i{d}_{b}" for c in range(n) for d in range(n))
    fit = [f"b{a} AS b{a}" for a in range(n)]
    fit += [f"(g::DOUBLE / (g - 1)) * ((n - 1)::DOUBLE / (n - k)) * ({var(a, b)}) AS v{a}_{b}" for a in range(n) for b in range(a, n)]
    fit += ["n", "g", "k", "rss", "yy", "tss", "ymean", "ysd", "1 - rss / yy AS r2_within", "1 - rss / tss AS r2"]
    out.append(f"{name}_fit AS MATERIALIZED (SELECT {', '.join(fit)} FROM {name}_b, {name}_xi, {name}_v, {name}_n, {name}_q, {name}_m)")
    crit = t_quantile("g - 1")
    rows = [f"SELECT '{model or name}' AS model, {a + 1} AS position, '{x[a]}' AS term, b{a} AS estimate, sqrt(v{a}_{a}) AS std_error, b{a} / sqrt(v{a}_{a}) AS t, "
            f"b{a} - {crit} * sqrt(v{a}_{a}) AS ci_lo, b{a} + {crit} * sqrt(v{a}_{a}) AS ci_hi, false AS omitted, n, g FROM {name}_fit" for a in range(n)]
    rows += [f"SELECT '{model or name}', {n + 1 + i}, '{t}', NULL, NULL, NULL, NULL, NULL, true, n, g FROM {name}_fit" for i, t in enumerate(omitted)]
    out.append(f"{name} AS (" + " UNION ALL ".join(rows) + ")")
    return out


def level_graph(name: str, source: str, a: str, b: str, rounds: int = 10) -> tuple[list[str], str]:
    """CTEs that spread the least label over the graph of the levels of a and b in unrolled rounds, and the number of components."""
    out, last = [f"{name}_0 AS MATERIALIZED (SELECT DISTINCT {a} AS a, {b} AS b, {a} AS lab FROM {source})"], f"{name}_0"
    for k in range(1, rounds + 1):
        here = f"{name}_{k}"
        out.append(f"{here} AS MATERIALIZED (SELECT a, b, min(m) OVER (PARTITION BY a) AS lab FROM (SELECT a, b, min(lab) OVER (PARTITION BY b) AS m FROM {last}))")
        last = here
    return out, f"(SELECT count(DISTINCT lab) FROM {last})"


def weak_identification(name: str, source: str, exog, endog, instruments, fes, cluster="cust", squarings: int = 14) -> list[str]:
    """CTE ``{name}_w``: robust_F and cragg_donald_F of as many instruments as endogenous terms.

    With x the combination of endogenous terms that the instruments explain least (found by powers of a matrix), the robust
    statistic is that of the covariance between the explained and the unexplained part of x.
    """
    n, m = len(endog), len(exog)
    cols = [*endog, *instruments, *exog]
    keys = list(dict.fromkeys([c for f in fes for c in _cols(f)] + [cluster]))
    levels = [f for f in fes if cluster not in _cols(f)]
    out = [f"{name}_s AS MATERIALIZED (SELECT {', '.join(keys)}, {', '.join(f'{c}::DOUBLE AS {c}' for c in cols)} FROM {source} "
           f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in keys + cols)})"]
    out += pruned(f"{name}_k", f"{name}_s", fes) + demeaned(f"{name}_d", f"{name}_k", cols, fes)
    last = f"{name}_d"
    for k, e in enumerate(exog):            # one exogenous term after the other is taken out of all columns after it
        rest = [c for c in cols if c not in exog[:k + 1]]
        here = f"{name}_o{k}"
        out.append(f"{here} AS MATERIALIZED (SELECT {cluster}, {', '.join(f'd.{c} - d.{e} * b_{c} AS {c}' for c in rest)} FROM {last} d, "
                   f"(SELECT {', '.join(f'sum({c} * {e}) / sum({e} * {e}) AS b_{c}' for c in rest)} FROM {last}))")
        last = here
    prod = lambda p, q: f"sum({p} * {q})"
    out.append(f"{name}_m AS MATERIALIZED (SELECT " + ", ".join(
        [f"{prod(instruments[a], instruments[b])} AS zz{a}_{b}, {prod(endog[a], endog[b])} AS yy{a}_{b}" for a in range(n) for b in range(a, n)]
        + [f"{prod(instruments[a], endog[b])} AS zy{a}_{b}" for a in range(n) for b in range(n)]) + f" FROM {last})")
    out += inverse(f"{name}_zi", f"{name}_m", "zz", n)
    out.append(f"{name}_pi AS MATERIALIZED (SELECT " + ", ".join(f"{_sum(f'i{a}_{c} * zy{c}_{b}' for c in range(n))} AS pi{a}_{b}" for a in range(n) for b in range(n)) + f" FROM {name}_zi, {name}_m)")
    out.append(f"{name}_ff AS MATERIALIZED (SELECT " + ", ".join(f"{_sum(f'zy{c}_{a} * pi{c}_{b}' for c in range(n))} AS ff{a}_{b}" for a in range(n) for b in range(a, n)) + f" FROM {name}_pi, {name}_m)")
    out += inverse(f"{name}_fi", f"{name}_ff", "ff", n)
    yy = lambda a, b: f"yy{min(a, b)}_{max(a, b)}"
    out.append(f"{name}_p0 AS MATERIALIZED (SELECT " + ", ".join(f"{_sum(f'i{a}_{c} * {yy(c, b)}' for c in range(n))} AS q{a}_{b}" for a in range(n) for b in range(n)) + f" FROM {name}_fi, {name}_m)")
    trace = _sum(f"q{a}_{a}" for a in range(n))
    for k in range(1, squarings + 1):       # towards the eigenvector of the largest eigenvalue, scaled by the trace
        out.append(f"{name}_p{k} AS MATERIALIZED (SELECT " + ", ".join(f"({_sum(f'q{a}_{c} * q{c}_{b}' for c in range(n))}) / pow({trace}, 2) AS q{a}_{b}" for a in range(n) for b in range(n))
                   + f" FROM {name}_p{k - 1})")
    x = [f"q{a}_0" for a in range(n)]
    ff = lambda a, b: f"ff{min(a, b)}_{max(a, b)}"
    form = lambda cell: _sum(f"{x[a]} * {x[b]} * {cell(a, b)}" for a in range(n) for b in range(n))
    hat = _sum(f"{x[a]} * ({_sum(f'pi{c}_{a} * {instruments[c]}' for c in range(n))})" for a in range(n))
    out.append(f"{name}_h AS MATERIALIZED (SELECT {cluster}, {hat} AS h, {_sum(f'{x[a]} * {endog[a]}' for a in range(n))} AS y FROM {last}, {name}_pi, {name}_p{squarings})")
    out.append(f"{name}_c AS MATERIALIZED (SELECT sum(h * (y - h)) AS s FROM {name}_h GROUP BY {cluster})")
    lv = _sum([f"count(DISTINCT ({', '.join(_cols(f))}))" for f in levels])
    all_ = _sum([f"count(DISTINCT ({', '.join(_cols(f))}))" for f in fes])
    out.append(f"{name}_n AS MATERIALIZED (SELECT count(*) AS n, {n + m} + {lv} AS k, {n + m} + {all_} AS ka FROM {name}_k)")
    out.append(f"{name}_w AS (SELECT pow(f, 2) / (meat * (g::DOUBLE / (g - 1)) * ((n - 1)::DOUBLE / (n - k))) / {n} AS robust_F, (n - ka) * (f / t) / (1 - f / t) / {n} AS cragg_donald_F "
               f"FROM (SELECT {form(ff)} AS f, {form(yy)} AS t FROM {name}_ff, {name}_m, {name}_p{squarings}), (SELECT sum(s * s) AS meat, count(*) AS g FROM {name}_c), {name}_n)")
    return out


def wald(name: str, terms: list[int]) -> list[str]:
    """CTE ``{name}_f``: F of the terms (by place) of a regression."""
    n = len(terms)
    src = f"{name}_wv AS MATERIALIZED (SELECT " + ", ".join(f"v{min(terms[a], terms[b])}_{max(terms[a], terms[b])} AS wv{a}_{b}" for a in range(n) for b in range(a, n)) + f" FROM {name}_fit)"
    f = _sum(f"b{terms[a]} * i{a}_{b} * b{terms[b]}" for a in range(n) for b in range(n))
    return [src, *inverse(f"{name}_wvi", f"{name}_wv", "wv", n), f"{name}_f AS (SELECT ({f}) / {n} AS f FROM {name}_fit, {name}_wvi)"]


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def coef_select(names: list[str], more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT model, position::INTEGER AS position, term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(t, 4) AS t, "
                              f"round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, omitted{more} FROM {n}" for n in names)
