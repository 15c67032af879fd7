"""Which levels of several fixed effects are redundant.

Dummies of two FEs are linearly dependent once for every connected component of
the graph whose nodes are the levels of both and whose edges are their cells.
So the second of two FEs adds its levels less the components; a further FE adds
its levels less the largest number of components it forms with one before it.
An FE whose levels each lie within one cluster does not count at all.

All this is read off the data, so it is the same whether an FE is written as a
tuple of columns or as a ready id column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpanel.session import cut_lineage


def components(edges: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """(a columns..., component) of the bipartite graph of the distinct (a, b) combinations; the component is its least a.

    Every a-level holds a parent, at first itself.  In each round it takes the least parent among the a-levels that share a
    b-level with it, hands that to its old parent too, and then jumps to its parent's parent, so that long chains fold up
    in about log(n) rounds.  Each round is checkpointed.
    """
    e = cut_lineage(edges.select(F.struct(*a).alias("a"), F.struct(*b).alias("b")).distinct())
    p = cut_lineage(e.select("a").distinct().withColumn("p", F.col("a")))
    while True:
        low = e.join(p, "a").groupBy("b").agg(F.min("p").alias("m"))
        near = e.join(low, "b").groupBy("a").agg(F.min("m").alias("m"))
        seen = p.join(near, "a")
        hook = seen.groupBy(F.col("p").alias("a")).agg(F.min("m").alias("h"))
        told = cut_lineage(seen.join(hook, "a", "left").select("a", F.col("p").alias("old"), F.least("p", "m", F.coalesce("h", "m")).alias("p")))
        jump = told.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        new = cut_lineage(told.join(jump, "p").select("a", "old", F.col("pp").alias("p")))
        p = new.select("a", "p")
        if not new.filter("old <> p").limit(1).count():
            return p.select("a.*", F.col("p").alias("component"))


def level_counts(cells: DataFrame, fes: list[list[str]], cluster: list[str], group: str) -> dict:
    """Per group: levels of every FE, levels with the cluster, and cells of every pair of FEs that may both count."""
    inside = [bool(cluster) and set(cluster) <= set(f) for f in fes]
    count = lambda cols: F.count_distinct(*[F.col(c) for c in dict.fromkeys(cols)])
    aggs: list[Column] = [count(f).alias(f"l{i}") for i, f in enumerate(fes)]
    aggs += [count([*f, *cluster]).alias(f"c{i}") for i, f in enumerate(fes) if cluster and not inside[i]]
    open_ = [i for i in range(len(fes)) if not inside[i]]
    aggs += [count([*fes[i], *fes[j]]).alias(f"p{i}_{j}") for i in open_ for j in open_ if i < j]
    return {r[group]: r.asDict() | {f"c{i}": r[f"l{i}"] for i in range(len(fes)) if inside[i]} for r in cells.groupBy(group).agg(*aggs).collect()}


def nested(counts: dict, i: int) -> bool:
    """Whether every level of the FE lies within one cluster."""
    return counts.get(f"c{i}") == counts[f"l{i}"]


def spanned(counts: dict, n: int) -> set[int]:
    """FEs that a finer one explains in every group: each level of the finer one lies within one of theirs (equal ones: the first stays)."""
    pair = lambda r, i, j: r.get(f"p{min(i, j)}_{max(i, j)}")
    finer = lambda i, j: all(pair(r, i, j) == r[f"l{j}"] for r in counts.values())
    out: set[int] = set()
    for i in range(n):
        if any(finer(i, j) and not (finer(j, i) and i < j) for j in range(n) if j != i):
            out.add(i)
    return out


def absorbed(cells: DataFrame, fes: list[list[str]], counts: dict, group: str) -> dict:
    """Per group: the degrees of freedom that the FEs take, those nested in the cluster left out."""
    out = {}
    found: dict[tuple[int, int], dict] = {}

    def connected(g, r: dict, i: int, j: int) -> int:
        a, b, both = r[f"l{i}"], r[f"l{j}"], r[f"p{i}_{j}"]
        if both in (a, b, a * b):                   # one refines the other, or all levels meet
            return b if both == a else a if both == b else 1
        if (i, j) not in found:
            few, many = sorted((i, j), key=lambda k: sum(x[f"l{k}"] for x in counts.values()))
            own = [*dict.fromkeys([group, *fes[few]])]
            part = components(cells.select(*dict.fromkeys([*own, *fes[many]])), own, [*dict.fromkeys([group, *fes[many]])])
            found[i, j] = {x[group]: x["n"] for x in part.groupBy(group).agg(F.count_distinct("component").alias("n")).collect()}
        return found[i, j][g]

    for g, r in counts.items():
        free = [i for i in range(len(fes)) if not nested(r, i)]
        redundant = [max((connected(g, r, i, j) for i in free if i < j), default=0) for j in free]
        out[g] = sum(r[f"l{i}"] for i in free) - sum(redundant)
    return out
