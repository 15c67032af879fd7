"""Multi-label topic model on Spark ML.

Re-aimed from a fine-tuned transformer to a distributed pipeline: a regex word
tokenizer, feature hashing and IDF fitted once, then one binary logistic
regression per topic (binary relevance - ``OneVsRest`` is multi-class, not
multi-label).  Validation-based selection walks an ordered grid of
regularisation strengths and stops after ``patience`` steps without a lower
hold-out log loss.  Scoring is a stateless ``transform`` and therefore also
works on a streaming DataFrame.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.functions import numeric as N
from sparkpanel.sources import store


#: Regularisation strengths from strong to weak; longer than the default patience.
REG_GRID = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001)


@dataclass
class TopicModel:
    featurizer: PipelineModel
    models: list          # one LogisticRegressionModel (or a constant) per topic
    topics: list[str]
    text_col: str
    chosen: dict
    steps: dict = field(default_factory=dict)

    def score(self, df: DataFrame, threshold: float = 0.5, keep=None) -> DataFrame:
        """M5: probabilities[n_topics] and predicted_label[n_topics] for every row."""
        keep = keep or [c for c in df.columns]
        feats = self.featurizer.transform(df)
        probs = []
        for i, (t, m) in enumerate(zip(self.topics, self.models)):
            if isinstance(m, float):
                probs.append(F.lit(m))
                continue
            m = m.copy({m.probabilityCol: f"__prob{i}", m.rawPredictionCol: f"__raw{i}",
                        m.predictionCol: f"__pred{i}"})
            feats = m.transform(feats).drop(f"__raw{i}", f"__pred{i}")
            probs.append(vector_to_array(F.col(f"__prob{i}"))[1])
        arr = F.array(*probs)
        return feats.select(*keep, arr.alias("probabilities"), N.binarize(arr, threshold).alias("predicted_label"))

    def save(self, path: str) -> None:
        """Featurizer and one model per topic, published in one step; the former model stays until then."""
        def write(folder: str) -> dict:
            self.featurizer.write().save(f"{folder}/featurizer")
            consts = {}
            for i, m in enumerate(self.models):
                if isinstance(m, float):
                    consts[str(i)] = m
                else:
                    m.write().save(f"{folder}/topic_{i}")
            return {"topics": self.topics, "text_col": self.text_col, "constants": consts, "chosen": self.chosen}

        store.publish(SparkSession.getActiveSession(), path, write)

    @staticmethod
    def load(path: str) -> "TopicModel":
        found = store.current(SparkSession.getActiveSession(), path)
        if not found:
            raise FileNotFoundError(f"no model in {path}")
        folder, manifest = found
        models = [float(manifest["constants"][str(i)]) if str(i) in manifest["constants"] else LogisticRegressionModel.load(f"{folder}/topic_{i}")
                  for i in range(len(manifest["topics"]))]
        return TopicModel(PipelineModel.load(f"{folder}/featurizer"), models, manifest["topics"], manifest["text_col"], manifest.get("chosen", {}))


def _log_loss(df: DataFrame, label: str, prob: F.Column, eps: float = 1e-7) -> float:
    p = F.least(F.greatest(prob, F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return float(df.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).first()[0])


def fit_topics(train: DataFrame, text_col: str, label_cols: list[str], valid: DataFrame | None = None,
               reg_grid=REG_GRID, max_iter: int = 50, patience: int = 5,
               num_features: int = 1 << 18, threads: int = 4) -> TopicModel:
    """M3 + M4: fit the featurizer once, then per topic the best regularisation by
    hold-out log loss (ordered grid, early stop after ``patience`` non-improving steps,
    which the grid is long enough for).  ``threads`` topics are fitted at a time over
    the shared cached features.  ``chosen[topic]`` is the regularisation kept,
    ``steps[topic]`` how many were tried."""
    featurizer = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern="[A-Za-z0-9]+", gaps=False, toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="features"),
    ]).fit(train)
    tr = featurizer.transform(train).select("features", *label_cols).cache()
    va = featurizer.transform(valid).select("features", *label_cols).cache() if valid is not None else None
    class_rates = tr.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in label_cols]).first()

    def fit(c: str):
        """(model, regularisation, steps tried)"""
        rate = float(class_rates[c])
        if rate in (0.0, 1.0):
            return rate, None, 0         # one class only: constant model
        best, chosen, best_loss, since, tried = None, None, float("inf"), 0, 0
        for reg in reg_grid:
            lr = LogisticRegression(featuresCol="features", labelCol=c, regParam=reg, maxIter=max_iter,
                                    probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")
            m = lr.fit(tr)
            tried += 1
            if va is None:
                return m, reg, tried
            loss = _log_loss(m.transform(va), c, vector_to_array(F.col("__p"))[1])
            if loss < best_loss:
                best, best_loss, since, chosen = m, loss, 0, reg
            else:
                since += 1
                if since >= patience:
                    break
        return best, chosen, tried

    with ThreadPoolExecutor(threads) as pool:
        fitted = list(pool.map(fit, label_cols))
    models = [m for m, _, _ in fitted]
    chosen = {c: r for c, (_, r, _) in zip(label_cols, fitted)}
    steps = {c: n for c, (_, _, n) in zip(label_cols, fitted)}
    tr.unpersist()
    if va is not None:
        va.unpersist()
    return TopicModel(featurizer, models, list(label_cols), text_col, chosen, steps)
