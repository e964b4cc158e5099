"""Relevance screening: n-gram features, weights by document frequency, a lasso model, decisions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.sources.tables import materialize, release


def terms(df: DataFrame, text: str, out: str = "terms") -> DataFrame:
    """Lower-case words without English stop words, and pairs of neighbours; hyphenated words are split
    and addresses left out."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+", " "), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    df = df.withColumn("_words", words)
    df = StopWordsRemover(inputCol="_words", outputCol="_kept", locale="en_US").transform(df)
    df = NGram(n=2, inputCol="_kept", outputCol="_pairs").transform(df)
    return df.withColumn(out, F.concat("_kept", "_pairs")).drop("_words", "_kept", "_pairs")


def document_frequency(df: DataFrame, least: int = 3, most: float = 0.98) -> DataFrame:
    """``term, df, idf`` (log10 of rows by df) of the terms in at least ``least`` and at most a share ``most`` of
    the rows."""
    n = df.count()
    each = df.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return each.where((F.col("df") >= least) & (F.col("df") <= most * n)).withColumn("idf", F.log10(F.lit(float(n)) / F.col("df")))


def _lasso(label: str, strength: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=1.0, regParam=strength, standardization=False, maxIter=40)


def strongest(features: DataFrame, label: str) -> float:
    """The smallest strength at which the lasso keeps no feature: the largest covariance of a feature and the label."""
    positive = F.col(label) == 1
    one = features.agg(Summarizer.mean(F.col("features")).alias("all"), F.avg(F.col(label)).alias("share")).first()
    of = features.where(positive).agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    return float(one["share"] * np.abs(of.toArray() - one["all"].toArray()).max())


def choose_strength(features: DataFrame, label: str, group: str, folds: int = 10, steps: int = 10, least: float = 0.01) -> tuple[float, list[tuple[float, float, float]]]:
    """The largest strength whose deviance lies within one standard error of the smallest, and ``(strength, mean
    deviance, standard error)`` of each that was tried.

    ``steps`` strengths from the strongest down to ``least`` of it, each fitted ``folds`` times; folds follow the hash
    of ``group``, which no fold divides.  Deviance is twice the mean log loss of the fold left out.  Both labels must occur
    in all folds' training rows."""
    top = strongest(features, label)
    tried = [top * least ** (i / max(1, steps - 1)) for i in range(steps)]
    rows = materialize(features.select("features", label, F.pmod(F.xxhash64(group), F.lit(folds)).alias("fold")), "folds")
    losses: list[list[float]] = [[] for _ in tried]
    for k in range(folds):
        train, held = rows.where(F.col("fold") != k).cache(), rows.where(F.col("fold") == k)
        for i, s in enumerate(tried):
            p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-15)), F.lit(1 - 1e-15))
            loss = _lasso(label, s).fit(train).transform(held).agg(F.avg(-2 * F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
            if loss is not None:  # a fold without rows
                losses[i].append(loss)
        train.unpersist()
    release(rows)
    tested = [(s, float(np.mean(x)), float(np.std(x, ddof=1) / np.sqrt(len(x)))) for s, x in zip(tried, losses, strict=True)]
    best = min(tested, key=lambda t: t[1])
    return max(s for s, mean, _ in tested if mean <= best[1] + best[2]), tested


class ScreeningModel:
    """Counts in a fitted vocabulary, weighted by log10(N / df), under a lasso logistic model."""

    def __init__(self, counts: CountVectorizerModel, weights: ElementwiseProduct, model: LogisticRegressionModel) -> None:
        self.counts, self.weights, self.model = counts, weights, model

    def features(self, df: DataFrame) -> DataFrame:
        return self.weights.transform(self.counts.transform(df)).drop("_tf")

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability_relevant``; rows without any known term get the model's base rate."""
        out = self.model.transform(self.features(df))
        return out.withColumn("probability_relevant", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_screening(train: DataFrame, label: str, strength: float | None = 0.01, group: str | None = None, folds: int = 10, steps: int = 10) -> ScreeningModel:
    """Fit on ``terms`` and a 0/1 ``label``; without ``strength`` it is chosen by folds of ``group``.  The vocabulary is every term in at least 3 and at most 98 % of the
    rows, however many there are; the driver holds it with its weights and coefficients, all else runs on the
    rows where they are."""
    frequencies = materialize(document_frequency(train), "document-frequency")
    size = max(1, frequencies.count())
    counts = CountVectorizer(inputCol="terms", outputCol="_tf", minDF=3, maxDF=0.98, vocabSize=size).fit(train)
    idf = frequencies.select("term", "idf").toArrow()
    known = dict(zip(idf["term"].to_pylist(), idf["idf"].to_pylist(), strict=True))
    weights = [known[t] for t in counts.vocabulary]
    product = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="features")
    features = product.transform(counts.transform(train))
    if strength is None:
        strength, _ = choose_strength(features, label, group, folds, steps)
    return ScreeningModel(counts, product, _lasso(label, strength).fit(features))


def decide(probability: Column, exclude_below: float, include_from: float) -> Column:
    return F.when(probability < exclude_below, "exclude").when(probability >= include_from, "retain").otherwise("review")


def validation_split(df: DataFrame, group: str, share: float = 0.2, seed: int = 20260) -> DataFrame:
    """``df`` with ``validation``: whole groups go to one side, by the hash of the group."""
    return df.withColumn("validation", F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(1000)) < int(share * 1000))
