"""Term classifier (M4) with Spark MLlib.

The original trains a binary SVM outside Spark and thresholds a
probability-like output.  Here: ``VectorAssembler -> StandardScaler ->
LogisticRegression`` (the default) or ``LinearSVC`` whose margin becomes a probability by
Platt's method: a sigmoid fitted on margins of rows that the machine was not trained on.
Training and scoring are distributed MLlib jobs; nothing is collected.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(train_rows: DataFrame, feature_cols: Sequence[str], kind: str = "logistic",
          max_iter: int = 50, reg: float = 0.01):
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="_raw", handleInvalid="keep")
    sc = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)
    if kind == "logistic":
        clf = LogisticRegression(featuresCol="_x", labelCol="label", maxIter=max_iter, regParam=reg)
    elif kind == "svm":
        clf = LinearSVC(featuresCol="_x", labelCol="label", maxIter=max_iter, regParam=reg)
    else:
        raise ValueError(kind)
    return Pipeline(stages=[asm, sc, clf]).fit(train_rows)


def held_out_margins(train_rows: DataFrame, feature_cols: Sequence[str], key_col: str = "term", folds: int = 5,
                     max_iter: int = 50, reg: float = 0.01) -> DataFrame:
    """(key, label, margin): the margin of each training row under the SVM trained without
    its fold.  Rows of one key share a fold, chosen by a hash of the key."""
    fold, out = F.pmod(F.xxhash64(key_col), F.lit(folds)), None
    for k in range(folds):
        model = train(train_rows.where(fold != k), feature_cols, "svm", max_iter, reg)
        part = model.transform(train_rows.where(fold == k)).select(key_col, F.col("label").cast("double").alias("label"),
                                                                   vector_to_array("rawPrediction")[1].alias("margin"))
        out = part if out is None else out.unionByName(part)
    return out


def platt(margins: DataFrame) -> tuple[float, float]:
    """(a, b) of P(label = 1 | margin) = 1 / (1 + exp(a margin + b)), by maximum likelihood against
    Platt's targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), which keep the fit finite where the
    margins part the labels.  A row counts as both labels, weighted by its target."""
    n = margins.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") != 1).alias("n0")).first()
    target = F.when(F.col("label") == 1, (n["n1"] + 1) / (n["n1"] + 2)).otherwise(1 / (n["n0"] + 2))
    rows = margins.select("margin", target.alias("t")).select("margin", F.inline(F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("t")).alias("w")))))
    x = VectorAssembler(inputCols=["margin"], outputCol="x").transform(rows)
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, maxIter=200, tol=1e-12).fit(x)
    return -float(fitted.coefficients[0]), -float(fitted.intercept)


def train_calibrated(train_rows: DataFrame, feature_cols: Sequence[str], key_col: str = "term", folds: int = 5,
                     max_iter: int = 50, reg: float = 0.01):
    """An SVM on all rows and the (a, b) of its calibration, fitted on held-out margins."""
    return train(train_rows, feature_cols, "svm", max_iter, reg), platt(held_out_margins(train_rows, feature_cols, key_col, folds, max_iter, reg))


def calibrated(margin, ab: tuple[float, float]):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(ab[0]) * margin + F.lit(ab[1])))


def predict_calibrated(fitted, rows: DataFrame) -> DataFrame:
    """(term, score, pred) of :func:`train_calibrated`: ``pred`` is P(label = 1)."""
    model, ab = fitted
    return model.transform(rows).select("term", "score", calibrated(vector_to_array("rawPrediction")[1], ab).alias("pred"))


def reliability(margins: DataFrame, ab: tuple[float, float], bins: int = 10) -> DataFrame:
    """(bin, n, positives, mean_pred) of held-out rows by their calibrated probability: where
    it means what it says, positives / n is near mean_pred."""
    p = calibrated(F.col("margin"), ab)
    return margins.select(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"), p.alias("p"), "label") \
        .groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.avg("p").alias("mean_pred"))


def predict(model, rows: DataFrame, kind: str = "logistic") -> DataFrame:
    """(term, score, pred): ``pred`` is P(label = 1) (logistic) or the plain sigmoid of the
    SVM margin, which is no probability (:func:`predict_calibrated` gives one)."""
    out = model.transform(rows)
    if kind == "logistic":
        pred = vector_to_array("probability")[1]
    else:
        pred = F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select("term", "score", pred.alias("pred"))
