"""Quality of predictions: losses, confusion counts, k folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.loss import log_loss
from .numbering import number_distinct

THRESHOLD = 0.5


def thresholded(p: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(p > threshold, 1).otherwise(0)


def arg_max(values: Column) -> Column:
    """0-based place of the greatest element, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def prediction_loss(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error and mean log loss of (label, p)."""
    y, p = F.col("label").cast("double"), F.col("p")
    return rows.groupBy(*by).agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(log_loss(p, y)).alias("log_loss"))


def confusion_counts(rows: DataFrame, by: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """True and false positives and negatives, their total and the mean squared error."""
    actual, expected = thresholded(F.col("p"), threshold), F.col("label").cast("int")
    y = F.col("label").cast("double")

    def count(a: int, e: int) -> Column:
        return F.count_if((actual == a) & (expected == e))

    return rows.groupBy(*by).agg(
        count(1, 1).alias("true_pos"), count(0, 0).alias("true_neg"), count(1, 0).alias("false_pos"),
        count(0, 1).alias("false_neg"), F.count(F.lit(1)).alias("total"), F.avg((y - F.col("p")) ** 2).alias("error"),
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall and accuracy; null where nothing is divided by."""
    tp, tn = F.col("true_pos"), F.col("true_neg")
    return counts.select(
        "*",
        F.try_divide(tp, tp + F.col("false_pos")).alias("precision"),
        F.try_divide(tp, tp + F.col("false_neg")).alias("recall"),
        F.try_divide(tp + tn, F.col("total")).alias("accuracy"),
    )


def binary_metrics(rows: DataFrame, by: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    return with_ratios(confusion_counts(rows, by, threshold))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """(expected, actual, n) of any labels."""
    return rows.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def misclassified(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose thresholded prediction is not their label."""
    out = rows.withColumn("actual", thresholded(F.col("p"), threshold)).withColumn("expected", F.col("label").cast("int"))
    return out.filter(F.col("actual") != F.col("expected"))


def with_fold(rows: DataFrame, key: str, k: int = 4) -> DataFrame:
    """Add fold 0 to k - 1 by the key's place in digest order: an even, repeatable shuffle."""
    folds = number_distinct(rows.select(key).distinct(), key, "_no")
    return rows.join(folds, key).withColumn("fold", F.pmod("_no", F.lit(k)).cast("int")).drop("_no")


def kfold_metrics(rows: DataFrame, k: int = 4) -> DataFrame:
    """Per fold counts, and as fold -1 their sums, the mean error of the folds and the ratios."""
    per_fold = confusion_counts(rows, ["fold"])
    names = ["true_pos", "true_neg", "false_pos", "false_neg", "total"]
    overall = per_fold.agg(*[F.sum(c).alias(c) for c in names], F.avg("error").alias("error"))
    return with_ratios(per_fold.unionByName(overall.withColumn("fold", F.lit(-1))))
