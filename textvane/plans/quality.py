"""Queries on the quality of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as E
from . import relevance
from .roles import table
from .vectors import SQL_NEAREST, nearest_centroid
from .relevance import SQL_LOO


def _predictions(spark, sf_dir) -> DataFrame:
    return relevance.nb_leave_one_out(spark, sf_dir)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def prediction_loss(spark, sf_dir):
    return _rounded(E.prediction_loss(_predictions(spark, sf_dir), ["user"]))


def binary_metrics(spark, sf_dir):
    return _rounded(E.binary_metrics(_predictions(spark, sf_dir), ["user"]))


def confusion_matrix(spark, sf_dir):
    """Nearest per-label mean against the true label of every embedding."""
    near = nearest_centroid(spark, sf_dir).select("vec_id", F.col("cluster").alias("actual"))
    truth = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("expected"))
    return E.confusion_matrix(near.join(truth, "vec_id"))


def misclassified(spark, sf_dir):
    return E.misclassified(_predictions(spark, sf_dir)).select("user", "item", "expected", "actual", "p")


def kfold_metrics(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("key", F.concat_ws(":", "user", "item"))
    return _rounded(E.kfold_metrics(E.with_fold(rows, "key")))


QUERIES = {
    "prediction_loss": prediction_loss,
    "binary_metrics": binary_metrics,
    "confusion_matrix": confusion_matrix,
    "misclassified": misclassified,
    "kfold_metrics": kfold_metrics,
}

_COUNTS = """count(*) filter (where p > 0.5 and label = '1') as true_pos, count(*) filter (where not p > 0.5 and label = '0') as true_neg,
  count(*) filter (where p > 0.5 and label = '0') as false_pos, count(*) filter (where not p > 0.5 and label = '1') as false_neg,
  count(*) as total, avg((cast(label as double) - p) ** 2) as error"""
_RATIOS = """round(case when true_pos + false_pos > 0 then true_pos / (true_pos + false_pos) end, 6) as precision,
  round(case when true_pos + false_neg > 0 then true_pos / (true_pos + false_neg) end, 6) as recall,
  round((true_pos + true_neg) / total, 6) as accuracy"""
_LOSS = "greatest(5e-7, least(1 - 5e-7, cast(label as double))) * greatest(5e-7, least(1 - 5e-7, p))"

SQL = {
    "confusion_matrix": f"""
select label as expected, cluster as actual, count(*) as n from ({SQL_NEAREST}) join embeddings using (vec_id) group by 1, 2""",
    "prediction_loss": f"""
select "user", round(avg((cast(label as double) - p) ** 2), 6) as mse, round(avg(2 * ln(1 + exp(-2 * {_LOSS}))), 6) as log_loss
from ({SQL_LOO}) group by "user" """,
    "binary_metrics": f"""
select "user", true_pos, true_neg, false_pos, false_neg, total, round(error, 6) as error, {_RATIOS}
from (select "user", {_COUNTS} from ({SQL_LOO}) group by "user")""",
    "misclassified": f"""
select "user", item, cast(label as integer) as expected, case when p > 0.5 then 1 else 0 end as actual, p
from ({SQL_LOO}) where cast(label as integer) <> case when p > 0.5 then 1 else 0 end""",
    "kfold_metrics": f"""
with rows_ as (
  select *, cast((row_number() over (order by md5("user" || ':' || item), "user" || ':' || item) - 1) % 4 as integer) as fold
  from ({SQL_LOO})),
per as (select fold, {_COUNTS} from rows_ group by fold),
both_ as (
  select * from per
  union all by name
  select -1 as fold, cast(sum(true_pos) as bigint) as true_pos, cast(sum(true_neg) as bigint) as true_neg, cast(sum(false_pos) as bigint) as false_pos,
         cast(sum(false_neg) as bigint) as false_neg, cast(sum(total) as bigint) as total, avg(error) as error from per)
select fold, true_pos, true_neg, false_pos, false_neg, total, round(error, 6) as error, {_RATIOS} from both_""",
}
