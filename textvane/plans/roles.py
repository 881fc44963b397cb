"""The star-schema test tables in the roles of the service's own entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import TOKEN_CLASS, words
from ..operators.skew import spread
from ..sources.tables import read_table

# Value above which an event counts as a positive label.
LIKED = 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, whatever the session zone is."""
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    second = F.floor(F.expr("1000") * F.date_part(F.lit("SECOND"), ts)).cast("bigint")
    return day * 86400000 + F.hour(ts).cast("bigint") * 3600000 + F.minute(ts).cast("bigint") * 60000 + second


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, text) from documents."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text"), "item")


def event_labels(spark: SparkSession, sf_dir: str, threshold: float = LIKED) -> DataFrame:
    """(user, item, time, label) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("user"),
        F.col("event_type").alias("item"),
        millis(F.col("ts")).alias("time"),
        F.when(F.col("value") > threshold, "1").otherwise("0").alias("label"),
    )


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, time, label): the two label columns of `labels` as two users."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.explode(
            F.array(
                F.struct(F.lit("quality").alias("user"), F.col("quality").cast("string").alias("label")),
                F.struct(F.lit("toxic").alias("user"), F.col("toxic").cast("string").alias("label")),
            )
        ).alias("l"),
        F.col("doc_id").alias("item"),
    ).select("l.user", "item", F.lit(0).cast("bigint").alias("time"), "l.label")


def item_tokens(source: DataFrame) -> DataFrame:
    """(item, pos, word) of every text, in order."""
    return source.select("item", F.posexplode(words(F.col("text"))).alias("pos", "word"))


# The same roles in SQL.
SQL_EVENT_LABELS = f"""
select user_id as "user", event_type as item, epoch_us(ts) // 1000 as "time",
       case when value > {LIKED} then '1' else '0' end as label from events"""
SQL_DOCUMENT_LABELS = """
select 'quality' as "user", doc_id as item, cast(0 as bigint) as "time", cast(quality as varchar) as label from labels
union all
select 'toxic', doc_id, cast(0 as bigint), cast(toxic as varchar) from labels"""
SQL_TOKEN_LISTS = f"""
select doc_id as item, regexp_extract_all(lower(text), '{TOKEN_CLASS}+') as tokens from documents"""
SQL_ITEM_TOKENS = f"""
select item, generate_subscripts(tokens, 1) - 1 as pos, unnest(tokens) as word from ({SQL_TOKEN_LISTS})"""
SQL_ITEM_WORDS = f"""
select item, word, count(*) as n from (
  select item, unnest(case when len(tokens) = 0 then [''] else tokens end) as word from ({SQL_TOKEN_LISTS}))
group by item, word"""
