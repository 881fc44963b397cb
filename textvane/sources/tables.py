"""Reading and writing tables by connector name."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

FORMATS = ("parquet", "orc", "json", "csv", "jdbc")


def read_table(spark: SparkSession, location: str, name: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """One table: a file below `location`, or a table of the database at the JDBC address `location`.

    For JDBC give partitionColumn, lowerBound, upperBound and numPartitions, so that the
    table is read by many tasks.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown table format {fmt!r}, expected one of {FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.option("url", location).option("dbtable", name).load()
    if schema is not None:
        reader = reader.schema(schema)
    for path in (os.path.join(location, f"{name}.{fmt}"), os.path.join(location, name)):
        try:
            return reader.load(path)
        except AnalysisException as missing:
            error = missing
    raise error


def load_tables(spark: SparkSession, location: str, names: Sequence[str], fmt: str = "parquet", **options):
    """(tables, errors): each name is in exactly one of the two."""
    tables, errors = {}, {}
    for name in names:
        try:
            tables[name] = read_table(spark, location, name, fmt, **options)
        except Exception as error:  # one bad table must not hide the others
            errors[name] = str(error).splitlines()[0]
    return tables, errors


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("append").save(path)


# Rows of a hash bucket of a new table, which also has at least so many buckets.
BUCKET_ROWS, MIN_BUCKETS = 1_000_000, 64


def _layout(path: str) -> str:
    """Where the bucket count of a table lies: readers of the table pass over names with an underscore."""
    return os.path.join(path, "_buckets")


def write_buckets(df: DataFrame, path: str, key: Sequence[str], buckets: int | None = None) -> None:
    """Write a keyed table in hash buckets, so that an upsert rewrites only the buckets it touches.

    The number of buckets follows the rows unless given, and is kept with the table.
    """
    if buckets is None:
        buckets = max(MIN_BUCKETS, -(-df.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket", *key).write.mode("overwrite").partitionBy("bucket").parquet(path)
    df.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(_layout(path))


def upsert_buckets(spark: SparkSession, incoming: DataFrame, path: str, key: Sequence[str]) -> None:
    """Insert or update `incoming` (one row per key) in a table made by write_buckets, by the bucket count kept there.

    The rewritten buckets are staged first: a file set cannot be read and replaced in one job.
    """
    from ..operators.tables import upsert
    from ..session import discard, stage

    buckets = spark.read.schema("buckets int").json(_layout(path)).first()["buckets"]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    incoming = incoming.withColumn("bucket", bucket)
    touched = [r[0] for r in incoming.select("bucket").distinct().collect()]  # at most `buckets` numbers
    current = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    merged = stage(upsert(current, incoming.select(*current.columns), key), "upsert")
    (
        merged.repartition("bucket", *key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
    discard(merged)
