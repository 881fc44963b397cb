"""Rows with wanted or unwanted keys, without moving the texts of the other rows.

A bitmap of key hashes, of at most 2**18 rows of 64 bits whatever the data, goes to all tasks;
only rows whose bit is set take part in the exact join. A full bitmap costs time, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 24


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    place = _place(F.col(key))
    return keys.filter(F.col(key).isNotNull()).groupBy(F.shiftright(place, 6).alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {BITS}) & 63 as int))")).alias("_bits"))


def _marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    hit = F.expr(f"shiftrightunsigned(_bits, cast(pmod(xxhash64({key}), {BITS}) & 63 as int)) & 1") == 1
    return rows.withColumn("_word", F.shiftright(_place(F.col(key)), 6)).join(
        F.broadcast(_bitmap(keys, key)), "_word", "left").withColumn(
        "_hit", F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("_word", "_bits")


def matching(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Inner join of `rows` with `keys` on `key`; null keys match nothing."""
    return _marked(rows, key, keys).filter("_hit").drop("_hit").join(keys, key)


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is not in `keys`; rows with a null key stay."""
    marked = _marked(rows, key, keys)
    kept = marked.filter("_hit").drop("_hit").join(keys.select(key), key, "left_anti")
    return marked.filter("not _hit").drop("_hit").unionByName(kept).select(rows.columns)
