"""Joins and grids that keep their tasks even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot when it holds at least this share of the rows: so at most 500 keys can be hot.
HOT_SHARE = 0.002
SALTS = 32
# Up to this many rows one side of a grid travels as a literal array.
LITERAL_ROWS = 1000
# Rows of the other side in a slice of a larger grid, and so pairs of a cell up to this times LITERAL_ROWS.
SLICE_ROWS = 10_000


def spread(df: DataFrame, key: str, per_task: int = 4 << 20) -> DataFrame:
    """Put a small input on all cores before costly per-row work.

    A file of one row group is read by one task however many cores there are. An input
    estimated above `per_task` bytes per core already has enough splits and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > per_task * cores:
        return df
    return df.repartition(cores, key)


def hot_values(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Values of `key` that hold at least `share` of the rows, by one mergeable sketch.

    The estimate steers only how rows are spread, never which rows come out.
    """
    most = int(1 / share)
    row = df.agg(
        F.expr(f"approx_top_k({key}, {most}, {most * 20})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [item["item"] for item in row["top"] or [] if item["count"] >= share * row["n"]]


def _salt(key: str, hot: Sequence, spread: Sequence[str]) -> Column:
    return F.when(F.col(key).isin(list(hot)), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)


def salted_join(
    big: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    hot_key: str,
    spread: Sequence[str],
    how: str = "inner",
    hot: Sequence | None = None,
) -> DataFrame:
    """Join `big` to `lookup` on `on`, with the hot values of `hot_key` spread over SALTS tasks.

    Rows of `big` take a salt from a hash of the `spread` columns, so a repeated task gives
    the same salt; only the lookup rows of hot keys are repeated.
    """
    hot = hot_values(big, hot_key) if hot is None else hot
    if not hot:
        return big.join(lookup, list(on), how)
    salts = F.when(F.col(hot_key).isin(list(hot)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    left = big.withColumn("_salt", _salt(hot_key, hot, spread))
    right = lookup.withColumn("_salt", F.explode(salts))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def grid(few: DataFrame, many: DataFrame, literal_rows: int = LITERAL_ROWS, slices: int | None = None) -> DataFrame:
    """Every row of `few` beside every row of `many` (columns must differ).

    A counted short side is put into the plan as an array and unfolded, which moves nothing.
    A longer one is cut into blocks, the other into slices, both as many as their rows ask for, and
    each (block, slice) cell is one join key, so the work is even over cells whatever the values are.
    """
    head = few.limit(literal_rows + 1).collect()
    if len(head) <= literal_rows:
        if not head:
            return many.limit(0).select(
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema.fields], *many.columns
            )
        rows = F.array(
            *[
                F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in few.schema.fields])
                for row in head
            ]
        )
        return many.select(F.explode(rows).alias("_few"), *many.columns).select("_few.*", *many.columns)
    blocks = -(-few.count() // literal_rows)
    slices = max(1, -(-many.count() // SLICE_ROWS)) if slices is None else slices
    cells_few = few.select(
        "*",
        F.pmod(F.xxhash64(*few.columns), F.lit(blocks)).alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("_slice"),
    )
    cells_many = many.select(
        "*",
        F.pmod(F.xxhash64(*many.columns), F.lit(slices)).alias("_slice"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("_block"),
    )
    return cells_few.join(cells_many, ["_block", "_slice"]).select(*few.columns, *many.columns)
