"""Rows as JSON text and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T


def to_json_rows(df: DataFrame, keep: Sequence[str] = (), name: str = "json") -> DataFrame:
    """One JSON object per row, with the `keep` columns beside it; null fields are left out."""
    return df.select(*keep, F.to_json(F.struct(*df.columns)).alias(name))


def from_json_rows(df: DataFrame, schema: T.StructType, name: str = "json") -> DataFrame:
    """Parse a JSON column into the fields of `schema`; fields already present stay."""
    parsed = df.withColumn("_row", F.from_json(F.col(name), schema))
    extra = [F.col(f"_row.{f.name}") for f in schema.fields if f.name not in df.columns]
    return parsed.select(*df.columns, *extra)
