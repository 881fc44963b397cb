"""Record types of the service tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, types as T


def _record(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

TENDER = _record(
    ("name", _S, False),
    ("internalUrl", _S, False),
    ("flag", _S, False),
    ("publishedBy", _S, False),
    ("publishedByUrl", _S, True),
    ("doffinReference", _S, False),
    ("announcementType", _S, False),
    ("announcementDate", _L, False),
    ("tenderDeadline", _L, True),
    ("county", _S, True),
    ("municipality", _S, True),
    ("externalUrl", _S, True),
    ("id", _L, True),
)
USER = _record(("name", _S, False), ("id", _L, True))
CLASSIFY = _record(
    ("user", _S, False), ("tender", _S, False), ("label", _S, False), ("time", _L, False), ("id", _L, True)
)
CLASSIFICATION = _record(
    ("tender", _S, False), ("user", _S, False), ("tfidf", _D, False), ("bow", _D, False),
    ("nb", _D, False), ("weighted", _D, False), ("mean", _D, False),
)
CRAWL_DATA = _record(("last", _L, False), ("id", _L, True))
INPUT_OUTPUT = _record(("input", T.ArrayType(_D), False), ("output", T.ArrayType(_D), False))
WORD = _record(("base", _S, False), ("full", _S, False), ("clazz", _S, False))

# Service tables and the key each is identified by.
TABLES = {
    "tender": (TENDER, ["doffinReference"]),
    "user": (USER, ["name"]),
    "classify": (CLASSIFY, ["user", "tender", "time"]),
    "crawl_data": (CRAWL_DATA, ["id"]),
}


def snake_columns(df: DataFrame) -> DataFrame:
    """The same rows under snake_case column names."""
    return df.toDF(*[re.sub(r"(?<!^)([A-Z\d])", r"_\1", c).lower() for c in df.columns])
