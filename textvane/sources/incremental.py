"""Reading only what was published since the stored position."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F


def window_start(last: date | str, now: date | datetime, lookback_days: int = 300) -> date:
    """The later of the stored position and now minus the look-back, as a day."""
    last = date.fromisoformat(last) if isinstance(last, str) else last
    now = now.date() if isinstance(now, datetime) else now
    return max(last, now - timedelta(days=lookback_days))


def published_since(df: DataFrame, column: str, last, now, lookback_days: int = 300) -> DataFrame:
    """Rows on or after the window start; the bound is a literal, so the scan can skip row groups."""
    kind = dict(df.dtypes)[column]
    start = F.lit(window_start(last, now, lookback_days).isoformat()).cast(kind)
    return df.filter(F.col(column) >= start)
