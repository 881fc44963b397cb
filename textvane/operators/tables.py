"""Keyed tables: new rows, upserts, label events and their latest state."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .skew import grid

EVENT_KEY = ("user", "item", "time")
# Not interesting, interesting.
LABELS = ("0", "1")


def one_per_key(df: DataFrame, key: Sequence[str], latest_by: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `latest_by` columns.

    A grouped maximum combines before the shuffle, so a key with very many rows is cheap.
    """
    rest = [c for c in df.columns if c not in key]
    lead = [c for c in latest_by if c in rest]
    order = F.struct(*lead, *[c for c in rest if c not in lead])
    picked = df.groupBy(*key).agg(F.max(order).alias("_row"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def new_rows(incoming: DataFrame, known: DataFrame, key: Sequence[str], latest_by: Sequence[str] = ()) -> DataFrame:
    """Incoming rows whose key is not in `known`, one per key."""
    unseen = incoming.join(known.select(*key), list(key), "left_anti")
    return one_per_key(unseen, key, latest_by)


def new_wide_rows(
    incoming: DataFrame, known: DataFrame, repeated: DataFrame, key: Sequence[str], latest_by: Sequence[str] = ()
) -> DataFrame:
    """What new_rows gives, for rows too wide to move: only those whose key is in `repeated`, the keys that come twice, meet."""
    # A key met with nulls is one key here, as it is when rows are grouped.
    marks = repeated.select(*[F.col(c).alias(f"_r_{c}") for c in key])
    same = [incoming[c].eqNullSafe(marks[f"_r_{c}"]) for c in key]
    once = incoming.join(marks, same, "left_anti").join(known.select(*key), list(key), "left_anti")
    twice = new_rows(incoming.join(marks, same, "left_semi"), known, key, latest_by)
    return once.select(*incoming.columns).unionByName(twice)


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """`incoming` (one row per key) laid over `current`; the large side only meets an anti join."""
    kept = current.join(incoming.select(*key), list(key), "left_anti")
    return kept.select(*current.columns).unionByName(incoming.select(*current.columns))


def union_events(*events: DataFrame) -> DataFrame:
    """Label events of all inputs, one per (user, item, time); of equal ones the greatest label stays."""
    both = events[0]
    for other in events[1:]:
        both = both.unionByName(other)
    return one_per_key(both, EVENT_KEY, ["label"])


def latest_labels(events: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The newest label of each (user, item); of equal times the greatest label.

    Events are valid ones: see split_labels. One newest time per label is kept, so the
    aggregation is a hash aggregation over plain numbers.
    """
    ranked = sorted(labels, reverse=True)
    per_pair = events.groupBy("user", "item").agg(
        *[F.max(F.when(F.col("label") == y, F.col("time"))).alias(f"_t{i}") for i, y in enumerate(ranked)]
    )
    newest = F.greatest(*[F.col(f"_t{i}") for i in range(len(ranked))])
    label = F.coalesce(*[F.when(F.col(f"_t{i}") == newest, F.lit(y)) for i, y in enumerate(ranked)])
    out = per_pair.select("user", "item", label.alias("label"), newest.alias("time"))
    return out.filter(F.col("label").isNotNull())


def valid_label(label: Column) -> Column:
    return label.cast("string").isin(*LABELS)


def split_labels(events: DataFrame, message: str = "Label must be 0 or 1") -> DataFrame:
    """Events with the message of those outside the label domain (null for good ones)."""
    good = F.coalesce(valid_label(F.col("label")), F.lit(False))
    return events.withColumn("error", F.when(~good, F.lit(message)))


def events_of_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events whose item exists."""
    return events.join(items.select("item"), "item", "left_semi").select(*events.columns)


def rows_in_keys(df: DataFrame, column: str, keys: DataFrame | Iterable) -> DataFrame:
    """Rows whose `column` is in a set: literal values or the first column of a table."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi").select(*df.columns)
    return df.filter(F.col(column).isin(list(keys)))


def unlabelled(users: DataFrame, items: DataFrame, labels: DataFrame) -> DataFrame:
    """(user, item) pairs without a label."""
    pairs = grid(users.select("user").distinct(), items.select("item"))
    return pairs.join(labels.select("user", "item"), ["user", "item"], "left_anti").select("user", "item")


def affected_users(new_events: DataFrame) -> DataFrame:
    return new_events.select("user").distinct()


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill a missing name with a random id, a missing time with now (epoch ms) and a missing label with "interesting"."""
    out = df
    if "name" in df.columns:
        out = out.withColumn("name", F.coalesce("name", F.expr("uuid()")))
    if "time" in df.columns:
        out = out.withColumn("time", F.coalesce("time", F.unix_millis(F.current_timestamp())))
    if "label" in df.columns:
        out = out.withColumn("label", F.coalesce("label", F.lit(LABELS[-1])))
    return out
