"""URL filters as a sort-merge range join, by DataFrame functions only.

A rule (host, path) becomes a key: the host's labels in reverse order, a mark, then the path. All
keys that start with it form an interval, and two such intervals are nested or apart. A URL has
one key for its host and one for each parent domain, all with the URL's path; a rule fits when
its interval holds one of them. Rules and keys are sorted together over range partitions, and one
sweep keeps the stack of open rules: one running value for each nesting depth. What stands open
before a partition comes from a table with a row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

MARK = "\u0001"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is none."""
    rest = F.substring_index(F.translate(_after(url), "?#", "//"), "/", 1)
    return F.coalesce(_lower(rest), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty where there is no host part."""
    rest = F.substring_index(F.translate(_after(url), "#", "?"), "?", 1)
    at = F.locate("/", rest)
    return F.coalesce(F.when(at > 0, F.substring(rest, at, F.length(rest))), F.lit(""))


def reversed_host(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, rule, action, width, depth): depth counts the other rules whose interval holds this one.

    Of rules with one host and path the action that comes first in the alphabet holds. Rules with a
    null host or path fit nothing.
    """
    keyed = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat(reversed_host(_lower(F.col("host"))), F.lit(MARK), F.col("path")).alias("key"),
        F.concat(_lower(F.col("host")), F.col("path")).alias("rule"),
        "action", F.length("host").alias("host_width"),
    ).groupBy("key").agg(F.min("rule").alias("rule"), F.min("action").alias("action"), F.min("host_width").alias("host_width"))
    keyed = stage(keyed.withColumn("width", F.length("rule")), "rules")
    # Every shorter start of a key, matched to the keys themselves.
    starts = keyed.select("key", F.explode(F.expr("sequence(1, length(key))")).alias("n")).filter(
        F.col("n") < F.length("key")).select("key", F.expr("substring(key, 1, n)").alias("outer"))
    depth = starts.join(keyed.select(F.col("key").alias("outer")), "outer").groupBy("key").agg(F.count(F.lit(1)).alias("depth"))
    return keyed.join(depth, "key", "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int"))


def _places(urls: DataFrame) -> DataFrame:
    """(host, path, key): a key for the host and each parent domain."""
    labels = F.split(F.col("host"), r"\.")
    flat = urls.withColumn("_labels", F.reverse(labels)).select(
        "host", "path", F.explode(F.expr(
            "transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, 1, i), '.'))")).alias("_place"))
    return flat.select("host", "path", F.concat("_place", F.lit(MARK), "path").alias("key"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The columns of `pages` (with `url`) and host, path, rule, verdict.

    Null urls and urls without :// have empty host and path, and no rule fits them. Of several
    rules that fit, the one with most characters holds; of equally long ones the longer host.
    Repeated pages each have their row. Columns named like a result give way to it.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    located = pages.select(*own, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    distinct = located.select("host", "path").distinct()
    named = rule_keys(rules)
    events = _places(distinct.filter("host != ''")).select(
        "key", F.lit(1).alias("kind"), "host", "path", *[F.lit(None).cast(t).alias(c) for c, t in
        (("rule", "string"), ("action", "string"), ("width", "int"), ("host_width", "int"), ("depth", "int"))])
    events = events.unionByName(named.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        "rule", "action", "width", "host_width", "depth"))
    # Sorted once; the place in the order is kept, so that the sweep can read it back.
    placed = stage(events.repartitionByRange("key", "kind", "host", "path").sortWithinPartitions("key", "kind", "host", "path").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "sweep")
    deepest = named.agg(F.max("depth")).first()[0]
    slots = range(0 if deepest is None else deepest + 1)
    opened = lambda d: F.when(F.col("depth") == d, F.struct("key", "rule", "action", "width", "host_width"))
    sweep = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range partition.
    carry = placed.groupBy("part").agg(*[F.max_by(opened(d), F.when(F.col("depth") == d, F.col("seq"))).alias(f"_last{d}") for d in slots]) if slots else None
    stack = placed
    if slots:
        carry = carry.select("part", *[F.last(f"_last{d}", ignorenulls=True).over(earlier).alias(f"_carry{d}") for d in slots])
        stack = placed.select("*", *[F.last(opened(d), ignorenulls=True).over(sweep).alias(f"_here{d}") for d in slots]).join(carry, "part")
    # A slot is open while its key is a start of the row's key; what lies above a closed slot is closed.
    inner = F.lit(None).cast("struct<rule:string,action:string,width:int,host_width:int>")
    for d in slots:
        top = F.coalesce(f"_here{d}", f"_carry{d}")
        inner = F.when(F.startswith(F.col("key"), top["key"]), F.struct(top["rule"].alias("rule"), top["action"].alias("action"),
                                                                         top["width"].alias("width"), top["host_width"].alias("host_width"))).otherwise(inner)
    hits = stack.filter("kind = 1").select("host", "path", inner.alias("r")).filter("r is not null").groupBy("host", "path").agg(
        F.max_by(F.struct("r.rule", "r.action"), F.struct("r.width", "r.host_width")).alias("r"))
    return located.join(hits, ["host", "path"], "left").select(
        *own, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", F.lit(default)).alias("verdict"))
