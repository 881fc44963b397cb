"""Mixing sources to target weights with exact quotas, by DataFrame functions only.

Each source's documents fall into blocks by a hash, and the blocks into a random order. A source's
quota is the number of blocks, counted over and over, whose words reach its target; the last block
is drawn in part, its last document cut, so a source gives its target to the word. A splitting
tree shares the quotas among output shards: a node's left half takes a multivariate hypergeometric
draw of the node's quotas, the right half the rest, and both keep disjoint ranges of each source's
order. Every draw comes from hashes of the seed, so reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

WORD = "[^\\x20\\x09-\\x0D]+"
MOST_REPEATS = 3
# Sums over a source's blocks are taken in groups of this many blocks, then over the groups.
GROUP = 64


@dataclass(frozen=True)
class Sizes:
    block_words: int = 1 << 13
    block_docs: int = 1 << 10
    shard_blocks: int = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_rank(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`sources` with `weight`: by code point of the source, null last, the weights in turn."""
    # One row a source; names are compared as bytes, which is the order of code points.
    return sources.withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1))


def targets(sources: DataFrame, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, ...) with `target`: the weighted part of all words, capped.

    A target stops at `most` times its source's size; the excess goes to the others by weight until
    none is above. Each round is one sum over the sources and fixes at least one of them.
    """
    if share > most:
        raise ValueError("share must not exceed the repeats allowed")
    cap = F.col("source_size") * most
    level: float | None = None
    total = None
    while True:
        full = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("open"),
        ).first()
        total = (row["words"] or 0) * share
        now = (total - row["fixed"]) / row["open"] if row["open"] else math.inf
        if level is not None and (now <= level or math.isinf(now)):
            break
        level = now
    level = 0.0 if math.isinf(level) and not total else level
    reach = cap.cast("double") if math.isinf(level) else F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", F.when(F.col("source_size") > 0, reach).otherwise(F.lit(0.0)))


def _log_factorial(n: str) -> str:
    """ln n! by Stirling's series shifted to arguments above 8, exact to about 1e-12."""
    x = f"({n} + 9D)"
    below = " * ".join(f"({n} + {i}D)" for i in range(1, 9))
    return (f"(({x} - 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)}D + 1 / (12 * {x})"
            f" - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)) - ln({below}))")


def _let(fields: str, name: str, body: str) -> str:
    """SQL that computes `fields` once and uses them in `body` as name.field."""
    return f"element_at(transform(array(struct({fields})), {name} -> {body}), 1)"


def hypergeometric(good: str, rest: str, draws: str, u: str) -> str:
    """SQL for how many of `draws` out of good + rest are good: the inverse of the distribution at `u`.

    Mass is added from the mode outward on both sides, by the ratio of neighbouring terms, until it
    reaches u. Twelve deviations and 40 steps on either side hold all mass that a double can tell.
    """
    lf = _log_factorial
    step = _let(
        "if(s.up < c.high, s.pu * (b.good - s.up) / (s.up + 1) * (b.draws - s.up) / (b.rest - b.draws + s.up + 1), 0D) as pu, "
        "if(s.down > c.low, s.pd * s.down / (b.good - s.down + 1) * (b.rest - b.draws + s.down) / (b.draws - s.down + 1), 0D) as pd",
        "t",
        "struct(s.up + 1 as up, t.pu as pu, s.down - 1 as down, t.pd as pd, s.left - t.pu - t.pd as left, "
        "case when s.got is not null then s.got when s.left <= t.pu then s.up + 1 when s.left <= t.pu + t.pd then s.down - 1 end as got)")
    fold = (f"aggregate(sequence(1L, d.width), struct(c.mode as up, d.peak as pu, c.mode as down, d.peak as pd, b.u - d.peak as left, "
            f"if(b.u <= d.peak, c.mode, cast(null as bigint)) as got), (s, i) -> if(s.got is not null, s, {step}), s -> coalesce(s.got, c.mode))")
    peak = (f"exp({lf('b.good')} + {lf('b.rest')} + {lf('b.draws')} + {lf('(b.good + b.rest - b.draws)')} - {lf('(b.good + b.rest)')}"
            f" - {lf('c.mode')} - {lf('(b.good - c.mode)')} - {lf('(b.draws - c.mode)')} - {lf('(b.rest - b.draws + c.mode)')})")
    spread = "cast(ceil(12 * sqrt(cast(b.draws as double) * b.good / (b.good + b.rest))) as bigint) + 40"
    body = _let(f"{peak} as peak, {spread} as width", "d", fold)
    bounds = ("greatest(0L, b.draws - b.rest) as low, least(b.good, b.draws) as high, "
              "least(least(b.good, b.draws), greatest(greatest(0L, b.draws - b.rest), "
              "cast(floor(cast(b.draws + 1 as double) * (b.good + 1) / (b.good + b.rest + 2)) as bigint))) as mode")
    return _let(f"{good} as good, {rest} as rest, {draws} as draws, {u} as u", "b",
                _let(bounds, "c", f"if(c.low >= c.high, c.low, {body})"))


def _split(node: DataFrame, seed: int) -> DataFrame:
    """Children of nodes (shards lo to hi - 1, quotas): left and right half with their quotas."""
    u = f"(shiftrightunsigned(xxhash64({seed}, a.lo, a.hi, q.at), 11) + 0.5D) / {float(1 << 53)}D"
    got = hypergeometric("q.n", "s.all - q.n", "s.seats", u)
    draw = _let(f"{got} as got", "g", "struct(s.all - q.n as all, s.seats - g.got as seats, concat(s.left, array(g.got)) as left)")
    drawn = node.withColumn("_node", F.expr(_let(
        "lo, hi, quotas, cast(floor((lo + hi) / 2) as bigint) as half, aggregate(quotas, 0L, (t, q) -> t + q.n) as total", "a",
        "struct(a.half as half, aggregate(a.quotas, struct(a.total as all, "
        "cast(floor(cast(a.total as double) * (a.half - a.lo) / (a.hi - a.lo)) as bigint) as seats, cast(array() as array<bigint>) as left), "
        f"(s, q) -> {draw}, s -> s.left) as left)")))
    left = "filter(zip_with(quotas, _node.left, (q, g) -> struct(q.at as at, q.start as start, g as n)), q -> q.n > 0)"
    right = "filter(zip_with(quotas, _node.left, (q, g) -> struct(q.at as at, q.start + g as start, q.n - g as n)), q -> q.n > 0)"
    halves = (f"if(hi - lo <= 1, array(struct(lo, hi, quotas)), array(struct(lo, _node.half as hi, {left} as quotas), "
              f"struct(_node.half as lo, hi, {right} as quotas)))")
    return drawn.select(F.explode(F.expr(halves)).alias("c")).select("c.*")


def shard_ranges(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(at, quota) -> (shard, at, start, n): the range of each source's order that a shard draws.

    Each level of the tree is one step on its nodes; every few levels the nodes are spread anew.
    """
    node = quotas.filter("quota > 0").agg(F.sort_array(F.collect_list(F.struct(
        F.col("at"), F.lit(0).cast("long").alias("start"), F.col("quota").cast("long").alias("n")))).alias("quotas"))
    node = node.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        node = _split(node, seed)
        if level % 4 == 3:
            node = node.repartition("lo")
    return node.select(F.col("lo").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.*")


def _running(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Sum of `value` over earlier rows of each key, as `before`, in two levels so no key is one task."""
    df = df.withColumn("_group", F.floor(F.col(order) / GROUP))
    inner = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy(*keys, "_group").agg(F.sum(value).alias("_n"))
    groups = groups.select(*keys, "_group", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_base"))
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(groups, [*keys, "_group"]).withColumn(
        "before", F.col("_base") + F.col("_in")).drop("_group", "_in", "_base")


@dataclass
class Mix:
    """docs: (row columns, size, source_size, target, taken, n_draws, shards) a document; draws: its copies."""

    docs: DataFrame
    draws: DataFrame


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_REPEATS,
    seed: int = 0, sizes: Sizes = Sizes(),
) -> Mix:
    """Plan the mix of (doc_id, text, source).

    `draws` has one row for each copy: doc_id, shard, seat (order inside the shard), words (all of
    the document's, or fewer for the one document of a source that is cut).

    A null source is a source of its own, ranked last. Null, empty and blank texts have no words and
    are never drawn; they are in `docs` with taken 0. Documents are told apart by doc_id; repeated
    rows with one doc_id are drawn one by one, each counted in its own row, and share a block. Sources
    without words have target 0. Empty tables give empty results.
    """
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = by_rank(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights)
    goal = targets(stage(sources, "sources"), share, most)
    goal = stage(goal.select(
        F.col("_rank").alias("at"), "source", "source_size", "target", F.round("target").cast("long").alias("goal"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / sizes.block_words), F.ceil(F.col("n_docs") / sizes.block_docs)).alias("blocks"),
    ), "targets")
    # Sources are few against rows; the planner sends the table to all tasks only when it is small.
    known = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    placed = known.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "blocks"))
    blocks = placed.filter("size > 0").groupBy("at", "block").agg(
        F.sum("size").alias("words"), F.any_value("goal").alias("goal"), F.any_value("blocks").alias("blocks"),
        F.any_value("source_size").alias("source_size"))
    blocks = stage(_running(blocks, ["at"], "block", "words"), "blocks")
    # Of each block the words drawn: whole rounds over the source, then up to the goal.
    drawn = blocks.select(
        "at", "block", "blocks", "words",
        F.when(F.col("goal") > 0, F.expr("goal div source_size")).otherwise(0).cast("long").alias("rounds"),
        F.least(F.col("words"), F.greatest(F.lit(0).cast("long"),
                F.when(F.col("goal") > 0, F.expr("goal % source_size")).otherwise(0).cast("long") - F.col("before"))).alias("part"),
    )
    # Positions in the source's order: round after round, each over all blocks that hold words.
    copies = drawn.withColumn("n", F.col("rounds") + (F.col("part") > 0).cast("long"))
    quota = stage(copies.groupBy("at").agg(F.max(F.when(F.col("n") > 0, F.col("block") + (F.col("n") - 1) * F.col("blocks")) + 1).alias("quota"),
                                           F.sum("n").alias("copies")).filter("copies > 0"), "quotas")
    total = quota.agg(F.sum("copies")).first()[0] or 0
    shards = max(1, math.ceil(total / sizes.shard_blocks))
    ranges = shard_ranges(quota.select("at", "quota"), shards, seed)
    seats = ranges.select("at", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("position"))
    block_draws = copies.filter("n > 0").select(
        "at", "block", "rounds", "part", F.explode(F.expr("sequence(0L, n - 1)")).alias("turn"), "blocks",
    ).withColumn("position", F.col("block") + F.col("turn") * F.col("blocks")).join(seats, ["at", "position"])
    block_draws = stage(block_draws.select(
        "at", "block", F.when(F.col("turn") < F.col("rounds"), F.lit(None).cast("long")).otherwise(F.col("part")).alias("limit"),
        "turn", "shard"), "draws")
    # Inside a block documents follow a hash; only the block that ends a source's quota needs their order.
    inside = Window.partitionBy("at", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.filter("size > 0").select("at", "block", "doc_id", "size").withColumn(
        "_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    draws = ordered.join(block_draws, ["at", "block"], "left").withColumn(
        "words", F.when(F.col("turn").isNull(), F.lit(0).cast("long")).when(F.col("limit").isNull(), F.col("size")).otherwise(
            F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("limit") - F.col("_before")))))
    draws = stage(draws.select(
        "doc_id", "size", "at", "_before", "shard", "turn", "words",
        F.xxhash64(F.lit(seed + 2), "doc_id", "turn", "_before").alias("seat")), "mix")
    real = F.col("words") > 0
    out = draws.groupBy("at", "doc_id", "size", "_before").agg(
        F.sum("words").alias("taken"), F.count_if(real).alias("n_draws"),
        F.sort_array(F.collect_set(F.when(real, F.col("shard")))).alias("shards")).drop("_before")
    draws = draws.filter(real)
    # Rows without words were never in a block.
    blank = placed.filter("size = 0").select("at", "doc_id", "size", F.lit(None).cast("long").alias("taken"),
                                             F.lit(None).cast("long").alias("n_draws"), F.lit(None).cast("array<bigint>").alias("shards"))
    out = out.unionByName(blank).join(goal.select("at", "source", "source_size", "target"), "at").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n_draws", F.lit(0)).cast("long").alias("n_draws"), F.coalesce("shards", F.expr("cast(array() as array<bigint>)")).alias("shards"))
    return Mix(out, draws)


def mixed_docs(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as the mix takes them: once for each draw.

    A document that the mix takes in part keeps its first words, joined by one space. Rows with one
    doc_id and size stand for each other. Rows without words or id are not drawn.
    """
    draws = mix(docs, **options).draws
    # Once for each doc_id, size and copy: a repeated row brings its own draw.
    picks = draws.groupBy("doc_id", "size", "shard", "turn", "words").agg(F.min("seat").alias("seat"))
    named = docs.withColumn("_size", word_count(F.col("text")))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), 0), 1, F.col("words").cast("int")), " ")
    joined = named.join(picks.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & (F.col("_size") == F.col("size")))
    text = F.when(F.col("words") < F.col("_size"), cut).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
