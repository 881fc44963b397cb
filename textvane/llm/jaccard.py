"""Documents whose sets of word n-grams overlap: a Jaccard join over count vectors.

The tokens of a set are hashed into groups and the counts per group are the set's point. For two
sets the overlap is at most the sum of the smaller counts, so a link needs a small city-block
distance. The index is an R-tree in two tiers. Its top tier is the shuffle: two linked sets
differ in fewer tokens than there are parts of the token space, so one part is the same in both,
and that part's content names the tile where both meet. Inside a tile a packed R-tree over the
folded points bounds the overlap, sketches that widen with the sets hold what it finds, and pairs
that survive are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, small_batches, stage
from . import buckets, semijoin, words
from .components import components

FIRST_LEVEL = 9  # the largest set of the first size level; each level doubles it
LEAF = 16
TILE_ROWS = 2048
SKETCH = 64
# Tokens a group of a sketch holds on average, at most: what unlike sets of any size share by chance stays well below a link.
SKETCH_SHARE = 4
# The largest count of a group: a sketch keeps two counts in a byte.
MOST = 15
BATCH_COUNTS = 1 << 20
_PART = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Rule:
    """Sets of `n`-word shingles are linked when den * overlap >= num * union."""

    n: int = 5
    num: int = 80
    den: int = 100

    def apart(self, total: int) -> int:
        """How many tokens two linked sets with `total` tokens together can differ in."""
        return total * (self.den - self.num) // (self.den + self.num)

    def linked(self, overlap: int, total: int) -> bool:
        return self.den * overlap >= self.num * (total - overlap)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of its n-word shingles, A-Z in lower case.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    return [keys for keys, _ in _shingles(words.split(column, lower=True), n, False)]


def _shingles(w: words.Words, n: int, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each row and, if asked for, the second hash of each."""
    at, key = words.windows(w, n)
    second = words.windows(w, n, 1)[1] if both else key
    bound = np.searchsorted(w.row[at], np.arange(len(w.first)))
    sizes = np.diff(w.first)
    for i, size in enumerate(sizes):
        own, other = key[bound[i]:bound[i + 1]], second[bound[i]:bound[i + 1]]
        if 0 < size < n:
            own, other = (_whole(h[w.of(i)]) for h in (w.hash, w.hash2 if both else w.hash))
        if both:
            own, first = np.unique(own, return_index=True)
            yield own, other[first]
        else:
            own = np.unique(own)
            yield own, own


def _whole(hashes: np.ndarray) -> np.ndarray:
    h = np.full(1, len(hashes), np.uint64)
    for x in hashes:
        h = h * np.uint64(0xD6E8FEB86659FD93) + x
    return words.mix(h)


def _level(n: int) -> int:
    level, top = 0, FIRST_LEVEL
    while n > top:
        level, top = level + 1, 2 * top
    return level


def tile_keys(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """The tiles of one set: a key for each part of the token space, at the levels of its partners' sizes.

    A level has one part more than linked sets of its sizes can differ in tokens, so one part is
    the same in both. It may be empty in both; sets with as many empty parts as that needs also have
    the keys of their smallest tokens, of which linked sets share one.
    """
    n = len(tokens)
    most = n * rule.den // rule.num
    out = []
    for level in range(_level(n), _level(most) + 1) if n else ():
        top = FIRST_LEVEL << level
        apart = rule.apart(n + min(top, most))
        if not apart:
            continue
        parts = rule.apart(2 * top) + 1
        place = ((words.mix(tokens ^ _PART) >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        used, first = np.unique(place[order], return_index=True)
        sums = np.add.reduceat(words.mix(tokens + np.uint64(level + 1))[order], first)
        out.append(words.mix(sums + used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)))
        if parts - len(used) >= parts - apart:
            least = n - -(-n * rule.num // rule.den) + 1
            by_rank = np.sort(words.mix(tokens))[:least]
            out.append(words.mix(by_rank ^ np.uint64(0xA0761D6478BD642F + level)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts per group in a byte each; groups are a power of two, 16 at least and half the tokens.

    More groups are taken where a count would be above MOST, so that no count is ever cut.
    """
    groups = 16
    while groups < len(tokens) // 2:
        groups *= 2
    place = words.mix(tokens ^ np.uint64(7))
    while True:
        counts = np.bincount((place % np.uint64(groups)).astype(np.int64), minlength=groups)
        if counts.max() <= MOST:
            return counts.astype(np.uint8)
        groups *= 2


def _fold(p: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups: group numbers are remainders, so multiples of `groups` fall together."""
    return p.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def sketch(p: np.ndarray) -> np.ndarray:
    """The point folded to SKETCH groups, or to as many as hold SKETCH_SHARE tokens each and no count above MOST."""
    groups = min(SKETCH, len(p))
    while groups < len(p) and groups * SKETCH_SHARE < int(p.sum(dtype=np.int64)):
        groups *= 2
    while (folded := _fold(p, groups)).max() > MOST:
        groups *= 2
    return folded.astype(np.uint8)


def pack(counts: np.ndarray) -> bytes:
    """Counts up to MOST, two in a byte."""
    return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def unpack(packed: np.ndarray) -> np.ndarray:
    """The counts in the last axis of packed bytes."""
    return np.stack([packed & MOST, packed >> 4], axis=-1).reshape(*packed.shape[:-1], -1)


def bound(p: np.ndarray, q: np.ndarray) -> int:
    """At most so many tokens are in both sets."""
    groups = min(len(p), len(q))
    return int(np.minimum(_fold(p, groups), _fold(q, groups)).sum())


class Sketches:
    """The packed sketches of a tile, and which of them allow a link with one of them."""

    def __init__(self, packed: list[np.ndarray], sizes: np.ndarray) -> None:
        self.packed, self.sizes = packed, sizes
        self.lengths = np.array([2 * len(x) for x in packed])

    def held(self, i: int, at: np.ndarray, rule: Rule) -> np.ndarray:
        """Those of `at` whose bound with sketch i allows a link."""
        own, kept = unpack(self.packed[i]), []
        for length in np.unique(self.lengths[at]):
            groups = min(len(own), int(length))
            same = at[self.lengths[at] == length]
            step = max(1, BATCH_COUNTS // int(length))
            for k in range(0, len(same), step):
                part = same[k:k + step]
                counts = unpack(np.stack([self.packed[j] for j in part]))
                if groups < length:
                    counts = counts.reshape(len(part), -1, groups).sum(axis=1, dtype=np.int32)
                overlap = np.minimum(counts, _fold(own, groups).astype(counts.dtype)).sum(axis=1, dtype=np.int64)
                kept.append(part[rule.den * overlap >= rule.num * (self.sizes[part] + self.sizes[i] - overlap)])
        return np.concatenate(kept) if kept else at


class Tree:
    """A packed R-tree: leaves of neighbouring points with the box around each, and boxes around those."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # Sort-tile packing: by size, then inside runs by the coordinate that varies most.
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), LEAF * LEAF):
            run = order[k:k + LEAF * LEAF]
            axis = int(np.argmax(points[run].max(axis=0) - points[run].min(axis=0)))
            order[k:k + LEAF * LEAF] = run[np.argsort(points[run, axis], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        starts = np.arange(0, len(order), LEAF)
        self.tops = np.maximum.reduceat(self.points, starts, axis=0)
        self.low, self.high = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        self.up = np.arange(0, len(starts), LEAF)
        self.up_tops = np.maximum.reduceat(self.tops, self.up, axis=0)

    def search(self, p: np.ndarray, size: int, rule: Rule) -> np.ndarray:
        """Numbers of the points whose bound with `p` allows a link."""
        # den * o >= num * (size + s - o): the overlap needed grows with the partner's size s.
        need = lambda s: rule.num * (size + s)
        able = rule.den + rule.num
        least = -(-rule.num * size // rule.den)
        groups = np.flatnonzero(able * np.minimum(self.up_tops, p).sum(axis=1) >= need(least))
        leaves = (groups[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.tops)]
        leaves = leaves[(able * np.minimum(self.tops[leaves], p).sum(axis=1) >= need(np.maximum(self.low[leaves], least)))
                        & (self.high[leaves] >= least)]
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        at = at[able * np.minimum(self.points[at], p).sum(axis=1) >= need(self.sizes[at])]
        return self.order[at]


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, a, b): size and 128-bit digest of every row's set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(1)):
                w = words.split(batch.column(1).slice(lo, hi - lo), lower=True)
                found = [(len(s), words.digest(s), words.digest(t, 1)) for s, t in _shingles(w, rule.n, True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3)),
                ], names=["doc_id", "n", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, n long, a long, b long")


def _tiles(docs: DataFrame, rule: Rule, n_buckets: int) -> DataFrame:
    """(key, val): tiles that hold different sets, and the digests of those sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies inside a task meet nobody new

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for lo, hi in words.chunks(batch.column(0)):
                    for s in shingle_sets(batch.column(0).slice(lo, hi - lo), rule.n):
                        name = words.digest(s)
                        if len(s) and name not in seen:
                            seen.add(name)
                            keys = tile_keys(s, rule)
                            yield keys, np.full(len(keys), name, np.int64).view(np.uint64)

        yield from buckets.rows(pairs(), n_buckets)

    return buckets.shared(docs.select("text").mapInArrow(emit, buckets.SCHEMA))


def _members(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, rule: Rule) -> DataFrame:
    """(id, size, tokens, point, sketch) of the sets `wanted` (doc_id, a), read from those documents; id is the set's a, the sketch packed.

    Sets only move for documents that have one more than once (`repeated`).
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column(2), rule.n)
                # A repeated id may bring another text; only the one with the set's digest counts.
                right = [i for i, a in enumerate(part.column(1).to_pylist()) if len(sets[i]) and words.digest(sets[i]) == a]
                points = [point(sets[i]) for i in right]
                yield pa.RecordBatch.from_arrays([
                    part.column(1).take(pa.array(right, pa.int64())), pa.array([len(sets[i]) for i in right], pa.int64()),
                    pa.array([sets[i].tobytes() for i in right], pa.binary()), pa.array([p.tobytes() for p in points], pa.binary()),
                    pa.array([pack(sketch(p)) for p in points], pa.binary()),
                ], names=["id", "size", "tokens", "point", "sketch"])

    schema = "id long, size long, tokens binary, point binary, sketch binary"
    read = lambda rows: semijoin.matching(rows, "doc_id", wanted).select("doc_id", "a", "text").mapInArrow(build, schema)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if repeated.isEmpty():
        return read(source)
    again = read(semijoin.matching(source, "doc_id", repeated)).dropDuplicates(["id"])
    return read(semijoin.without(source, "doc_id", repeated)).unionByName(again)


def _of_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The members that are in a pair."""
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    return semijoin.matching(members, "id", ids.withColumnRenamed("a", "id"))


def _bounded(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose points allow a link; only points travel."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint8) for k in (2, 3))
                right.append(rule.linked(bound(p, q), batch.column(4)[i].as_py()))
            yield batch.select([0, 1]).filter(pa.array(right, pa.bool_()))

    members = _of_pairs(members, pairs)
    side = lambda c: members.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("point").alias(f"p{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb", F.col("na") + F.col("nb")).mapInArrow(hold, "a long, b long")


def _verified(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are links, counted on their sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                right.append(rule.linked(len(np.intersect1d(s, t, assume_unique=True)), len(s) + len(t)))
            yield batch.select([0, 1]).filter(pa.array(right, pa.bool_()))

    members = _of_pairs(members, pairs)
    side = lambda c: members.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(count, "a long, b long")


def _cells(tiles: DataFrame) -> DataFrame:
    """Tiles cut into blocks of about TILE_ROWS rows; every two blocks of a tile meet in one cell."""
    counted = tiles.withColumn("blocks", F.ceil(F.col("members") / TILE_ROWS).cast("int"))
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    return counted.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "block", "other", "id", "component")


def _mixed(tiles: DataFrame) -> DataFrame:
    """(key, members) of the tiles of (key, id, component) with two or more components, of tiles with the same members one."""
    told = tiles.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("lo != hi")
    return told.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members")


def _tree_join(cells: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): members of one cell in different components whose sketches allow a link."""

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        group = table.column("component").to_numpy()
        sizes = table.column("size").to_numpy()
        block = table.column("block").to_numpy()
        between = block != table.column("other").to_numpy()
        packed = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
        sketches = Sketches(packed, sizes)
        groups = min(SKETCH, int(sketches.lengths.min()))
        points = np.stack([_fold(unpack(p), groups) for p in packed])
        tree = Tree(points, sizes)
        left, right = [], []
        for i in range(len(ids)):
            at = tree.search(points[i], int(sizes[i]), rule)
            at = at[(ids[at] < ids[i]) & (group[at] != group[i]) & ((block[at] != block[i]) | ~between[i])]
            at = sketches.held(i, at, rule)
            left.append(ids[at])
            right.append(np.full(len(at), ids[i]))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(join(left), pa.int64()), "b": pa.array(join(right), pa.int64())})

    return cells.groupBy("cell").applyInArrow(search, "a long, b long")


def linked_classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. Null, empty and
    blank texts have no shingles and are linked with nothing. Equal sets are one class; no pair
    of copies is ever made. Repeated rows each come out; rows with a null doc_id are linked to nothing
    and have a null component_id.

    First each tile ties its members to the one that meets most others, and the ties are verified.
    What is then in one component needs no more work; members of one tile in different components
    go through the R-tree over sketches of their points, and every pair that it and the points themselves
    cannot exclude is verified. Rows of one doc_id with different texts are one document with several sets.
    """
    with small_batches(docs.sparkSession):
        return _linked_classes(docs, rule)


def _linked_classes(docs: DataFrame, rule: Rule) -> DataFrame:
    meta = stage(_sets(docs, rule), "sets")
    full = meta.filter("n > 0 and doc_id is not null")
    classes = stage(full.groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "classes")
    # A document with several sets ties them.
    twice = full.groupBy("doc_id").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo != hi")
    tied = stage(full.join(twice, "doc_id").filter("a != lo").select(F.col("lo").alias("a"), F.col("a").alias("b")).distinct(), "tied")
    total = meta.agg(F.sum("n")).first()[0] or 0
    tiles = stage(_tiles(docs, rule, buckets.count_for(total // 3)), "tiles")
    named = stage(tiles.join(classes.select(F.col("a").alias("id")).distinct(), tiles["val"] == F.col("id")).select("key", "id"), "named")
    wanted = stage(classes.join(named.select(F.col("id").alias("a")).distinct(), "a").select(F.col("rep").alias("doc_id"), "a"), "wanted")
    discard(tiles)
    repeated = full.groupBy("doc_id", "a").count().filter("count > 1").select("doc_id").distinct()
    members = stage(_members(docs, wanted, stage(repeated, "repeated"), rule), "members")
    # How many others each member meets, over all its tiles: originals meet more than their copies do.
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("tile"))
    degree = named.join(sizes, "key").groupBy("id").agg(F.sum("tile").alias("degree"))
    centre = named.join(degree, "id").groupBy("key").agg(F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("a"))
    ties = stage(named.join(centre, "key").filter("id != a").select("a", F.col("id").alias("b")).distinct(), "ties")
    bounded = stage(_bounded(ties, members, rule), "bounded")
    links = stage(_verified(bounded, members, rule), "links")
    first = stage(components(links), "first")
    open_tiles = named.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = stage(open_tiles.join(_mixed(open_tiles), "key"), "rest")
    discard(bounded, named)
    light = members.select("id", "size", "sketch")
    near = stage(_tree_join(_cells(rest).join(light, "id"), rule).distinct().join(ties, ["a", "b"], "left_anti"), "near")
    discard(ties, rest)
    more = stage(_bounded(near, members, rule), "pairs")
    found = stage(_verified(more, members, rule), "links")
    discard(near, more, members)
    groups = stage(components(links.unionByName(found).unionByName(tied)), "components")
    # Components go by digests up to here; their name is the smallest doc_id in them.
    labelled = classes.join(groups.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = stage(labelled.join(least, "component").select("a", "b", "component_id"), "of_set")
    named_rows = meta.join(of_set, ["a", "b"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return named_rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of `docs` but those linked to a smaller doc_id; rows that share the kept id stay."""
    drop = stage(linked_classes(docs, rule).filter("component_id != doc_id").select("doc_id").distinct(), "drop")
    return semijoin.without(docs, "doc_id", drop)
