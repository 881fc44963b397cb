"""Periodic runs of words, by enumeration of maximal pairs.

Two equal stretches of a text that neither their left nor their right neighbours extend are a maximal pair.
A pair of length `l` whose starts lie `p` words apart, p <= l, covers exactly one stretch of period p that
cannot be extended: its first word is the earlier start, its length p + l. So runs are maximal pairs whose
distance fits their length, and nothing has to be extended afterwards.

Pairs come from the tree of common-prefix intervals over the sorted suffixes of a text, walked from the
leaves up. Every interval keeps the places of its suffixes, sorted, as a whole and by the word to their left;
where two children meet, each place of the smaller one asks the larger one for places near enough with another
word to the left. Pairs shorter than half the least run cannot be runs, so the tree stops at that depth.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Shape:
    """A run has at least `least` words and at least two periods."""

    least: int = 12

    @property
    def depth(self) -> int:
        """Shortest pair that can be a run: p <= l and p + l >= least."""
        return max(1, -(-self.least // 2))


def _word_ids(w: words.Words) -> np.ndarray:
    """A number for each different word; equal numbers mean equal bytes."""
    letters = w.data[~words.SPACE[w.data]]
    off = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(off), pa.py_buffer(letters)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _rows_with_repeats(ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Rows in which some n words in a row may come twice (by hash: none is missed)."""
    total = len(ids) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    each = words.mix(ids.astype(np.uint64) + np.uint64(1))
    h = words.mix(row[:total].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + each[i:i + total]
    h = h[row[:total] == row[n - 1:]]
    at = row[:total][row[:total] == row[n - 1:]]
    order = np.argsort(h)
    twice = h[order][1:] == h[order][:-1]
    return np.unique(at[order[1:][twice]])


def _ranks(ids: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ; rows never mix."""
    n = len(ids)
    key = row * (ids.max() + 1) + ids
    active, levels, h = np.arange(n), [], 1
    rank = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        active, key = active[order], key[order]
        old = rank[active]
        starts_old = np.concatenate([[True], old[1:] != old[:-1]])
        starts_new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(active))
        base = np.maximum.accumulate(np.where(starts_old, place, 0))
        first = np.maximum.accumulate(np.where(starts_new, place, 0))
        rank = rank.copy()
        rank[active] = old + first - base
        levels.append(rank)
        # Suffixes alone in their group are in place for good.
        ends_new = np.concatenate([starts_new[1:], [True]])
        active = active[~(starts_new & ends_new)]
        if not len(active):
            return levels
        after = active + h
        inside = after < n
        inside[inside] = row[after[inside]] == row[active[inside]]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[after[inside]] + 1
        key = rank[active] * (n + 1) + second
        h *= 2


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at `a` and `b` (different ones) have in common at their start."""
    n = len(levels[0])
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        out[same] += 1 << k
    return out


def _near(places: list[int], own: list[int], lo: int, hi: int, lo_own: int, hi_own: int) -> Iterator[int]:
    """Members of places[lo:hi] that are not in own[lo_own:hi_own], a part of it, by halving."""
    if hi - lo == hi_own - lo_own:
        return
    if lo_own == hi_own:
        yield from places[lo:hi]
        return
    mid = (lo + hi) // 2
    cut = bisect_left(own, places[mid], lo_own, hi_own)
    yield from _near(places, own, lo, mid, lo_own, cut)
    yield from _near(places, own, mid, hi, cut, hi_own)


class _Node:
    """Places of the suffixes below an interval, as a whole and by the word to their left."""

    def __init__(self, place: int, left: int):
        self.all = [place]
        self.by_left = {left: [place]}

    def pairs(self, place: int, left: int, reach: int) -> Iterator[int]:
        lo, hi = bisect_left(self.all, place - reach), bisect_right(self.all, place + reach)
        if lo == hi:
            return
        own = self.by_left.get(left)
        if own is None:
            yield from self.all[lo:hi]
        else:
            yield from _near(self.all, own, lo, hi, bisect_left(own, place - reach), bisect_right(own, place + reach))

    def add(self, place: int, left: int) -> None:
        insort(self.all, place)
        insort(self.by_left.setdefault(left, []), place)


def _meet(a: _Node, b: _Node, depth: int, least: int, out: list[tuple[int, int, int]]) -> _Node:
    """Both children's places in one node; their maximal pairs of `depth` words that are runs go to `out`."""
    small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
    members = [(place, left) for left, places in small.by_left.items() for place in places]
    for place, left in members:
        for other in large.pairs(place, left, depth):
            period = abs(other - place)
            if period + depth >= least:
                out.append((min(place, other), period + depth, period))
    for place, left in members:
        large.add(place, left)
    return large


def _walk(suffixes: list[int], lefts: list[int], common: list[int], floor: int, least: int, out: list[tuple[int, int, int]]) -> None:
    """The interval tree over sorted suffixes, common[k] being what suffixes k and k + 1 share; leaves first."""
    open_: list[tuple[int, _Node]] = []
    for k, (place, left) in enumerate(zip(suffixes, lefts, strict=True)):
        node = _Node(place, left)
        depth = common[k] if k < len(common) else floor - 1
        while open_ and open_[-1][0] >= depth:
            above, other = open_.pop()
            node = _meet(other, node, above, least, out)
            if above == depth:
                break
        if depth >= floor:
            open_.append((depth, node))


def runs(w: words.Words, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run in the rows of `w`, starts counted over all words, by start and period."""
    none = np.zeros(0, np.int64)
    if not len(w.starts):
        return none, none, none
    every = _word_ids(w)
    rows = _rows_with_repeats(every, w.row, shape.depth)
    if not len(rows):
        return none, none, none
    at = np.flatnonzero(np.isin(w.row, rows))
    row, ids = w.row[at], every[at]
    # Numbers of words are made dense again, so that keys of a row and a word stay small.
    ids = np.unique(ids, return_inverse=True)[1]
    levels = _ranks(ids, np.searchsorted(rows, row))
    order = np.empty(len(ids), np.int64)
    order[levels[-1]] = np.arange(len(ids))
    common = np.zeros(len(order) - 1, np.int64)
    known = next((levels[k] for k in range(len(levels) - 1, -1, -1) if 1 << k <= shape.depth))
    same = np.flatnonzero(known[order[:-1]] == known[order[1:]])
    common[same] = _common(levels, order[same], order[same + 1])
    left = np.full(len(ids), -1, np.int64)
    left[1:][row[1:] == row[:-1]] = ids[:-1][row[1:] == row[:-1]]
    found: list[tuple[int, int, int]] = []
    deep = common >= shape.depth
    edge = np.diff(np.concatenate([[0], deep.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # suffixes first..last share enough words
    if len(first):
        # Blocks whose closest places are farther apart than their longest common prefix hold no run.
        size = last - first + 1
        block = np.repeat(np.arange(len(first)), size)
        places = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
        sorted_ = places[np.lexsort((places, block))]
        gap = np.diff(sorted_)
        gap[block[1:] != block[:-1]] = len(ids) + 1
        inner = np.cumsum(size) - size
        closest = np.minimum.reduceat(np.append(gap, len(ids) + 1), inner)
        longest = np.maximum.reduceat(np.append(common, 0), np.stack([first, last], axis=1).ravel())[::2]
        for k in np.flatnonzero(closest <= longest):
            part = order[first[k]:last[k] + 1]
            _walk(part.tolist(), left[part].tolist(), common[first[k]:last[k]].tolist(), shape.depth, shape.least, found)
    if not found:
        return none, none, none
    start, length, period = np.array(found, np.int64).T
    # A stretch of period q has every multiple of q up to half its length as a period too; the smallest counts.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return at[start[order]], length[order], period[order]


def _joined(w: words.Words, keep: np.ndarray) -> pa.Array:
    """Of every row the words marked in `keep`, joined by one space."""
    kept = np.flatnonzero(keep)
    mark = np.zeros(len(w.data) + 1, np.int8)
    mark[w.starts[kept]] += 1
    mark[w.ends[kept]] -= 1
    mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
    data = w.data.copy()
    gap = w.ends[kept[:-1]][w.row[kept[:-1]] == w.row[kept[1:]]] if len(kept) else kept
    mask[gap] = True
    data[gap] = 0x20
    lengths = np.zeros(len(w.first) - 1, np.int64)
    np.add.at(lengths, w.row[kept], w.ends[kept] - w.starts[kept])
    np.add.at(lengths, w.row[np.searchsorted(w.ends, gap)], 1)
    off = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[mask])).cast(pa.string())


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs and its text without what they repeat.

    A run is a stretch of words with smallest period q, of at least `shape.least` words and two periods, that
    neither neighbour extends; `runs` lists (start, length, period) by start and period, words counted from 0.
    A word is dropped from `collapsed` if it lies in any run behind that run's first q words; the others are
    joined by one space. A null or empty text has no words, no runs and an empty `collapsed`. Rows are judged
    one by one: repeated rows and null keys come out as often as they come in. Other columns are not read.
    """

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(1)):
                w = words.split(batch.column(1).slice(lo, hi - lo), hashes=False)
                start, length, period = runs(w, shape)
                drop = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                row = w.row[start]
                lists = pa.StructArray.from_arrays([pa.array(start - w.first[row]), pa.array(length), pa.array(period)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32()), lists),
                    _joined(w, np.cumsum(drop[:-1]) == 0),
                ], names=["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(mine, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("key", key)


def with_tandems(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text by the checksum of its id repeats a stretch of its words up to its end.

    With h the unsigned CRC-32 of the decimal id and g = floor(h / 10), texts with h % 10 = 0 become their words,
    each word i from a = g % n on replaced by word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))
    w = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    chosen = F.col("h") % 10 == 0
    rows = rows.withColumn("w", F.when(chosen, w)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    tandem = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, tandem).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of `find_runs`.

    The run named is the longest, ties to the smaller start, then the smaller period; nulls where there is none.
    """
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("first", first)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.s").alias("start"), (-F.col("first.l")).alias("length"),
        F.col("first.p").alias("period"), F.expr("(-first.l * 1000) div first.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
