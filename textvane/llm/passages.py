"""Repeated passages of `window` words or more: what the automaton and the suffix array have in common.

Every window of words has an anchor, the k-gram of smallest hash in it, so equal windows have equal
anchors wherever they stand. Windows that follow each other with the same anchor make a stretch.
Anchors that occur in one text only cannot lie in a repeated window and drop out early; the
stretches of the others meet by anchor, in shards of bounded size, and an index of the shard says for
each window which document has it first. An anchor whose different stretches alone would fill a shard
is heavy: its windows meet by their own digests instead, under a combining minimum, so no task holds
them together. Equal texts are one class and only their first is indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import small_batches, stage
from . import buckets, semijoin, words


@dataclass(frozen=True)
class Shape:
    """A window has `window` words, an anchor `anchor` words, a shard about `shard_words` words."""

    window: int
    anchor: int
    shard_words: int


# (stretches as runs of word numbers, place of the anchor in each, anchor, doc_id) -> of each window the first document.
Index = Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int], pa.ListArray]


def anchors(w: words.Words, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of a row: its first word, its anchor's first word, and the anchor's hash."""
    k, span = shape.anchor, shape.window - shape.anchor + 1
    total = len(w.hash) - shape.window + 1
    none = np.zeros(0, np.int64)
    if total <= 0:
        return none, none, np.zeros(0, np.uint64)
    n = len(w.hash) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[i:i + n]
    h = words.mix(h)
    # Sliding minimum by doubling, with its place; the leftmost of equal hashes wins.
    best, at, width = h, np.arange(n), 1
    while 2 * width <= span:
        best, at = _smaller(best, at, width)
        width *= 2
    if width < span:
        best, at = _smaller(best, at, span - width)
    first = np.flatnonzero(w.row[:total] == w.row[shape.window - 1:])
    return first, at[first], best[first]


def _smaller(best: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = best[:-shift], best[shift:]
    take = right < left
    return np.where(take, right, left), np.where(take, at[shift:], at[:-shift])


def _name(w: words.Words, row: int, which: int = 0) -> int:
    """Half of a row's 128-bit digest, from either word hash."""
    h = (w.hash2 if which else w.hash)[w.of(row)]
    return words.digest(words.mix(h + np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)), which)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, a, b, sha): words, 128-bit digest and checksum of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(1)):
                w = words.split(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first), pa.int64()),
                    *(pa.array([_name(w, i, which) for i in range(hi - lo)], pa.int64()) for which in (0, 1)),
                    pa.array([hashlib.sha256(w.text(w.first[i], w.first[i + 1])).hexdigest() for i in range(hi - lo)], pa.string()),
                ], names=["doc_id", "n_words", "a", "b", "sha"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        measure, "doc_id long, n_words long, a long, b long, sha string")


def _shared_anchors(docs: DataFrame, shape: Shape, n_buckets: int) -> DataFrame:
    """(key, val): anchors of two or more different texts, and those texts' digests."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for lo, hi in words.chunks(batch.column(0)):
                    w = words.split(batch.column(0).slice(lo, hi - lo))
                    first, at, key = anchors(w, shape)
                    bound = np.searchsorted(first, w.first)
                    for i in np.flatnonzero(np.diff(bound)):
                        name = _name(w, i)
                        if name in seen:
                            continue
                        seen.add(name)
                        keys = np.unique(key[bound[i]:bound[i + 1]])
                        yield keys, np.full(len(keys), name, np.int64).view(np.uint64)

        yield from buckets.rows(pairs(), n_buckets)

    return buckets.shared(docs.select("text").mapInArrow(emit, buckets.SCHEMA))


STRETCH = "anchor long, doc_id long, first long, at int, windows int, p1 long, p2 long, passage binary"


def _stretches(chosen: DataFrame, shape: Shape) -> DataFrame:
    """Stretches of (doc_id, a, keys, text) whose anchor is among `keys`."""

    step = np.uint64(0xD1B54A32D192ED03)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                names = part.column(1).to_pylist()
                w = words.split(part.column(3))
                first, at, key = anchors(w, shape)
                row = w.row[first]
                # A repeated id may bring another text; only the one with the class's digest counts.
                right = np.array([w.first[i] < w.first[i + 1] and _name(w, i) == names[i] for i in range(part.num_rows)], bool)
                begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])) if len(at) else at
                end = np.append(begin[1:], len(at)) if len(at) else at
                lists = part.column(2)
                asked = words.mix(np.asarray(lists.flatten()).view(np.uint64)
                                  + np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets))).astype(np.uint64) * step)
                wanted = np.isin(words.mix(key[begin] + row[begin].astype(np.uint64) * step), asked) & right[row[begin]]
                begin, end = begin[wanted], end[wanted]
                s, e = first[begin], first[end - 1] + shape.window
                p1, p2 = words.spans(w, s, e)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[begin].view(np.int64)), part.column(0).take(pa.array(row[begin])), pa.array(s - w.first[row[begin]]),
                    pa.array((at[begin] - s).astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(p1), pa.array(p2),
                    pa.array([w.text(x, y) for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary()),
                ], names=["anchor", "doc_id", "first", "at", "windows", "p1", "p2", "passage"])

    return chosen.select("doc_id", "a", "keys", "text").mapInArrow(cut, STRETCH)


def _heavy_anchors(stretches: DataFrame, shape: Shape) -> DataFrame:
    """(anchor) of the anchors whose different stretches have more than `shard_words` words."""
    # Copies of one stretch are merged before they are indexed; only different ones count.
    once = stretches.select("anchor", "p1", "p2", "windows").distinct()
    return once.groupBy("anchor").agg(F.sum(F.col("windows") + shape.window).alias("n")).filter(F.col("n") > shape.shard_words).select("anchor")


def _heavy_hits(stretches: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, at): windows of `stretches`, by their first word, that a smaller doc_id has, by digests of whole windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                w = words.split(part.column(2))
                start = np.flatnonzero(w.row[:len(w.row) - shape.window + 1] == w.row[shape.window - 1:])
                row = w.row[start]
                w1, w2 = words.spans(w, start, start + shape.window)
                at = part.column(1).to_numpy()[row] + start - w.first[row]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at), pa.array(w1), pa.array(w2)],
                                                 names=["doc_id", "at", "w1", "w2"])

    windows = stage(stretches.select("doc_id", "first", F.col("passage").cast("string")).mapInArrow(
        cut, "doc_id long, at long, w1 long, w2 long"), "windows")
    # Staged, so that the join has a shuffle on both sides and a window of very many documents is split.
    least = stage(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter(
        "least < most").drop("most"), "least")
    found = windows.join(least, ["w1", "w2"]).filter("least < doc_id")
    return found.groupBy("doc_id").agg(F.collect_list("at").alias("at"))


def numbered(passages: pa.ChunkedArray) -> list[np.ndarray]:
    """The words of each passage, joined by one space, as numbers; equal words have equal numbers."""
    lists = pc.split_pattern(passages, " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    numbers = np.concatenate([x.indices.to_numpy() for x in coded.chunks] or [np.zeros(0, np.int32)])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    return np.split(numbers, ends[:-1])


def _first_documents(stretches: DataFrame, shape: Shape, index: Index) -> DataFrame:
    """(anchor, p1, p2, firsts): of each window of a different stretch the smallest doc_id that has it."""
    total = stretches.agg(F.sum(F.col("windows") + shape.window)).first()[0] or 0
    shards = max(1, -(-total // shape.shard_words))
    once = stretches.groupBy("anchor", "p1", "p2").agg(F.min("doc_id").alias("doc_id"), F.first("at").alias("at"), F.first("passage").alias("passage"))

    def search(table: pa.Table) -> pa.Table:
        found = index(numbered(table.column("passage")), table.column("at").to_numpy(), table.column("anchor").to_numpy(), table.column("doc_id").to_numpy(), shape.window)
        return table.select(["anchor", "p1", "p2"]).append_column("firsts", found)

    return once.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(
        search, "anchor long, p1 long, p2 long, firsts array<long>")


def _remove(chosen: DataFrame, window: int) -> DataFrame:
    """(doc_id, a, removed, kept_sha, spans, kept_text) of (doc_id, text, starts): what is left of each text."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                w = words.split(part.column(1))
                names, removed, shas, spans, kept_texts = [], [], [], [], []
                for i in range(part.num_rows):
                    own = w.of(i)
                    n = own.stop - own.start
                    marks = np.zeros(n + 1, np.int64)
                    starts = np.asarray(part.column(2)[i].values, np.int64)
                    starts = starts[starts + window <= n]
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, starts + window, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    left = np.flatnonzero(~gone) + own.start
                    kept = b" ".join(w.data[w.starts[j]:w.ends[j]].tobytes() for j in left)
                    # The text keeps its own spacing: only the removed words and the space after them go.
                    cuts = [(int(w.starts[own.start + x]), int(w.starts[own.start + y]) if y < n else int(w.ends[own.stop - 1]))
                            for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    kept_texts.append(_without(part.column(1)[i].as_py(), w, own, cuts))
                    names.append(_name(w, i))
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(names, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept_texts, pa.string()),
                ], names=["doc_id", "a", "removed", "kept_sha", "spans", "kept_text"])

    return chosen.select("doc_id", "text", "starts").mapInArrow(
        strip, "doc_id long, a long, removed long, kept_sha string, spans array<struct<first:long,last:long>>, kept_text string")


def _without(text: str | None, w: words.Words, own: slice, cuts: list[tuple[int, int]]) -> str:
    """The row's text without the byte ranges, which count from the chunk's start."""
    if own.stop == own.start:
        return text or ""
    raw = (text or "").encode()
    # The row's first word stands after its leading space.
    base = int(w.starts[own.start]) - (len(raw) - len(raw.lstrip()))
    out, at = [], 0
    for a, b in cuts:
        out.append(raw[at:a - base])
        at = b - base
    out.append(raw[at:])
    return b"".join(out).decode()


@dataclass
class Repeats:
    """rows: one for every row of the input; changed: (doc_id, a, kept_text) of the texts that lose words in part."""

    rows: DataFrame
    changed: DataFrame
    texts: DataFrame
    classes: DataFrame


def repeats(docs: DataFrame, shape: Shape, index: Index) -> Repeats:
    """Words of `docs` (doc_id, text) inside a window that also starts in a document with a smaller doc_id.

    rows: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (first
    and last word of each removed run; of a whole copy one span). Null texts have no words, and texts
    shorter than a window lose none. Rows with a null doc_id lose nothing and are held against nobody.
    Repeated rows of one doc_id are one document: none is smaller than the other.
    """
    with small_batches(docs.sparkSession):
        return _repeats(docs, shape, index)


def _repeats(docs: DataFrame, shape: Shape, index: Index) -> Repeats:
    texts = stage(_texts(docs), "texts")
    long_enough = (F.col("n_words") >= shape.window) & F.col("doc_id").isNotNull()
    classes = stage(texts.filter(long_enough).groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "classes")
    total = texts.agg(F.sum("n_words")).first()[0] or 0
    per_anchor = (shape.window - shape.anchor + 2) / 2
    shared = stage(_shared_anchors(docs, shape, buckets.count_for(int(total / per_anchor))), "anchors")
    wanted = stage(shared.join(classes.select(F.col("a").alias("val"), F.col("rep").alias("doc_id")), "val").groupBy("doc_id", F.col("val").alias("a")).agg(
        F.collect_list("key").alias("keys")), "wanted")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(_stretches(semijoin.matching(source, "doc_id", wanted), shape), "stretches")
    heavy = stage(_heavy_anchors(found, shape), "heavy")
    light, apart = found, None
    if not heavy.isEmpty():
        light = found.join(F.broadcast(heavy), "anchor", "left_anti")
        apart = _heavy_hits(found.join(F.broadcast(heavy), "anchor", "left_semi"), shape)
    firsts = stage(_first_documents(light, shape, index), "firsts")
    hits = light.drop("passage").join(firsts, ["anchor", "p1", "p2"]).select("doc_id", F.expr(
        "transform(filter(sequence(0, size(firsts) - 1), i -> firsts[i] < doc_id), i -> first + i)").alias("at")).filter("size(at) > 0")
    hits = hits if apart is None else hits.unionByName(apart)
    starts = stage(hits.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("starts")), "starts")
    changed = stage(_remove(semijoin.matching(source, "doc_id", starts), shape.window).dropDuplicates(["doc_id", "a"]), "changed")
    rows = texts.join(classes, ["a", "b"], "left").join(changed.drop("kept_text"), ["doc_id", "a"], "left")
    copy = long_enough & (F.col("rep") < F.col("doc_id"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_words") - 1).alias("last")))
    rows = rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"))).alias("spans"))
    return Repeats(rows, changed, texts, classes)
