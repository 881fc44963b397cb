"""Packing documents into sequences of one length by non-negative least squares.

Documents are cut into full sequences and a rest. Short combinations of rest lengths that fill a
sequence are enumerated; non-negative least squares fits their repeat counts to the histogram of
lengths; the counts are rounded down. What is left over is laid on one line, greedily, and cut at
the sequence length. The histogram and the fit are bounded by the sequence length, so the driver
holds a plan whose size does not follow the data; pieces find their place by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import new_path
from . import tokenizer

UNIT = 4  # lengths are matched in units of this many tokens; a sequence's padding stays below depth * UNIT
DEPTH = 3


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[free] = 0
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            sub = a[:, at]
            fit = np.linalg.lstsq(sub.T @ sub, sub.T @ b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[at] = fit
                break
            down = fit <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - fit[down], 1e-300))
            x[at] += step * (fit - x[at])
            free[at[down & (x[at] <= 1e-9)]] = False
            if not free.any():
                x[:] = 0
                break
            if step == 0 and not (down & (x[at] <= 1e-9)).any():
                return np.maximum(x, 0)
    return x


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most `depth` lengths that add up to `units`, longest first."""
    found: list[tuple[int, ...]] = []

    def grow(have: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(have)
        elif len(have) < depth:
            for k in range(min(left, have[-1] if have else left), 0, -1):
                if k * (depth - len(have)) >= left:
                    grow((*have, k), left - k)

    grow((), units)
    return found


@dataclass
class Plan:
    """fits: (length, first, n, sequence, offset); rest: (length, first, line) from which rank on, and where."""

    fits: list[tuple[int, int, int, int, int]]
    rest: list[tuple[int, int, int]]
    first_rest_sequence: int


def plan(histogram: dict[int, int], size: int, unit: int = UNIT, depth: int = DEPTH) -> Plan:
    unit = unit if size % unit == 0 else 1
    used = dict.fromkeys(histogram, 0)
    buckets = [[n for n in range((k - 1) * unit + 1, k * unit + 1) if n in histogram] for k in range(size // unit + 1)]
    have = np.array([sum(histogram[n] for n in b) for b in buckets], float)
    have[-1] = 0  # full pieces stand alone and need no fit
    combos = [c for c in combinations(size // unit, depth) if len(c) > 1 and all(have[k] for k in c)]
    fits: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def take(bucket: int, n: int) -> list[tuple[int, int, int]]:
        """The next n pieces of a bucket as (length, first rank, count)."""
        runs = []
        for length in buckets[bucket]:
            k = min(n, histogram[length] - used[length])
            if k:
                runs.append((length, used[length], k))
                used[length] += k
                n -= k
        return runs

    def place(combo: tuple[int, ...], n: int) -> None:
        nonlocal sequence
        slots = [take(k, n) for k in combo]
        while n:
            k = min(s[0][2] for s in slots)
            offset = 0
            for s in slots:
                length, first, count = s[0]
                fits.append((length, first, k, sequence, offset))
                offset += length
                s[0] = (length, first + k, count - k)
                if count == k:
                    s.pop(0)
            sequence += k
            n -= k

    left = lambda k: sum(histogram[n] - used[n] for n in buckets[k])
    place((len(buckets) - 1,), left(len(buckets) - 1))
    if combos:
        a = np.zeros((len(have), len(combos)))
        for j, c in enumerate(combos):
            np.add.at(a[:, j], list(c), 1)
        repeats = nnls(a, have)
        for j in np.argsort(-repeats, kind="stable"):
            c = combos[j]
            n = min(int(repeats[j] + 1e-9), *(left(k) // c.count(k) for k in set(c)))
            if n > 0:
                place(c, n)
        for k in range(1, len(buckets) - 1):  # greedy pairs of what rounding left
            other = len(buckets) - 1 - k
            n = left(k) // 2 if k == other else min(left(k), left(other)) if k < other else 0
            if n:
                place((k, other), n)
    rest, line = [], 0
    for length in sorted(histogram, reverse=True):
        if histogram[length] > used[length]:
            rest.append((length, used[length], line))
            line += (histogram[length] - used[length]) * length
    return Plan(fits, rest, sequence)


def pieces(docs: DataFrame, path: str, size: int, end_id: int, keep: tuple[str, ...]) -> DataFrame:
    """Full sequences and rests of every document: (keep, start, length, doc_tokens, ids, part, rank).

    `ids` is little-endian, 32 bits an id; `rank` counts pieces of one length inside the task. Written
    once, so that ranks stay what they are.
    """
    source = docs.select(*keep, F.col("text").alias("_text"))
    extra = "start long, length int, doc_tokens long, ids binary, part int, rank long"
    schema = T.StructType([*source.drop("_text").schema.fields, *T._parse_datatype_string(extra).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * (size + 1)
        part = TaskContext.get().partitionId()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                rows, starts, lengths, totals, blobs, ranks = [], [], [], [], [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    got = np.append(tokenizer.ids(text, path), np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(got), size):
                        blob = got[at:at + size]
                        rows.append(i)
                        starts.append(at)
                        lengths.append(len(blob))
                        totals.append(len(got))
                        blobs.append(blob.tobytes())
                        ranks.append(seen[len(blob)])
                        seen[len(blob)] += 1
                own = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(totals, pa.int64()),
                     pa.array(blobs, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(ranks, pa.int64())],
                    names=schema.names)

    target = new_path(docs.sparkSession, "pieces")
    source.mapInArrow(cut, schema).write.option("compression", "zstd").parquet(target)
    return docs.sparkSession.read.schema(schema).parquet(target)


def pack(
    docs: DataFrame, path: str = tokenizer.DEFAULT, size: int = 1024, end_id: int = 0, keep: tuple[str, ...] = ("doc_id",),
    payload: Callable[[Column], Column] = lambda ids: ids,
) -> DataFrame:
    """One row a piece: `keep`, start, length, doc_tokens, sequence_id, offset and payload(ids).

    A document's tokens are its ids and `end_id`; null counts as empty, so every row has a token.
    Each id lies in exactly one piece, and the pieces of a sequence follow each other without a gap.
    Repeated rows are packed each for itself. A `keep` column must not be named like a result.
    """
    spark = docs.sparkSession
    cut = pieces(docs, path, size, end_id, keep)
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most `size` rows, whatever the data.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
    # The rests are the last ranks of their lengths: from one task's rank on, a bound for each length.
    rest = spark.createDataFrame(found.rest, "length int, first long, line long")
    bounds = offsets.join(F.broadcast(rest), "length").filter("first >= base and first < base + n").select(
        "length", F.col("part").alias("from_part"), (F.col("first") - F.col("base")).alias("from_rank"), "first", "line")
    bounded = cut.join(F.broadcast(bounds), "length", "left").withColumn("is_rest", F.coalesce(
        (F.col("part") > F.col("from_part")) | ((F.col("part") == F.col("from_part")) & (F.col("rank") >= F.col("from_rank"))), F.lit(False)))
    own = [*keep, "start", "length", "doc_tokens"]
    fits = spark.createDataFrame(found.fits, "fit_length int, fit_first long, fit_n long, fit_sequence long, offset int")
    whole = bounded.filter("not is_rest").select(*own, "part", "rank", payload(F.col("ids")).alias("payload"))
    whole = whole.join(offsets, ["part", "length"]).withColumn("at", F.col("base") + F.col("rank"))
    # The plan has a bounded number of rows: at most `size` lengths, each in few combinations.
    whole = whole.join(F.broadcast(fits), (F.col("length") == F.col("fit_length")) & (F.col("at") >= F.col("fit_first"))
                       & (F.col("at") < F.col("fit_first") + F.col("fit_n")))
    whole = whole.select(*own, (F.col("fit_sequence") + F.col("at") - F.col("fit_first")).alias("sequence_id"),
                         F.col("offset").cast("long").alias("offset"), "payload")
    left = bounded.filter("is_rest").join(offsets.drop("n"), ["part", "length"]).withColumn(
        "at", F.col("line") + (F.col("base") + F.col("rank") - F.col("first")) * F.col("length"))
    room = F.lit(size) - F.col("at") % size
    both = F.when(room < F.col("length"), F.array(
        F.struct(F.lit(0).cast("long").alias("skip"), room.cast("long").alias("n")),
        F.struct(room.cast("long").alias("skip"), (F.col("length") - room).cast("long").alias("n")),
    )).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("skip"), F.col("length").cast("long").alias("n"))))
    left = left.withColumn("c", F.explode(both)).select(
        *keep, (F.col("start") + F.col("c.skip")).alias("start"), F.col("c.n").cast("int").alias("length"), "doc_tokens",
        (F.lit(found.first_rest_sequence) + F.floor((F.col("at") + F.col("c.skip")) / size)).cast("long").alias("sequence_id"),
        ((F.col("at") + F.col("c.skip")) % size).cast("long").alias("offset"),
        payload(F.substring("ids", (4 * F.col("c.skip") + 1).cast("int"), (4 * F.col("c.n")).cast("int"))).alias("payload"))
    return whole.unionByName(left).withColumn("length", F.col("length").cast("long"))
