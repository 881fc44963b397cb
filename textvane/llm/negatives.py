"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. For two rows with angles s and t to one of them the
triangle rule puts the cosine between cos(s + t) and cos(s - t); the best of all references, times both norms and
widened by more than any rounding, bounds the score. Rows whose bounds reach no window that an anchor still asks
for are passed over; the others get their exact integer score. Blocks of rows and of anchors are held against each
other by the ranges of their angles and norms first, and only pairs of blocks that can matter meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import grid, salted_join
from ..session import stage

# More than the rounding of four-byte cosines and sines, their products, and of arc cosines near 1.
SLACK = 1e-5
# A component is kept within this, so that it is an integer of eight bytes.
LIMIT = float(1 << 62)


@dataclass(frozen=True)
class Options:
    """`sample` bounds the rows that reference directions and first score limits are taken from."""

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50  # a negative scores between `low` and `high` hundredths of its positive
    high: int = 95
    references: int = 16
    sample: int = 4096
    rows_block: int = 8192
    anchors_block: int = 1024


def usable(table: DataFrame, o: Options = Options()) -> DataFrame:
    """(id, label, vec): integer vectors of the rows of (id, label, vector) that take part.

    Null ids, labels or vectors and null or infinite or NaN components take no part, nor do vectors of another than
    the commonest length (ties: the longer). Of rows with one id the smallest (label, vector) stays.
    """
    v = F.col("vector")
    rows = table.select(F.col("id").cast("long").alias("id"), "label", v.cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    common = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.max_by("n", F.struct("c", "n"))).first()[0]
    rows = rows.filter(F.size("vector") == F.lit(common)).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    kind = table.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            m = np.clip(np.floor(m * o.scale), -LIMIT, LIMIT).astype("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([_packed(x) for x in m], pa.binary())], names=["id", "label", "vec"])

    return stage(rows.select("id", "r.label", "r.vector").mapInArrow(encode, f"id long, label {kind}, vec binary"), "points")


def _packed(x: np.ndarray) -> bytes:
    """The numbers in the fewest bytes each that hold them, behind the number of bytes."""
    most = int(max(x.max(initial=0), -(x.min(initial=0) + 1)))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.array([np.frombuffer(x, f"<i{x[0]}", offset=1).astype(np.int64) for x in raw]).reshape(len(raw), -1) if raw else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b; what leaves eight bytes stays at their ends."""
    most = a.shape[1] * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _norms(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def _classes(points: DataFrame, o: Options) -> DataFrame:
    """(cls, label, ids, vec): different (label, vector), its smallest ids in order and the least as its name.

    Equal rows score alike, and an answer never needs more than one place behind its own length of them.
    """
    keep = max(o.positives + 1, o.negatives)
    ranked = points.withColumn("_r", F.row_number().over(Window.partitionBy("vec", "label").orderBy("id"))).filter(F.col("_r") <= keep)
    grouped = ranked.groupBy("vec", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return grouped.select(F.element_at("ids", 1).alias("cls"), "label", "ids", "vec")


def _references(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n directions of sample rows, each the farthest in angle from those before."""
    norms = _norms(sample)
    m = sample[norms > 0] / norms[norms > 0, None]
    if not len(m):
        return np.eye(1, sample.shape[1])
    chosen = [int(np.argmin(m @ m.mean(axis=0)))]
    near = m @ m[chosen[0]]
    while len(chosen) < min(n, len(m)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, m @ m[chosen[-1]])
    return m[chosen]


def _placed(classes: DataFrame, o: Options) -> tuple[DataFrame, int]:
    """`classes` with norm, cosines and sines of the reference angles, nearest reference, and a first score limit.

    `least` is the score that the last wanted positive at least has: of the rows of a bounded sample with the same
    label, so many score as much.
    """
    rows = classes.orderBy(F.xxhash64("cls"), "cls").limit(o.sample).select("cls", "label", "vec", F.size("ids").alias("copies")).collect()
    sample = _matrix(pa.array([bytes(r["vec"]) for r in rows], pa.binary()))
    refs = _references(sample, o.references)
    of_label: dict = {}
    for i, r in enumerate(rows):
        of_label.setdefault(r["label"], []).append(i)
    copies = np.array([r["copies"] for r in rows])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                m = _matrix(batch.column("vec"))
                norm = _norms(m)
                c = np.clip(np.divide(m @ refs.T, norm[:, None], out=np.zeros((len(m), len(refs))), where=norm[:, None] > 0), -1, 1)
                least = np.full(len(m), np.iinfo(np.int64).min)
                labels = batch.column("label").to_pylist()
                for label in set(labels):
                    mine = np.array([i for i, x in enumerate(labels) if x == label])
                    theirs = np.array(of_label.get(label, []), np.int64)
                    if not len(theirs) or copies[theirs].sum() <= o.positives:
                        continue
                    scores = products(m[mine], sample[theirs])
                    order = np.argsort(-scores, axis=1, kind="stable")
                    enough = np.argmax(np.cumsum(copies[theirs][order], axis=1) > o.positives, axis=1)
                    least[mine] = np.take_along_axis(scores, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
                pack = lambda x: pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(norm), pack(c), pack(np.sqrt(np.maximum(1 - c * c, 0))), pa.array(np.argmax(c, axis=1).astype(np.int32)), pa.array(least)],
                    names=["cls", "label", "ids", "vec", "norm", "cos", "sin", "cell", "least"])

    kind = classes.schema["label"].dataType.simpleString()
    schema = f"cls long, label {kind}, ids array<long>, vec binary, norm double, cos binary, sin binary, cell int, least long"
    return stage(classes.mapInArrow(place, schema), "placed"), len(refs)


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """`rows` with a block number: cells in a row up to about `size` rows share one, larger cells are cut by a hash."""
    counts = dict(rows.groupBy("cell").count().collect())  # one row a reference direction
    first, cuts, block, filled = {}, {}, 0, 0
    for cell in sorted(counts):
        if filled and filled + counts[cell] > size:
            block, filled = block + 1, 0
        first[cell], cuts[cell] = block, -(-counts[cell] // size)
        block, filled = block + cuts[cell] - 1, filled + counts[cell] if cuts[cell] == 1 else size
    if not counts:
        return rows.withColumn(name, F.lit(0))
    look = lambda d: F.create_map(*[F.lit(x) for item in d.items() for x in item])[F.col("cell")]
    return rows.withColumn(name, (look(first) + F.pmod(F.xxhash64("cls"), look(cuts))).cast("int"))


def _ranges(rows: DataFrame, name: str, refs: int, extra: list[Column]) -> DataFrame:
    """(name, low, high, norm_low, norm_high, *extra): by block the range of every reference angle and of the norms."""

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(batch.num_rows, refs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.arccos(np.clip(c, -1, 1)).astype(np.float64)), pa.list_(pa.float64())), *batch.columns[2:]],
                                             names=["block", "angles", *batch.schema.names[2:]])

    fields = rows.select(F.col(name).alias("block"), "cos", "norm", *extra)
    names = fields.columns[3:]
    schema = "block int, angles array<double>, norm double" + "".join(f", {n} {fields.schema[n].dataType.simpleString()}" for n in names)
    angles = fields.mapInArrow(widest, schema)
    each = [f(F.col("angles")[i]).alias(f"{n}{i}") for i in range(refs) for f, n in ((F.min, "l"), (F.max, "h"))]
    out = angles.groupBy("block").agg(*each, F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"),
                                      *[F.min(n).alias(n) if n.endswith("low") else F.max(n).alias(n) for n in names])
    return out.select(F.col("block").alias(name), F.array(*[f"l{i}" for i in range(refs)]).alias(f"{name}_l"), F.array(*[f"h{i}" for i in range(refs)]).alias(f"{name}_h"),
                      F.col("norm_low").alias(f"{name}_nl"), F.col("norm_high").alias(f"{name}_nh"), *names)


def _meeting(anchors: DataFrame, rows: DataFrame, refs: int) -> DataFrame:
    """(a_block, r_block) of blocks some of whose scores may lie in what the anchors ask for (ask_low, ask_high)."""
    few = _ranges(anchors, "a_block", refs, [F.col("ask_low"), F.col("ask_high")])
    many = _ranges(rows, "r_block", refs, [])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: np.asarray(batch.column(n).flatten()).reshape(batch.num_rows, refs)
            flat = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
            al, ah, rl, rh = get("a_block_l"), get("a_block_h"), get("r_block_l"), get("r_block_h")
            apart = np.maximum(np.maximum(rl - ah, al - rh), 0).max(axis=1)
            # The widest angle two members can have: by every reference at most their sum, or the rest of the circle.
            wide = np.where(al + rl >= np.pi, 2 * np.pi - al - rl, np.where(ah + rh <= np.pi, ah + rh, np.pi)).min(axis=1)
            top, bottom = np.cos(apart) + 4 * SLACK, np.cos(wide) - 4 * SLACK
            big, small = flat("a_block_nh") * flat("r_block_nh"), flat("a_block_nl") * flat("r_block_nl")
            high, low = np.where(top > 0, top * big, top * small), np.where(bottom < 0, bottom * big, bottom * small)
            keep = (high >= flat("ask_low")) & (low <= flat("ask_high"))
            yield batch.select(["a_block", "r_block"]).filter(pa.array(keep))

    return stage(grid(few, many).mapInArrow(check, "a_block int, r_block int"), "meeting")


def _bounds(a: dict, x: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper score bounds of all anchors a with all rows x."""
    low = np.full((len(a["cos"]), len(x["cos"])), -1, np.float32)
    high = np.ones_like(low)
    for r in range(a["cos"].shape[1]):
        both = np.outer(a["cos"][:, r], x["cos"][:, r])
        cross = np.outer(a["sin"][:, r], x["sin"][:, r])
        np.minimum(high, both + cross, out=high)
        np.maximum(low, both - cross, out=low)
    scale = np.outer(a["norm"], x["norm"])
    return (low - SLACK) * scale, (high + SLACK) * scale


def _side(table: pa.Table, refs: int) -> dict:
    pick = lambda n: np.frombuffer(b"".join(table.column(n).to_pylist()), "<f4").reshape(table.num_rows, refs)
    labels = table.column("label").combine_chunks()
    return {"cls": table.column("cls").to_numpy(), "label": labels, "m": _matrix(table.column("vec")), "norm": table.column("norm").to_numpy(), "cos": pick("cos"), "sin": pick("sin")}


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal labels of both columns."""
    both = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b)]).dictionary_encode().indices.to_numpy()
    return both[:len(a)], both[len(a):]


def _hits(anchors: DataFrame, rows: DataFrame, same: bool, k: int, refs: int) -> DataFrame:
    """(cls, want, id, score): of each anchor and each of its windows `asks` the best k ids of a row block.

    `same` takes rows of the anchor's label, else of all other labels. Higher scores first, ties to smaller ids.
    """
    pairs = _meeting(anchors, rows, refs)
    left = anchors.join(pairs, "a_block").select("a_block", "r_block", "cls", "label", "vec", "norm", "cos", "sin", "asks")
    right = rows.join(pairs, "r_block").select("a_block", "r_block", "cls", "label", "ids", "vec", "norm", "cos", "sin")

    def meet(anchor: pa.Table, row: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if anchor.num_rows and row.num_rows:
            every, x = _side(anchor, refs), _side(row, refs)
            code, codes = _codes(every["label"], x["label"])
            ids = row.column("ids").to_pylist()
            asks = anchor.column("asks").to_pylist()
            for lo in range(0, len(code), 128):
                part = slice(lo, lo + 128)
                a = {n: every[n][part] for n in ("cls", "m", "norm", "cos", "sin")}
                low, high = _bounds(a, x)
                right_label = (code[part, None] == codes) == same
                for i in range(len(a["cls"])):
                    able = np.flatnonzero(right_label[i])
                    windows = [(w["want"], w["low"], w["high"]) for w in asks[lo + i]]
                    reached = np.zeros(len(able), bool)
                    for _, least, most in windows:
                        reached |= (high[i, able] >= least) & (low[i, able] <= most)
                    able = able[reached]
                    if not len(able):
                        continue
                    score = products(a["m"][i:i + 1], x["m"][able])[0]
                    for want, least, most in windows:
                        inside = np.flatnonzero((score >= least) & (score <= most))
                        if len(inside) > k:
                            bar = np.partition(score[inside], len(inside) - k)[len(inside) - k]
                            inside = inside[score[inside] >= bar]
                        found = sorted((-int(score[j]), n) for j in inside.tolist() for n in ids[able[j]])[:k]
                        for s, n in found:
                            for column, value in zip(out, (int(a["cls"][i]), want, n, -s), strict=True):
                                column.append(value)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("cls", "want", "id", "score"), out, strict=True)})

    met = left.groupBy("a_block", "r_block").cogroup(right.groupBy("a_block", "r_block"))
    found = met.applyInArrow(meet, "cls long, want long, id long, score long")
    best = F.row_number().over(Window.partitionBy("cls", "want").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", best).filter(F.col("place") <= k)


def _asking(asks: Column) -> list[Column]:
    return [asks.alias("asks"), F.array_min(F.transform(asks, lambda w: w["low"])).cast("double").alias("ask_low"),
            F.array_max(F.transform(asks, lambda w: w["high"])).cast("double").alias("ask_high")]


def _window(want: Column, low: Column, high: Column) -> Column:
    return F.struct(want.cast("long").alias("want"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def mine(table: DataFrame, anchor: Column, o: Options = Options()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (id, label, vector).

    Rows for which `anchor` (over id) holds are anchors. An anchor's positives are its best `o.positives` other rows
    of its label, a positive's negatives the best `o.negatives` rows of other labels whose score is between o.low and
    o.high hundredths of the positive's. Scores are inner products of floor(scale * component); higher first, ties
    to smaller ids. `usable` says which rows take part. Results beyond eight bytes stay at the ends of their range.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    points = usable(table, o)
    if points.isEmpty():
        return table.sparkSession.createDataFrame([], schema)
    classes = stage(_classes(points, o), "classes")
    name = F.xxhash64("vec", "label").alias("h")
    asked = points.filter(anchor).select("id", "vec", "label", name)
    asked = stage(salted_join(asked, classes.select("cls", "vec", "label", name), ["h", "vec", "label"], "h", ["id"]).select(F.col("id").alias("anchor_id"), "cls"), "asked")
    placed, refs = _placed(classes, o)
    rows = _blocks(placed, "r_block", o.rows_block)
    anchors = stage(_blocks(placed.join(asked.select("cls").distinct(), "cls", "left_semi"), "a_block", o.anchors_block), "anchors")
    most = F.lit((1 << 63) - 1)
    upward = F.array(_window(F.lit(0), F.col("least"), most))
    best = stage(_hits(anchors.select("*", *_asking(upward)), rows, True, o.positives + 1, refs), "positives")
    # score * 100 may leave eight bytes, so windows are worked out in decimals.
    wide = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(wide * o.low / 100), F.floor(wide * o.high / 100)
    asks = best.select("cls", _window(F.col("score"), low, high).alias("w")).filter("w.low <= w.high").groupBy("cls").agg(F.collect_set("w").alias("w"))
    seekers = anchors.join(asks, "cls").select("*", *_asking(F.col("w")))
    worse = _hits(seekers, rows, False, o.negatives, refs)
    lists = best.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("good"))
    bad = worse.groupBy("cls").agg(F.collect_list(F.struct(F.col("want"), F.col("place"), F.col("id"), F.col("score"))).alias("bad"))
    each = salted_join(asked, lists.join(bad, "cls"), ["cls"], "cls", ["anchor_id"])
    others = F.slice(F.filter("good", lambda g: g["id"] != F.col("anchor_id")), 1, o.positives)
    each = each.select("anchor_id", F.explode(others).alias("g"), "bad").select("anchor_id", "g", F.explode("bad").alias("b")).filter("b.want = g.score")
    return each.select("anchor_id", F.col("g.id").alias("positive_id"), F.col("b.place").cast("int").alias("rank"), F.col("b.id").alias("negative_id"),
                       F.col("g.score").alias("positive_score"), F.col("b.score").alias("negative_score"))
