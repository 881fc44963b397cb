"""Approximate nearest neighbours by NN-descent.

A neighbour graph starts from the nearest rows inside the leaves of random hyperplane trees and is made
better by joins of neighbours of neighbours: every row brings its neighbours, and the rows it is a
neighbour of, together, and each of them keeps whoever is nearer than its farthest so far. Queries walk the
graph greedily: the nearest rows found are expanded until none of them is new.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage

NEIGHBOURS = "array<struct<d:double,id:long>>"


@dataclass(frozen=True)
class Options:
    """sample bounds the rows that the trees are fitted on; every row is indexed and searched."""

    degree: int = 32
    trees: int = 4
    leaf: int = 384
    sample: int = 4096
    rounds: int = 5  # with 4, recall at ten was 0.99 on 10,256 rows
    settled: float = 0.005  # a round that changes a smaller part of the graph is the last
    pool: int = 192
    seed: int = 0


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec): vectors without null, infinite or NaN parts, not zero, of the commonest length.

    Rows with a null key drop out; of rows with one key the smallest vector stays.
    """
    v = F.col("v")
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0.0))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.max_by("n", F.struct("c", "n"))).first()[0]
    rows = rows.filter(F.size("v") == F.lit(common)).groupBy("id").agg(F.min("v").alias("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m.astype("<f8")], pa.binary()),
                                              pa.array(_shrink(m), pa.binary())], names=["id", "exact", "vec"])

    return stage(rows.mapInArrow(encode, "id long, exact binary, vec binary"), "vectors")


def _shrink(m: np.ndarray) -> list[bytes]:
    """Vectors of four-byte components behind a factor of eight bytes: what the graph is built on.

    The factor is a power of two, so single-precision columns lose nothing and larger values do not overflow.
    """
    factor = np.exp2(np.floor(np.log2(np.abs(m).max(axis=1, initial=0.0))))
    parts = (m / factor[:, None]).astype("<f4")
    return [f.tobytes() + x.tobytes() for f, x in zip(factor.astype("<f8"), parts, strict=True)]


def _widen(column: pa.Array) -> np.ndarray:
    """The vectors of `_shrink`."""
    raw = _vectors(column, np.int8)
    if not raw.size:
        return np.zeros((len(raw), 0))
    return np.ascontiguousarray(raw[:, :8]).view("<f8") * np.ascontiguousarray(raw[:, 8:]).view("<f4")


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def _distances(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    squares = np.einsum("ij,ij->i", m, m)
    return np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * m @ m.T, 0))


def _trees(points: DataFrame, o: Options) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hyperplanes of balanced trees over a bounded sample: by tree the normals and offsets, level by level."""
    rows = points.orderBy(F.xxhash64("id", F.lit(o.seed))).limit(o.sample).select("vec").collect()
    n = points.count()
    sample = _widen(pa.array([bytes(r["vec"]) for r in rows], pa.binary()))
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / o.leaf)))), int(np.log2(max(1, len(sample) / 16)))))
    rng = np.random.Generator(np.random.PCG64(o.seed))
    out = []
    for _ in range(o.trees):
        normals, offsets = np.zeros(((1 << depth) - 1, sample.shape[1])), np.zeros((1 << depth) - 1)
        place = np.zeros(len(sample), np.int64)
        for node in range((1 << depth) - 1):
            own = sample[place == node]
            if len(own) > 1:
                a, b = rng.choice(len(own), 2, replace=False)
                normals[node] = own[a] - own[b] + 1e-9 * rng.standard_normal(sample.shape[1])
            else:
                normals[node] = rng.standard_normal(sample.shape[1])
            side = own @ normals[node]
            offsets[node] = np.median(side) if len(side) else 0.0
            place[place == node] = 2 * node + 1 + (side > offsets[node])
        out.append((normals, offsets))
    return out


def _leaves(points: DataFrame, trees: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(tree, leaf, id, vec) of every row in every tree."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _widen(batch.column(1))
            for t, (normals, offsets) in enumerate(trees):
                at = np.zeros(len(m), np.int64)
                for _ in range(int(np.log2(len(normals) + 1))):
                    at = 2 * at + 1 + (np.einsum("ij,ij->i", m, normals[at]) > offsets[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(at), *batch.columns], names=["tree", "leaf", "id", "vec"])

    return points.select("id", "vec").mapInArrow(descend, "tree int, leaf long, id long, vec binary")


def _first_graph(points: DataFrame, o: Options) -> DataFrame:
    """(id, d, other): nearest rows inside each leaf; leaves over twice the size are cut by a hash."""
    leaves = _leaves(points, _trees(points, o))
    sizes = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * o.leaf)).alias("cuts"))
    cells = leaves.join(sizes, ["tree", "leaf"]).withColumn("cut", F.pmod(F.xxhash64("id", "tree"), "cuts"))

    def near(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        m = _widen(table.column("vec").combine_chunks())
        d = _distances(m)
        np.fill_diagonal(d, np.inf)
        k = min(o.degree, len(ids) - 1)
        at = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        return pa.table({"id": np.repeat(ids, k), "d": np.take_along_axis(d, at, axis=1).ravel(), "other": ids[at].ravel()})

    return cells.groupBy("tree", "leaf", "cut").applyInArrow(near, "id long, d double, other long")


def _best(pairs: DataFrame, degree: int) -> DataFrame:
    """(id, near): of each row its `degree` nearest, nearest first, from (id, d, other, fresh).

    One shuffle by id serves the removal of repeats, the ranking and the lists.
    """
    once = pairs.repartition("id").groupBy("id", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).filter(F.col("_r") <= degree)
    return ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", F.col("other").alias("id"), "fresh"))).alias("near"))


def _descend(graph: DataFrame, points: DataFrame, o: Options) -> DataFrame:
    """(id, d, other): pairs met at a common neighbour that are nearer than what one of them has.

    Pairs whose both edges were there in an earlier round have met before and are passed over.
    """
    back = graph.select(F.col("id").alias("member"), F.explode("near").alias("n")).select(F.col("n.id").alias("centre"), "member", "n.fresh")
    # A row that very many have as neighbour gets more cells; each holds all its own neighbours and a part of the others.
    cuts = back.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / (2 * o.degree)).cast("int").alias("cuts"))
    met = back.join(cuts, "centre").select("centre", F.pmod(F.xxhash64("member"), "cuts").cast("int").alias("cut"), "member", "fresh")
    own = graph.withColumnRenamed("id", "centre").join(cuts, "centre", "left").select(
        "centre", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)).alias("cut"), "near").select(
        "centre", "cut", F.explode("near").alias("n")).select("centre", "cut", F.col("n.id").alias("member"), "n.fresh")
    last = F.element_at("near", -1)["d"]
    far = graph.select("id", F.when(F.size("near") >= o.degree, last).otherwise(F.lit(float("inf"))).alias("far"))
    known = points.select("id", "vec").join(far, "id").withColumnRenamed("id", "member")
    members = met.unionByName(own).repartition("member").groupBy("member", "centre", "cut").agg(F.max("fresh").alias("fresh"))
    cells = members.join(known, "member").groupBy("centre", "cut").agg(
        F.collect_list("member").alias("ids"), F.collect_list("far").alias("far"), F.collect_list("fresh").alias("fresh"),
        F.collect_list("vec").alias("vecs")).filter(F.exists("fresh", lambda x: x))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                ids, far = (np.asarray(batch.column(i).flatten()) for i in (0, 1))
                fresh = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                m = _widen(batch.column(3).flatten())
                bounds = np.concatenate([[0], np.cumsum(np.diff(np.asarray(batch.column(0).offsets)))])
                a, b, d = [], [], []
                for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                    dist = _distances(m[s:e])
                    np.fill_diagonal(dist, np.inf)
                    i, j = np.nonzero((dist < far[s:e, None]) & (fresh[s:e, None] | fresh[s:e]))
                    a.append(ids[s + i])
                    b.append(ids[s + j])
                    d.append(dist[i, j])
                a, b, d = (np.concatenate(x) if x else np.zeros(0) for x in (a, b, d))
                _, first = np.unique(np.stack([a, b]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a[first], pa.int64()), pa.array(d[first], pa.float64()), pa.array(b[first], pa.int64())], names=["id", "d", "other"])

    return cells.select("ids", "far", "fresh", "vecs").mapInArrow(meet, "id long, d double, other long")


def build(points: DataFrame, o: Options = Options()) -> DataFrame:
    """The neighbour graph (id, near) of `points`, rounds until few neighbours change.

    An edge is fresh in the round after it was found.
    Distances in it are those of shrunk vectors; `search` scores with the originals.
    """
    graph = stage(_best(_first_graph(points, o).withColumn("fresh", F.lit(True)), o.degree), "graph")
    for _ in range(o.rounds):
        now = graph.select("id", F.explode("near").alias("n")).select("id", "n.d", F.col("n.id").alias("other"), F.lit(False).alias("fresh"))
        found = _descend(graph, points, o).withColumn("fresh", F.lit(True))
        graph = stage(_best(now.unionByName(found), o.degree), "graph")
        new, edges = graph.agg(F.sum(F.size(F.filter("near", lambda n: n["fresh"]))), F.sum(F.size("near"))).first()
        if (new or 0) <= o.settled * (edges or 1):
            break
    return graph


def _scored(pairs: DataFrame, points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id) with the exact Euclidean distance d in double precision."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _vectors(batch.column(2), "<f8"), _vectors(batch.column(3), "<f8")
            d = np.sqrt(((a - b) ** 2).sum(axis=1)) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], names=["query", "id", "d"])

    rows = pairs.join(points.select("id", F.col("exact").alias("to")), "id").join(queries.select(F.col("id").alias("query"), F.col("exact").alias("from")), "query")
    return rows.select("query", "id", "from", "to").mapInArrow(score, "query long, id long, d double")


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, o: Options = Options()) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query, a row of the graph, its k nearest others found.

    Nearest first, ties to the smaller id. A walk ends when the `pool` nearest rows found are all expanded.
    """
    order = Window.partitionBy("query").orderBy("d", "id")

    def nearest_of(rows: DataFrame) -> DataFrame:
        # What falls out of the pool can never come back: its last place only gets nearer.
        return stage(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= o.pool), "pool")

    start = graph.join(queries.select("id"), "id").select(F.col("id").alias("query"), F.explode("near").alias("n")).select("query", F.col("n.id").alias("id")).distinct()
    pool = nearest_of(_scored(start, points, queries).withColumn("done", F.lit(False)))
    while not (front := pool.filter(~F.col("done")).select("query", "id")).isEmpty():
        reached = front.join(graph, "id").select("query", F.explode("near").alias("n")).select("query", F.col("n.id").alias("id")).filter("id != query").distinct()
        new = _scored(reached.join(pool.select("query", "id"), ["query", "id"], "left_anti"), points, queries).withColumn("done", F.lit(False))
        pool = nearest_of(pool.select("query", "id", "d", F.lit(True).alias("done")).unionByName(new))
    return pool.filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))


def _copies(points: DataFrame, keep: int) -> DataFrame:
    """(rep, id, exact, vec) of the `keep` smallest ids of each different vector; rep is the smallest of them."""
    ranked = points.withColumn("_r", F.row_number().over(Window.partitionBy("exact").orderBy("id"))).filter(F.col("_r") <= keep)
    return ranked.select(F.min("id").over(Window.partitionBy("exact")).alias("rep"), "id", "exact", "vec")


def nearest(table: DataFrame, every: int = 100, k: int = 10, o: Options = Options()) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by `every`, among all other rows of (vec_id, embedding).

    Equal vectors are one place in the graph, so a large group of copies cannot fill every list with itself;
    the k + 1 smallest ids of a vector are all that an answer can need of it.
    """
    spark = table.sparkSession
    points = usable(table)
    if points.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copies = stage(_copies(points, k + 1), "copies")
    places = copies.filter("id = rep").select("id", "exact", "vec")
    asked = points.filter(F.col("id") % every == 0)
    # Equal queries are searched once and share the answer.
    asked = stage(asked.select(F.col("id").alias("query_id"), "exact").join(places.select(F.col("id").alias("rep"), "exact"), "exact").drop("exact"), "asked")
    found = search(places, build(places, o), places.join(asked.select(F.col("rep").alias("id")).distinct(), "id"), k, o)
    own = asked.select("rep").distinct().select("rep", F.col("rep").alias("place"), F.lit(0.0).alias("score"))
    reached = own.unionByName(found.select(F.col("query_id").alias("rep"), F.col("vec_id").alias("place"), "score"))
    rows = reached.join(copies.select(F.col("rep").alias("place"), "id"), "place")
    answers = rows.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))
    near = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    listed = asked.join(answers, "rep").select("query_id", F.posexplode(near).alias("rank", "n"))
    return listed.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score"))
