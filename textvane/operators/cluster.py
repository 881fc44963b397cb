"""K-means with automatic K, and scores from the clusters of an observation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import DISTANCES, dot, total
from .skew import grid

MAX_K = 10
FITS_AT_ONCE = 4
# Up to this many numbers the centres travel inside the plan.
LITERAL_NUMBERS = 200_000
# Fixed value: how far a cluster's share of label 1 is kept from 0 and 1.
SHARE_EDGE = 0.0001


def deviations(points: DataFrame) -> np.ndarray:
    """Population standard deviation per dimension, 0 taken as 1; as wide as one vector."""
    long = points.select(F.posexplode("vector").alias("pos", "x"))
    rows = long.groupBy("pos").agg(F.stddev_pop("x").alias("s")).collect()
    out = np.ones(len(rows))
    for r in rows:
        out[r["pos"]] = r["s"] or 1.0
    return out


def whiten(points: DataFrame) -> DataFrame:
    """(id, vector) with every dimension divided by its deviation."""
    scale = F.lit(deviations(points))
    return points.withColumn("vector", F.zip_with("vector", scale, lambda x, s: x / s))


def mean_centroids(points: DataFrame, by: str) -> DataFrame:
    """(cluster, center): the mean vector of each group; dimensions are averaged in parallel."""
    long = points.select(F.col(by).alias("cluster"), F.posexplode("vector").alias("pos", "x"))
    means = long.groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    # A group here is one vector.
    return means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("center"))


def _distances(points: DataFrame, centroids: list, distance: str) -> Column:
    """array<struct<distance, cluster>> of a point to every centre, as one expression."""
    measure = DISTANCES[distance]
    return F.array(
        *[F.struct(measure(F.col("vector"), F.lit(np.array(c["center"]))).alias("distance"), F.lit(c["cluster"]).alias("cluster")) for c in centroids]
    )


def nearest_centroid(points: DataFrame, centroids: DataFrame, distance: str = "euclidean") -> DataFrame:
    """(id, cluster, distance): the nearest centre, of equal ones the first cluster.

    A counted set of centres becomes an expression, so points are not moved; a larger one is
    met block by block and reduced by a minimum that combines before the shuffle.
    """
    width = centroids.select(F.max(F.size("center"))).first()[0] or 1
    head = centroids.orderBy("cluster").limit(LITERAL_NUMBERS // width + 1).collect()
    if len(head) <= LITERAL_NUMBERS // width:
        near = F.array_min(_distances(points, head, distance))
        return points.select("id", near.alias("near")).select("id", "near.cluster", "near.distance")
    pairs = grid(centroids.select("cluster", "center"), points.select("id", "vector"), literal_rows=100)
    measured = pairs.select("id", F.struct(DISTANCES[distance](F.col("vector"), F.col("center")).alias("distance"), "cluster").alias("near"))
    return measured.groupBy("id").agg(F.min("near").alias("near")).select("id", "near.cluster", "near.distance")


def cluster_label_share(members: DataFrame) -> DataFrame:
    """(cluster, n, n_1, share): members, those of label 1, and their share kept off 0 and 1."""
    counted = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_1")
    )
    share = F.least(F.lit(1 - SHARE_EDGE), F.greatest(F.lit(SHARE_EDGE), F.col("n_1") / F.col("n")))
    return counted.withColumn("share", share)


def cluster_score(points: DataFrame, model: DataFrame, distance: str = "euclidean", normalise: bool = False) -> DataFrame:
    """(id, score) from (cluster, center, share): shares weighed by 1 - distance / all distances.

    The weights sum to K - 1, unless `normalise` scales them to 1. A point on all centres at once has
    weight 1 for each; where all weights are 0 (one cluster), the scaled score is the mean share. K is bounded by the search
    for K, and checked here.
    """
    rows = model.orderBy("cluster").limit(LITERAL_NUMBERS).collect()
    width = len(rows[0]["center"]) if rows else 1
    if len(rows) * width > LITERAL_NUMBERS:
        return _cluster_score_by_rows(points, model, distance, normalise)
    measured = points.select(
        "id", F.transform(_distances(points, rows, distance), lambda d: d["distance"]).alias("d")
    )
    away = F.transform("d", lambda d: 1 - F.coalesce(F.try_divide(d, total(F.col("d"))), F.lit(0.0)))
    score = total(F.zip_with(away, F.lit(np.array([r["share"] for r in rows])), lambda a, s: a * s))
    if normalise:
        score = F.coalesce(F.try_divide(score, total(away)), F.lit(float(np.mean([r["share"] for r in rows])) if rows else None))
    return measured.select("id", score.alias("score"))


def _cluster_score_by_rows(points: DataFrame, model: DataFrame, distance: str, normalise: bool) -> DataFrame:
    pairs = grid(model.select("cluster", "center", "share"), points.select("id", "vector"), literal_rows=100)
    d = DISTANCES[distance](F.col("vector"), F.col("center"))
    sums = pairs.select("id", "share", d.alias("d")).groupBy("id").agg(
        F.sum("share").alias("s"), F.sum(F.col("share") * F.col("d")).alias("sd"), F.sum("d").alias("all"), F.count(F.lit(1)).alias("k")
    )
    score = F.col("s") - F.coalesce(F.try_divide("sd", "all"), F.lit(0.0))
    if normalise:
        score = F.coalesce(F.try_divide(score, F.when(F.col("all") > 0, F.col("k") - 1).otherwise(F.col("k"))), F.col("s") / F.col("k"))
    return sums.select("id", score.alias("score"))


def dispersion(members: DataFrame) -> DataFrame:
    """(k, dispersion): summed squared distance to the mean of one's cluster, for (k, cluster, vector).

    From sums and sums of squares per dimension, so no point meets its mean in a join.
    """
    long = members.select("k", "cluster", F.posexplode("vector").alias("pos", "x"))
    per = long.groupBy("k", "cluster", "pos").agg(F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("k").agg(F.sum(F.col("v") * F.col("n")).alias("dispersion"))


def one_direction(points: DataFrame) -> tuple[list[float], float]:
    """The unit vector nearest to all of (id, vector) by angle, and the summed cosine distance to it.

    Of unit vectors that sum to s, the mean direction is s / |s| and the distances add up to n - |s|.
    """
    units = points.select(F.posexplode(_unit(F.col("vector"))).alias("pos", "x"))
    sums = units.groupBy("pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()  # one vector
    along = np.array([r["s"] for r in sums])
    size = float(np.linalg.norm(along))
    return (along / size if size else along).tolist(), max(0.0, (sums[0]["n"] if sums else 0) - size)


def _unit(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / size)


def select_k(dispersions: DataFrame, dimensions: int, max_k: int | None = None) -> DataFrame:
    """(k, dispersion, alpha, f, chosen) for the dispersions of K = 1, 2, ...

    f(1) = 1; f(K) compares a dispersion with the one before; the least f is chosen, and the
    largest K never unless it is the only one.
    """
    # One row for each K tried: the recurrence runs over one small array.
    asked = dispersions if max_k is None else dispersions.filter(F.col("k") <= max_k)
    listed = asked.agg(F.array_sort(F.collect_list(F.struct("k", F.col("dispersion").alias("s")))).alias("l"))
    empty = F.expr("cast(array() as array<struct<k:int,s:double,alpha:double,f:double>>)")

    def step(acc: Column, row: Column) -> Column:
        before = F.try_element_at(acc, F.lit(-1))
        fresh = before.isNull() | (before["s"] == 0)
        alpha = (
            F.when(fresh, 0.0)
            .when(row["k"] == 2, 1 - 3 / (4 * F.lit(float(dimensions))))
            .otherwise(before["alpha"] + (1 - before["alpha"]) / 6)
        )
        f = F.when(fresh, 1.0).otherwise(F.try_divide(row["s"], alpha * before["s"]))
        return F.concat(acc, F.array(F.struct(row["k"].cast("int").alias("k"), row["s"].alias("s"), alpha.alias("alpha"), f.alias("f"))))

    out = listed.select(F.aggregate("l", empty, step).alias("r"))
    eligible = F.when(F.size("r") == 1, F.col("r")).otherwise(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(1))))
    best = F.array_min(F.transform(eligible, lambda r: F.struct(r["f"].alias("f"), r["k"].alias("k"))))
    return out.select(F.explode("r").alias("r"), best["k"].alias("best")).select(
        "r.k", F.col("r.s").alias("dispersion"), "r.alpha", "r.f", (F.col("r.k") == F.col("best")).alias("chosen")
    )


def fit_kmeans(points: DataFrame, max_k: int = MAX_K, seed: int = 42, distance: str = "euclidean"):
    """(table of select_k, centroids of the chosen K as (cluster, center)) of (id, vector).

    K = 1 is the mean of all points, by cosine their mean direction; larger ones are fitted by Spark ML, a few at a
    time. Dispersions are summed squared distances, or summed cosine distances, for every K alike. Zero vectors have
    no direction and take no part in a fit by cosine.
    """
    spark = points.sparkSession
    if distance == "cosine":
        points = points.filter(dot(F.col("vector"), F.col("vector")) > 0)
    vectors = points.select(array_to_vector(F.col("vector")).alias("features")).persist()
    try:
        n = vectors.count()
        top = min(max_k, n)
        if not n:
            raise ValueError("no points to cluster")
        if distance == "cosine":
            center, spread = one_direction(points)
        else:
            center = mean_centroids(points.withColumn("all", F.lit(0)), "all").first()["center"]
            spread = dispersion(points.select(F.lit(1).alias("k"), F.lit(0).alias("cluster"), "vector")).first()["dispersion"]
        found, centers = [(1, float(spread))], {1: [list(center)]}

        def fit(k: int):
            model = KMeans(k=k, seed=seed, distanceMeasure=distance).fit(vectors)
            return k, float(model.summary.trainingCost), [c.tolist() for c in model.clusterCenters()]

        # The fits are independent and many of their jobs are short: some run side by side.
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            for k, cost, center in pool.map(inheritable_thread_target(spark)(fit), range(2, top + 1)):
                found.append((k, cost))
                centers[k] = center
    finally:
        vectors.unpersist()
    table = select_k(spark.createDataFrame(found, "k int, dispersion double"), len(centers[1][0]), max_k)
    k = table.filter("chosen").first()["k"]
    return table, spark.createDataFrame(list(enumerate(centers[k])), "cluster int, center array<double>")
