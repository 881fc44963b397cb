"""Queries over vectors: distances, clusters, nets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import cosine, doubles, euclidean
from ..operators import cluster as K, network as N
from ..session import new_path
from .roles import table


def _points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("vector"), "label")


def _centroids(spark, sf_dir) -> DataFrame:
    return K.mean_centroids(_points(spark, sf_dir), "label")


def vector_distance(spark, sf_dir):
    """Every embedding against the mean vector of its own label, by both distances."""
    own = _points(spark, sf_dir).join(_centroids(spark, sf_dir).withColumnRenamed("cluster", "label"), "label")
    a, b = F.col("vector"), F.col("center")
    return own.select(F.col("id").alias("vec_id"), F.round(euclidean(a, b), 6).alias("euclidean"), F.round(cosine(a, b), 6).alias("cosine"))


def whiten(spark, sf_dir):
    white = K.whiten(_points(spark, sf_dir).select("id", "vector"))
    return white.select(F.col("id").alias("vec_id"), F.posexplode("vector").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def nearest_centroid(spark, sf_dir):
    near = K.nearest_centroid(_points(spark, sf_dir), _centroids(spark, sf_dir))
    return near.select(F.col("id").alias("vec_id"), "cluster", F.round("distance", 6).alias("distance"))


def _shares(spark, sf_dir) -> DataFrame:
    near = nearest_centroid(spark, sf_dir).select(F.col("vec_id").alias("id"), "cluster")
    truth = _points(spark, sf_dir).select("id", F.when(F.col("label") > 4, 1).otherwise(0).alias("label"))
    return K.cluster_label_share(near.join(truth, "id"))


def cluster_label_share(spark, sf_dir):
    return _shares(spark, sf_dir).select("cluster", "n", "n_1", F.round("share", 6).alias("share"))


def cluster_score(spark, sf_dir):
    model = _centroids(spark, sf_dir).join(_shares(spark, sf_dir), "cluster")
    points = _points(spark, sf_dir)
    plain = K.cluster_score(points, model).select("id", F.round("score", 6).alias("score"))
    scaled = K.cluster_score(points, model, normalise=True).select("id", F.round("score", 6).alias("normalised"))
    return plain.join(scaled, "id").select(F.col("id").alias("vec_id"), "score", "normalised")


def select_k(spark, sf_dir):
    """K by the dispersions of a given clustering: labels from K - 1 on share a cluster."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(K.MAX_K))).alias("k")
    members = _points(spark, sf_dir).select(ks, "label", "vector").select("k", F.least("label", F.col("k") - 1).alias("cluster"), "vector")
    out = K.select_k(K.dispersion(members), 64)
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("dispersion", "alpha", "f")], "chosen")


def kmeans(spark, sf_dir):
    found, centroids = K.fit_kmeans(_points(spark, sf_dir))
    return K.nearest_centroid(_points(spark, sf_dir), centroids).select(
        F.col("id").alias("vec_id"), "cluster", F.round("distance", 6).alias("distance")
    )


def given_net(spark, width: int = 64, hidden: int = 32) -> DataFrame:
    """A net whose weights follow a rule."""
    def weights(n):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.pmod(F.col("node") * 7 + j * 13, F.lit(11)) / 10 - 0.5)

    node = F.col("id").cast("int").alias("node")
    first = spark.range(hidden).select(F.lit(0).alias("layer"), node).withColumn("weights", weights(width))
    last = spark.range(1).select(F.lit(1).alias("layer"), node).withColumn("weights", weights(hidden))
    return first.unionByName(last).select("layer", "node", (F.col("node") / 100).alias("bias"), "weights")


def mlp_forward(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumnRenamed("vector", "input")
    out = N.forward(rows, given_net(spark))
    return out.select(F.col("id").alias("vec_id"), F.round(F.col("output")[0], 6).alias("p"))


def _net_rows(spark, sf_dir) -> DataFrame:
    return _points(spark, sf_dir).select("id", F.col("vector").alias("input"), F.when(F.col("label") > 4, 1).otherwise(0).alias("label"))


def _trained(spark, sf_dir) -> DataFrame:
    rows = _net_rows(spark, sf_dir).select("input", F.array(F.col("label").cast("double")).alias("output"))
    return N.train(rows, passes=20).model


def mlp_train(spark, sf_dir):
    out = N.forward(_net_rows(spark, sf_dir), _trained(spark, sf_dir))
    return out.select(F.col("id").alias("vec_id"), "label", F.round(F.col("output")[0], 6).alias("p"))


def model_table(spark, sf_dir):
    """A trained net written as rows and read back."""
    path = new_path(spark, "net")
    _trained(spark, sf_dir).write.json(path)
    back = spark.read.schema(N.MODEL_SCHEMA).json(path)
    return back.select("layer", "node", F.round("bias", 6).alias("bias"), F.size("weights").alias("n_weights"))


def dense_from_sparse(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    dense = N.dense_from_sparse(e, "user_id", "event_type", "value")
    return dense.select("user_id", "idx", "event_type", F.round("value", 6).alias("value"))


QUERIES = {
    "vector_distance": vector_distance,
    "whiten": whiten,
    "nearest_centroid": nearest_centroid,
    "cluster_label_share": cluster_label_share,
    "cluster_score": cluster_score,
    "select_k": select_k,
    "kmeans": kmeans,
    "mlp_forward": mlp_forward,
    "mlp_train": mlp_train,
    "model_table": model_table,
    "dense_from_sparse": dense_from_sparse,
}

_LONG = """long as materialized (select vec_id, label, pos, cast(embedding[pos] as double) as x from embeddings, range(1, 65) r(pos))"""
_CENTER = """center as materialized (select label as cluster, pos, avg(x) as m from long group by all)"""
_DIST = """dist as materialized (
  select vec_id, cluster, sqrt(sum((x - m) ** 2)) as d from long join center using (pos) group by all)"""
_NEAR = """near as (
  select vec_id, cluster, d from (select *, row_number() over (partition by vec_id order by d, cluster) as rn from dist) where rn = 1)"""
_SHARE = """share as (
  select cluster, count(*) as n, count(*) filter (where label > 4) as n_1,
         least(0.9999::double, greatest(0.0001::double, count(*) filter (where label > 4) / count(*))) as share
  from near join embeddings using (vec_id) group by cluster)"""
SQL_NEAREST = f"with {_LONG}, {_CENTER}, {_DIST}, {_NEAR} select vec_id, cluster, round(d, 6) as distance from near"

SQL = {
    "vector_distance": f"""
with {_LONG}, {_CENTER}
select vec_id, round(sqrt(sum((x - m) ** 2)), 6) as euclidean,
       round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as cosine
from long join center on cluster = label and long.pos = center.pos group by vec_id""",
    "whiten": f"""
with {_LONG}, dev as (select pos, stddev_pop(x) as s from long group by pos)
select vec_id, cast(pos - 1 as integer) as pos, round(x / case when s = 0 then 1 else s end, 6) as x from long join dev using (pos)""",
    "nearest_centroid": SQL_NEAREST,
    "cluster_label_share": f"""
with {_LONG}, {_CENTER}, {_DIST}, {_NEAR}, {_SHARE} select cluster, n, n_1, round(share, 6) as share from share""",
    "cluster_score": f"""
with {_LONG}, {_CENTER}, {_DIST}, {_NEAR}, {_SHARE},
t as (select vec_id, sum(d) as total, count(*) as k from dist group by vec_id)
select vec_id, round(sum((1 - d / total) * share), 6) as score, round(sum((1 - d / total) * share) / any_value(k - 1), 6) as normalised
from dist join t using (vec_id) join share using (cluster) group by vec_id""",
    "select_k": f"""
with {_LONG}, member as (select k, least(label, k - 1) as cluster, pos, x from long, range(1, 11) r(k)),
s as (select k, sum(v) as s from (select k, var_pop(x) * count(*) as v from member group by k, cluster, pos) group by k),
a as (select k, s, lag(s) over (order by k) as before,
             case when k = 1 then 0 else 1 - (3.0::double / 256) * (5.0::double / 6) ** (k - 2) end as alpha from s),
f as (select k, s, alpha, case when k = 1 then 1.0::double else s / (alpha * before) end as f from a)
select cast(k as integer) as k, round(s, 6) as dispersion, round(alpha, 6) as alpha, round(f, 6) as f,
       k = (select k from f where k < 10 order by f, k limit 1) as chosen from f""",
    "mlp_forward": f"""
with {_LONG},
hidden as (
  select vec_id, node, 1 / (1 + exp(-(node / 100 + sum(x * (((node * 7 + (pos - 1) * 13) % 11) / 10 - 0.5::double))))) as h
  from long, range(0, 32) n(node) group by vec_id, node)
select vec_id, round(1 / (1 + exp(-sum(h * (((node * 13) % 11) / 10 - 0.5::double)))), 6) as p from hidden group by vec_id""",
    "dense_from_sparse": """
with keys as (select event_type, row_number() over (order by event_type) - 1 as idx from (select distinct event_type from events)),
sums as (select user_id, event_type, sum(value) as value from events group by all)
select u.user_id, cast(idx as integer) as idx, k.event_type, round(coalesce(value, 0), 6) as value
from (select distinct user_id from events) u cross join keys k
left join sums s on s.user_id = u.user_id and s.event_type = k.event_type""",
}
