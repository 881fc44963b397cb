import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvane.functions import loss as L, vectors as V
from textvane.operators import bayes, cluster, counts, ensemble, evaluate, linear, network

# Eight documents with known posteriors.
DOCUMENTS = [
    ("1", "alpha bravo charlie delta echo foxtrot"),
    ("1", "bravo delta foxtrot golf"),
    ("1", "alpha bravo echo hotel indigo juliet"),
    ("1", "charlie echo foxtrot kilo lima mike"),
    ("0", "alpha kilo lima mike november juliet indigo"),
    ("0", "golf hotel indigo juliet kilo mike november"),
    ("0", "bravo charlie hotel indigo kilo november"),
    ("0", "echo foxtrot indigo hotel golf juliet"),
]


def counts_of(spark, texts):
    docs = spark.createDataFrame(texts, "item bigint, text string")
    tokens = docs.select("item", F.explode(F.split("text", " ")).alias("word"))
    return tokens.groupBy("item", "word").agg(F.count(F.lit(1)).alias("n"))


def examples_of(spark, documents, user="u"):
    labels = spark.createDataFrame([(user, i, y) for i, (y, _) in enumerate(documents)], "user string, item bigint, label string")
    return bayes.training_examples(labels, counts_of(spark, [(i, t) for i, (_, t) in enumerate(documents)]))


def python_nb(train, text):
    """P(1) from the definition."""
    vocab = {w for _, t in train for w in t.split(" ")}
    scores = {}
    for y in {y for y, _ in train}:
        words = [w for label, t in train if label == y for w in t.split(" ")]
        score = math.log(sum(label == y for label, _ in train) + 0.02)
        for w in text.split(" "):
            score += math.log(words.count(w) + 0.05) - math.log(len(words) + len(vocab) * 0.05)
        scores[y] = score
    if "1" not in scores:
        return 0.0
    return 1 / sum(math.exp(s - scores["1"]) for s in scores.values())


def ask(spark, model, texts, hot=None):
    asked = counts_of(spark, texts)
    pairs = spark.createDataFrame([("u", i) for i, _ in texts], "user string, item bigint")
    return {r["item"]: r["p_1"] for r in bayes.score(model, pairs, asked, hot).collect()}


def test_known_posterior(spark):
    model = bayes.fit(examples_of(spark, DOCUMENTS))
    got = ask(spark, model, [(9, "alpha bravo charlie delta kilo"), (10, "unheard words only")])
    assert got[9] == pytest.approx(0.9971658203, abs=1e-9)
    assert got[10] == pytest.approx(python_nb(DOCUMENTS, "unheard words only"), abs=1e-9)


def test_hot_words_change_nothing(spark):
    model = bayes.fit(examples_of(spark, DOCUMENTS))
    texts = [(i, f"alpha bravo w{i} kilo kilo") for i in range(20)]
    assert ask(spark, model, texts, []) == pytest.approx(ask(spark, model, texts, ["alpha", "kilo"]))


@pytest.mark.parametrize("documents", [DOCUMENTS, DOCUMENTS[:5], DOCUMENTS[:4]])
def test_leave_one_out_equals_refits(spark, documents):
    examples = examples_of(spark, documents)
    for hot in ([], ["indigo", "bravo"]):
        out = bayes.leave_one_out(bayes.fit(examples), examples, hot)
        got = {r["item"]: r["p_1"] for r in out.collect()}
        assert got == pytest.approx({i: python_nb(documents[:i] + documents[i + 1:], t) for i, (_, t) in enumerate(documents)}, abs=1e-9)


def test_ensemble_weights(spark):
    rows = [("a", "1", 0.9, 0.6, 0.7), ("a", "0", 0.2, 0.4, 0.1), ("b", "1", 0.5, 0.5, 0.5), ("c", "1", 1.0, 1.0, 1.0), ("c", "0", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "user string, label string, bow double, tfidf double, nb double")
    got = {r["user"]: r[1:] for r in ensemble.ensemble_weights(df).collect()}
    assert got["a"] == pytest.approx((0.528370, 0.034684, 0.436946), abs=1e-6)
    assert got["b"] == (0.33333333,) * 3
    assert got["c"] == pytest.approx((1 / 3,) * 3)
    scores = spark.createDataFrame([("a", 1, 0.5, 0.2, 0.8), ("z", 1, 0.3, 0.3, 0.3)], "user string, item int, bow double, tfidf double, nb double")
    out = {r["user"]: r for r in ensemble.ensemble_scores(scores, ensemble.ensemble_weights(df)).collect()}
    assert out["a"]["mean"] == pytest.approx(0.5)
    assert out["a"]["weighted"] == pytest.approx(sum(w * p for w, p in zip(got["a"], (0.5, 0.2, 0.8))))
    assert out["z"]["weighted"] == pytest.approx(0.3)


TITLES = [
    ("1", "omsorg for eldre"), ("1", "bolig og omsorg"), ("1", "omsorg tjeneste"), ("1", "hjelp og omsorg hjemme"), ("1", "omsorg sektor"),
    *[("0", t) for t in ("vei og bru", "asfalt på vei", "kran til havn", "kontor og papir", "trykk av papir", "vei i by", "bru i havn", "asfalt", "kran", "papir")],
]


def linear_scores(spark, documents, texts, **options):
    rows = linear.with_folds(examples_of(spark, documents))
    weights = linear.fit_linear(rows, **options)
    pairs = spark.createDataFrame([("u", i) for i, _ in texts], "user string, item bigint")
    scores = {r["item"]: (r["bow"], r["tfidf"]) for r in linear.score_linear(weights, pairs, counts_of(spark, texts)).collect()}
    return scores, linear.held_out_linear(weights, rows).collect()


def test_linear_models_tell_titles_apart(spark):
    texts = [(100, "omsorg for barn"), (101, "ny vei med asfalt")]
    scores, held = linear_scores(spark, TITLES, texts)
    assert all(p > 0.5 for p in scores[100]) and all(p < 0.5 for p in scores[101])
    assert len(held) == len(TITLES)
    right = sum((r["bow"] > 0.5) == (r["label"] == "1") for r in held)
    assert right >= len(TITLES) - 1


def violations(weights, rows, cost=5.0):
    """By (model, fold): distance from the optimality conditions, straight from their definition, and that at weights 0."""
    found, out = {}, {}
    for r in weights:
        found.setdefault((r["model"], r["fold"]), {})[r["word"]] = r["weight"]
    for (model, held), w in found.items():
        texts, labels = {}, {}
        for r in rows:
            if r["fold"] != held:
                texts.setdefault(r["item"], {})[r["word"]] = r["n"]
                labels[r["item"]] = r["label"] == "1"
        df = Counter(x for t in texts.values() for x in t)
        share = sum(labels.values()) / len(labels)
        if share in (0, 1):
            assert set(w) == {None}
            continue
        zero = {None: math.log(share / (1 - share))}

        def away(w):
            slope = Counter()
            for i, t in texts.items():
                value = {x: n * (math.log(len(texts) / df[x]) if model == "tfidf" else 1) for x, n in t.items()}
                p = 1 / (1 + math.exp(-w[None] - sum(w.get(x, 0) * v for x, v in value.items())))
                for x, v in [(None, 1), *value.items()]:
                    slope[x] += cost * (p - labels[i]) * v
            by_word = [abs(slope[x] + math.copysign(1, w[x])) if w.get(x) else max(abs(slope[x]) - 1, 0) for x in df]
            return abs(slope[None]) + sum(by_word)

        out[model, held] = (away(w), away(zero) * min(share, 1 - share))
    return out


@pytest.mark.parametrize("block_rows", [1_000_000, 150])
def test_every_fit_is_optimal_whatever_the_blocks(spark, block_rows):
    rng = random.Random(5)
    documents = []
    for i in range(60):
        kind = "good" if i % 3 else "bad"
        documents.append(("1" if i % 3 else "0", " ".join(rng.choice([f"{kind}{rng.randrange(6)}", f"w{rng.randrange(30)}"]) for _ in range(9))))
    rows = linear.with_folds(examples_of(spark, documents), loo_limit=20, folds=2)
    # A second user with one label, whose examples fill several blocks too.
    one = rows.filter("label = '1'").withColumn("user", F.lit("same"))
    weights = linear.fit_linear(rows.unionByName(one), tol=0.01, block_rows=block_rows).collect()
    mine = [r for r in weights if r["user"] == "u"]
    got = violations(mine, rows.collect())
    assert set(got) == {(m, f) for m in ("bow", "tfidf") for f in (-1, 0, 1)}
    assert all(end <= 0.01 * start * (1 + 1e-9) for end, start in got.values())
    same = {(r["model"], r["fold"]): (r["word"], r["weight"]) for r in weights if r["user"] == "same"}
    assert set(same.values()) == {(None, linear.CERTAIN)} and len(same) == 6


def test_a_user_of_a_few_million_rows_is_one_block_of_plain_numbers(spark, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK_ROWS", 20)
    monkeypatch.setattr(linear, "WHOLE_ROWS", 10_000)
    monkeypatch.setattr(linear, "_fit_blocks", None)  # rounds over blocks were taken from BLOCK_ROWS on
    rng = random.Random(7)
    documents = [("1" if i % 4 else "0", " ".join(rng.choice([f"k{i % 4}{rng.randrange(5)}", f"w{rng.randrange(40)}"]) for _ in range(12))) for i in range(48)]
    rows = linear.with_folds(examples_of(spark, documents), loo_limit=20, folds=3)
    other = rows.filter("item < 30").withColumn("user", F.lit("v"))
    small = [rows.unionByName(other).select("user", "item", F.lit(0).alias("lane"), F.col("label").eqNullSafe("1").cast("double").alias("positive"), "word", F.col("n").cast("int").alias("n"), "fold").filter("user = 'u'").toArrow()]
    _, _, item, word, count, fold, y, names = linear._gathered(small[0].to_batches(max_chunksize=7))
    given = {(r["item"], r["word"]): (r["n"], r["fold"], r["positive"]) for r in small[0].to_pylist()}
    ids = list(dict.fromkeys(small[0]["item"].to_pylist()))
    assert {(ids[i], names[w]): (n, fold[i], y[i]) for i, w, n in zip(item, word, count)} == given
    weights = linear.fit_linear(rows.unionByName(other), tol=0.01, block_rows=20).collect()
    for user, theirs in (("u", rows), ("v", other)):
        got = violations([r for r in weights if r["user"] == user], theirs.collect())
        assert set(got) == {(m, f) for m in ("bow", "tfidf") for f in (-1, 0, 1, 2)}
        assert all(end <= 0.01 * start * (1 + 1e-9) for end, start in got.values())


def test_rounds_over_parts_move_only_the_words_a_fit_is_solved_for(spark, monkeypatch):
    monkeypatch.setattr(linear, "FIRST_WORDS", 20, raising=False)
    rng = random.Random(11)
    documents = [("1" if i % 3 else "0", " ".join(rng.choice([f"k{i % 3}{rng.randrange(3)}", f"w{rng.randrange(900)}"]) for _ in range(30))) for i in range(60)]
    rows = linear.with_folds(examples_of(spark, documents), loo_limit=20, folds=2)
    staged, stage = [], linear.stage
    monkeypatch.setattr(linear, "stage", lambda df, label: staged.append((label, stage(df, label))) or staged[-1][1])
    monkeypatch.setattr(linear, "discard", lambda *given: None)
    weights = linear.fit_linear(rows, tol=0.05, block_rows=150).collect()
    got = violations(weights, rows.collect())
    assert len(got) == 6 and all(end <= 0.05 * start * (1 + 1e-9) for end, start in got.values())
    # Before, every round wrote a row for each word of each fit three times over, and each fit took many rounds.
    words = rows.select("word").distinct().count()
    assert sum(df.count() for label, df in staged if label not in ("weights", "block_rows")) < words * 6
    parts = dict(staged)["word_parts"]
    assert parts.count() > 5 and parts.select(F.sum(F.size("words"))).first()[0] == words
    some = [r for label, df in staged if label == "measured" for r in df.collect()]
    assert sum(len(r["words"]) for r in some) < words * 6


def test_long_steps_end_where_short_ones_do():
    rng = np.random.default_rng(3)
    item, word = (x.astype(np.int32) for x in np.unravel_index(rng.permutation(60 * 25)[:600], (60, 25)))
    value, sign, seen = rng.integers(1, 4, 600).astype(np.uint8), rng.choice([-1.0, 1.0], 60), np.arange(60) % 5 > 0
    by_item, by_word = linear._Sums(item, word, value, 60), linear._Sums(word, item, value, 25)
    assert by_item.at.dtype == np.int32
    curve, curve_b = linear._curvature(item, word, value.astype(float), 60, 25, 5.0)
    ends = [f(by_item.of, by_word.of, curve, curve_b, sign * seen, np.zeros(25), 0.0, 5.0, 1e-6, 20_000) for f in (linear._descend, linear._descend_long)]
    assert np.allclose(ends[0][0], ends[1][0], atol=1e-4) and ends[0][1] == pytest.approx(ends[1][1], abs=1e-4)


def test_steps_of_a_fit_order_their_rows_once(monkeypatch):
    rng = np.random.default_rng(5)
    item, word = (x.astype(np.int32) for x in np.unravel_index(rng.permutation(40 * 30)[:500], (40, 30)))
    item[item == 7], word[word == 3] = 8, 4  # an item and a word without rows
    value, sign, w = rng.integers(1, 5, 500).astype(float), rng.choice([-1.0, 1.0], 40), rng.normal(size=30)
    for rows in (1, 16, 1 << 16):
        monkeypatch.setattr(linear, "CHUNK_ROWS", rows)
        assert np.allclose(linear._Sums(item, word, value, 40).of(w), np.bincount(item, value * w[word], 40), rtol=1e-12, atol=1e-12)
        assert np.allclose(linear._Sums(word, item, value, 30).of(sign), np.bincount(word, value * sign[item], 30), rtol=1e-12, atol=1e-12)
    assert not linear._Sums(item[:0], word[:0], value[:0], 40).of(w).any()
    # Unordered sums over all rows are taken a few times a round, not at each of its steps.
    counted, slopes = [], linear._slopes
    monkeypatch.setattr(linear, "_slopes", lambda *given: counted.append(1) or slopes(*given))
    y = (np.bincount(item, value * w[word], 40) > 0).astype(float)
    found, _ = linear._fit(item, word, value, y, 30, linear.COST, 1e-4)
    assert np.count_nonzero(found) and len(counted) <= 101


def test_item_counts_of_users_meet_the_words_without_a_shuffle_by_user(spark):
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, value in zip(kept, ("-1", "false")):
            spark.conf.set(c, value)
        out = counts.user_tfidf(examples_of(spark, TITLES), [])
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert "BroadcastHashJoin [user" in joins[0] and out.count() == examples_of(spark, TITLES).count()
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)


def test_one_label_only(spark):
    scores, _ = linear_scores(spark, [("0", "a b"), ("0", "b c")], [(9, "a")])
    assert scores[9] == pytest.approx((0.0, 0.0), abs=1e-9)


def test_folds(spark):
    documents = [("1" if i % 3 else "0", f"w{i} x") for i in range(25)]
    rows = linear.with_folds(examples_of(spark, documents), loo_limit=20, folds=10).select("item", "fold").distinct().collect()
    assert len(rows) == 25 and {r["fold"] for r in rows} == set(range(10))


def points(spark, values):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(values)], "id int, vector array<double>")


GROUPS = [(x + dx, y + dy) for x, y in ((0, 0), (60, 5), (20, 90)) for dx in (0, 1, 2) for dy in (0, 1)]


def test_alpha_of_k(spark):
    table = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 20.0), (4, 19.0)], "k int, dispersion double")
    got = {r["k"]: r for r in cluster.select_k(table, 2).collect()}
    assert got[2]["alpha"] == 0.625 and got[3]["alpha"] == 0.6875
    assert got[3]["f"] == pytest.approx(20 / (0.6875 * 50))
    assert [k for k, r in got.items() if r["chosen"]] == [3]


def test_cosine_clusters_use_one_measure_from_one_cluster_on(spark):
    rng = random.Random(3)
    vectors = [(0.0, 0.0)]
    for angle in (0.2, 2.2, 4.4):
        for _ in range(12):
            turn, length = angle + rng.uniform(-0.08, 0.08), rng.choice([0.1, 1.0, 40.0])
            vectors.append((length * math.cos(turn), length * math.sin(turn)))
    table, centers = cluster.fit_kmeans(points(spark, vectors), 5, distance="cosine")
    rows = {r["k"]: r for r in table.collect()}
    units = np.array([np.array(v) / np.linalg.norm(v) for v in vectors[1:]])
    mean = units.sum(axis=0) / np.linalg.norm(units.sum(axis=0))
    assert rows[1]["dispersion"] == pytest.approx((1 - units @ mean).sum())
    assert [k for k, r in rows.items() if r["chosen"]] == [3]
    found = np.array([r["center"] for r in centers.collect()])
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    assert rows[3]["dispersion"] == pytest.approx((1 - (units @ found.T).max(axis=1)).sum())
    center, spread = cluster.one_direction(points(spark, [(1, 0), (-5, 0)]))
    assert center == [0.0, 0.0] and spread == pytest.approx(2.0)


def test_no_dispersion_left_starts_over(spark):
    table = spark.createDataFrame([(1, 4.0), (2, 0.0), (3, 0.0), (4, 0.0)], "k int, dispersion double")
    got = {r["k"]: r for r in cluster.select_k(table, 2).collect()}
    assert (got[3]["alpha"], got[3]["f"], got[2]["f"]) == (0.0, 1.0, 0.0)
    alone = cluster.select_k(spark.createDataFrame([(1, 4.0)], "k int, dispersion double"), 2).collect()
    assert alone[0]["chosen"]


def test_kmeans_finds_three_groups(spark):
    table, centroids = cluster.fit_kmeans(points(spark, GROUPS), max_k=6)
    assert centroids.count() == 3
    near = cluster.nearest_centroid(points(spark, GROUPS), centroids).orderBy("id").collect()
    assert len({r["cluster"] for r in near[:6]}) == 1 and len({r["cluster"] for r in near}) == 3


def test_many_centres_give_the_same_result(spark, monkeypatch):
    centroids = spark.createDataFrame([(i, [float(i % 7) * 10, float(i)]) for i in range(30)], "cluster int, center array<double>")
    shares = centroids.withColumn("share", F.col("cluster") / 30)
    few = {tuple(r) for r in cluster.nearest_centroid(points(spark, GROUPS), centroids).collect()}
    scores = {r["id"]: r["score"] for r in cluster.cluster_score(points(spark, GROUPS), shares).collect()}
    monkeypatch.setattr(cluster, "LITERAL_NUMBERS", 10)
    assert {tuple(r) for r in cluster.nearest_centroid(points(spark, GROUPS), centroids).collect()} == few
    by_rows = cluster._cluster_score_by_rows(points(spark, GROUPS), shares, "euclidean", False)
    assert {r["id"]: r["score"] for r in by_rows.collect()} == pytest.approx(scores)


def test_cluster_score_formula(spark):
    model = spark.createDataFrame([(0, [0.0, 0.0], 0.9), (1, [10.0, 0.0], 0.2), (2, [0.0, 30.0], 0.5)], "cluster int, center array<double>, share double")
    observation = points(spark, [(3, 4)])
    d = [math.dist((3, 4), c) for c in ((0, 0), (10, 0), (0, 30))]
    want = sum((1 - x / sum(d)) * s for x, s in zip(d, (0.9, 0.2, 0.5)))
    assert cluster.cluster_score(observation, model).first()["score"] == pytest.approx(want)
    assert cluster.cluster_score(observation, model, normalise=True).first()["score"] == pytest.approx(want / 2)


def test_share_is_clamped_and_counts_by_label(spark):
    members = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0), (2, 1)], "cluster int, label int")
    assert {r["cluster"]: r["share"] for r in cluster.cluster_label_share(members).collect()} == {0: 0.9999, 1: 0.0001, 2: 0.5}


def test_whiten(spark):
    white = np.array([r["vector"] for r in cluster.whiten(points(spark, [(1, 5), (3, 5), (8, 5)])).collect()])
    assert white[:, 0].std() == pytest.approx(1) and (white[:, 1] == 5).all()


def plain_net(rows, matrices, passes, rate=0.3, momentum=0.1):
    """Row-by-row back-propagation with scalar loops; weights, and the error of the last pass."""
    w = [m.tolist() for m in matrices]
    change = [[[0.0] * (len(node) - 1) for node in layer] for layer in w]
    for _ in range(passes):
        errors = []
        for given, wanted in rows:
            outs = [list(given)]
            for layer in w:
                outs.append([1 / (1 + math.exp(-(node[-1] + sum(a * b for a, b in zip(node, outs[-1]))))) for node in layer])
            errors.append(sum((t - o) ** 2 for t, o in zip(wanted, outs[-1])) / len(wanted))
            deltas = [[(t - o) * o * (1 - o) for t, o in zip(wanted, outs[-1])]]
            for k in range(len(w) - 1, 0, -1):
                back = [sum(d * node[i] for d, node in zip(deltas[0], w[k])) for i in range(len(outs[k]))]
                deltas.insert(0, [b * o * (1 - o) for b, o in zip(back, outs[k])])
            for k, layer in enumerate(w):
                for n, node in enumerate(layer):
                    for i, x in enumerate(outs[k]):
                        change[k][n][i] = rate * deltas[k][n] * x + momentum * change[k][n][i]
                        node[i] += change[k][n][i]
                    node[-1] += rate * deltas[k][n]
    return w, sum(errors) / len(errors)


NET_ROWS = "input array<double>, output array<double>"


def corners(n, seed=2):
    """Points near three corners of a square, with one output for each corner."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        x, y = ((0.1, 0.1), (0.9, 0.1), (0.5, 0.9))[i % 3]
        out.append(([x + pick.uniform(-0.1, 0.1), y + pick.uniform(-0.1, 0.1)], [float(i % 3 == c) for c in range(3)]))
    return out


@pytest.mark.parametrize("hidden", [None, [3, 2]])
def test_one_partition_learns_row_by_row(spark, hidden):
    data = corners(20)
    net = network.train(spark.createDataFrame(data, NET_ROWS).coalesce(1), hidden=hidden, passes=3)
    first = network._first_weights([2, *(hidden or [3]), 3], 42)
    want, error = plain_net(data, first, 3)
    got = [[*r["weights"], r["bias"]] for r in net.model.orderBy("layer", "node").collect()]
    assert net.passes == 3 and net.error == pytest.approx(error)
    for a, b in zip(got, [node for layer in want for node in layer], strict=True):
        assert a == pytest.approx(b)


def test_partitions_learn_three_classes_and_stop_by_error(spark):
    df = spark.createDataFrame(corners(3000), NET_ROWS).repartition(4)
    net = network.train(df, passes=60, error=0.01)
    assert net.passes < 60 and net.error <= 0.01
    fresh = network.forward(spark.createDataFrame(corners(300, 5), NET_ROWS), net.model).collect()
    assert all(np.argmax(r["output"]) == i % 3 for i, r in enumerate(fresh))
    # The classes change with the inputs only: the outputs are one for each class.
    assert len(fresh[0]["output"]) == 3


def test_training_leaves_out_unusable_rows(spark):
    data = corners(9)
    odd = [(None, [0.0] * 3), ([0.1, 0.2], None), ([None, 0.1], [0.0] * 3), ([float("nan"), 0.1], [0.0] * 3), ([0.1, 0.1], [float("inf")] * 3)]
    plain = network.train(spark.createDataFrame(data, NET_ROWS).coalesce(1), passes=2).model.collect()
    assert network.train(spark.createDataFrame(data + odd, NET_ROWS).coalesce(1), passes=2).model.collect() == plain
    for wrong in ([], odd, [*data, ([1.0], [0.0] * 3)]):
        with pytest.raises(ValueError, match="training needs rows"):
            network.train(spark.createDataFrame(wrong, NET_ROWS))


def test_large_net_runs_through_a_join_with_the_same_outputs(spark, monkeypatch):
    drawn = np.random.default_rng(1)
    model = network.model_table(spark, [drawn.normal(size=(600, 3)), drawn.normal(size=(4, 601))])
    data = spark.createDataFrame([(i, x, x) for i, (x, _) in enumerate(corners(30))] + [(30, None, None)], "id int, input array<double>, _in array<double>")
    want = {r["id"]: r["output"] for r in network.forward(data, model).collect()}
    monkeypatch.setattr(network, "LITERAL_WEIGHTS", 100)
    joined = network.forward(data, model)
    assert joined.columns == ["id", "input", "_in", "output"]
    got = {r["id"]: r["output"] for r in joined.collect()}
    assert got.keys() == want.keys() and got[30] is None is want[30]
    for i in range(30):
        assert got[i] == pytest.approx(want[i])


def test_sparse_and_dense(spark, rows, monkeypatch):
    records = spark.createDataFrame([("r", "b", 2.0), ("r", "a", 1.0), ("s", "c", 3.0)], "row string, key string, value double")
    got = rows(network.dense_from_sparse(records, "row", "key", "value"))
    assert got == [("r", 0, "a", 1.0), ("r", 1, "b", 2.0), ("r", 2, "c", 0.0), ("s", 0, "a", 0.0), ("s", 1, "b", 0.0), ("s", 2, "c", 3.0)]
    monkeypatch.setattr(network, "LITERAL_KEYS", 2)
    assert rows(network.dense_from_sparse(records, "row", "key", "value")) == got
    back = spark.range(1).select(network.sparse_from_dense(F.array(F.lit(1.0), F.lit(2.0)), ["a", "b"])).first()[0]
    assert back == {"a": 1.0, "b": 2.0}


def test_losses(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    assert value(L.log1p_exp(F.lit(800.0))) == 800.0 and value(L.log1p_exp(F.lit(-3.0))) == pytest.approx(math.log1p(math.exp(-3)))
    y = p = 1 - 5e-7
    assert value(L.log_loss(F.lit(1.0), F.lit(1.0))) == pytest.approx(2 * math.log1p(math.exp(-2 * y * p)))
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert value(V.euclidean(a, b)) == pytest.approx(5 ** 0.5) and value(V.cosine(a, b)) == 1.0


def test_folds_are_even_and_ratios_null_safe(spark):
    rows = spark.createDataFrame([(f"k{i}", "0", 0.1) for i in range(10)], "key string, label string, p double")
    folded = evaluate.with_fold(rows, "key", 4)
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [2, 2, 3, 3]
    total = {r["fold"]: r for r in evaluate.kfold_metrics(folded).collect()}[-1]
    assert total["precision"] is None and total["accuracy"] == 1.0 and total["total"] == 10
    picked = spark.range(1).select(evaluate.arg_max(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.7)))).first()[0]
    assert picked == 1


def test_one_cluster_and_one_model_have_stated_values(spark):
    model = spark.createDataFrame([(0, [1.0, 2.0], 0.7)], "cluster int, center array<double>, share double")
    at, off = points(spark, [(1, 2)]), points(spark, [(5, 2)])
    for score in (lambda p, n: cluster.cluster_score(p, model, normalise=n), lambda p, n: cluster._cluster_score_by_rows(p, model, "euclidean", n)):
        assert score(at, False).first()["score"] == pytest.approx(0.7)
        assert score(off, False).first()["score"] == pytest.approx(0.0)
        assert score(at, True).first()["score"] == pytest.approx(0.7)
        assert score(off, True).first()["score"] == pytest.approx(0.7)
    predictions = spark.createDataFrame([("u", "1", 0.4), ("u", "0", 0.1), ("v", "1", 0.2)], "user string, label string, nb double")
    assert {r["w_nb"] for r in ensemble.ensemble_weights(predictions, ["nb"]).collect()} == {1.0}


def test_select_k_uses_every_dispersion(spark):
    table = spark.createDataFrame([(k, 100.0 / k) for k in range(1, 16)], "k int, dispersion double")
    assert cluster.select_k(table, 2).count() == 15


def test_dense_rows_with_null_and_repeated_keys(spark, monkeypatch):
    records = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, None, 5.0), (2, "b", 3.0), (3, None, 4.0)], "row int, key string, value double")
    want = {(1, 0, "a", 2.0), (1, 1, "b", 0.0), (2, 0, "a", 0.0), (2, 1, "b", 3.0), (3, 0, "a", 0.0), (3, 1, "b", 0.0)}
    assert {tuple(r) for r in network.dense_from_sparse(records, "row", "key", "value").collect()} == want
    monkeypatch.setattr(network, "LITERAL_KEYS", 1)
    assert {tuple(r) for r in network.dense_from_sparse(records, "row", "key", "value").collect()} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_recommendations_rank_cleaned_texts_by_all_models(spark):
    from textvane.plans import relevance, spelled

    sf_dir = "/root/testdata/sf0.001"
    labels = [tuple(r) for r in relevance._labels(spark, sf_dir).select("user", "item", "label").collect()]
    texts = {}
    for r in spelled.clean_titles(spark, sf_dir).collect():
        texts[r["item"]] = re.findall("[a-z{-æøå]+", r["processed"]) or [""]
    got = relevance.recommended_items(spark, sf_dir).collect()
    for user in {u for u, _, _ in labels}:
        labelled = {i: y for u, i, y in labels if u == user and i in texts}
        mine = sorted((r for r in got if r["user"] == user), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert {r["item"] for r in mine} == texts.keys() - {i for u, i, _ in labels if u == user}
        assert all(a["weighted"] >= b["weighted"] for a, b in zip(mine, mine[1:]))
        count = {y: Counter(w for i, z in labelled.items() if z == y for w in texts[i]) for y in "01"}
        vocabulary = len(count["0"] | count["1"])
        for r in mine:
            s = {
                y: math.log(sum(z == y for z in labelled.values()) + 0.02)
                + sum(math.log((count[y][w] + 0.05) / (count[y].total() + vocabulary * 0.05)) for w in texts[r["item"]])
                for y in "01"
            }
            assert r["nb"] == pytest.approx(1 / (1 + math.exp(min(700, s["0"] - s["1"]))), abs=2e-6)
            low, high = min(r["bow"], r["tfidf"], r["nb"]), max(r["bow"], r["tfidf"], r["nb"])
            assert low - 2e-6 <= r["weighted"] <= high + 2e-6
