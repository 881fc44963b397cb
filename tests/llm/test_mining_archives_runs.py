"""Hard negatives, WARC archives and periodic runs against brute force, with odd rows in every table."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textvane.llm import negatives, periods, warc, words
from textvane.session import new_path, stage

# ---- hard negatives


def vectors(spread, scale):
    """Six clouds, a large group of equal rows, an all-zero one, and rows that take no part."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(300):
        v = (centres[i % 6] + spread * rng.normal(size=8)) * 10.0 ** rng.integers(-scale, scale + 1)
        rows.append((i, int(rng.integers(0, 4)) if i % 19 else None, [float(x) for x in v]))
    rows += [(i, 1, rows[1][2]) for i in range(300, 400)]
    rows += [(600, None, [1.0] * 8), (650, 1, None), (700, 1, [None] * 8), (750, 2, [float("nan")] * 8), (755, 2, [float("inf")] * 8),
             (800, 3, [0.0] * 8), (None, 2, [1.0] * 8), (50, 3, [1.0] * 8), rows[3], (805, 1, [1.0]), (810, 1, [])]
    return rows


def mined(rows, every):
    points = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or len(v) != 8 or any(x is None or not np.isfinite(x) for x in v):
            continue
        points[i] = min(points.get(i, (label, v)), (label, v))
    m = {i: [int(np.floor(256 * x)) for x in v] for i, (_, v) in points.items()}
    out = Counter()
    for a in points:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(m[a], m[b], strict=True)), b) for b in points if b != a)
        for good, p in [x for x in scored if points[x[1]][0] == points[a][0]][:5]:
            fit = [(s, n) for s, n in scored if points[n][0] != points[a][0] and 50 * -good <= 100 * -s <= 95 * -good]
            out.update((a, p, k, n, -good, -s) for k, (s, n) in enumerate(fit[:3], 1))
    return out


@pytest.mark.parametrize(("spread", "scale", "o"), [
    (0.3, 0, negatives.Options(rows_block=60, anchors_block=10)),
    (2.0, 3, negatives.Options(rows_block=500, anchors_block=7, sample=40, references=3)),
])
def test_hard_negatives_are_brute_force(spark, spread, scale, o):
    rows = vectors(spread, scale)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, label int, vector array<double>, score int, cls int").repartition(3)
    got = Counter(tuple(r) for r in negatives.mine(table, F.col("id") % 5 == 0, o).collect())
    assert got == mined(rows, 5) and got


def test_hard_negatives_of_nothing_and_of_one_label(spark):
    schema = "id long, label int, vector array<double>"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(20)], schema)
    assert negatives.mine(one, F.col("id") % 5 == 0).count() == 0


def test_scores_past_eight_bytes_stay_at_the_ends():
    rng = np.random.default_rng(4)
    a = rng.integers(-(1 << 24), 1 << 24, size=(5, 3))
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in a] for r in a]
    assert negatives.products(a, a).tolist() == exact
    a = np.array([[1 << 62, 1 << 62], [-(1 << 62), 5], [3, 4]])
    ends = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for s in a] for r in a]
    assert negatives.products(a, a).tolist() == ends


def test_bounds_hold_for_every_pair(spark):
    rng = np.random.default_rng(2)
    m = np.floor(256 * rng.normal(size=(200, 6)) * 10.0 ** rng.integers(-2, 5, size=(200, 1))).astype(np.int64)
    m[10:20] = m[:10] * 3  # parallel rows: arc cosines at their worst
    m[20:30] = -m[:10]
    refs = negatives._references(m, 8)
    norm = negatives._norms(m)
    c = np.clip(np.divide(m @ refs.T, norm[:, None], out=np.zeros((200, len(refs))), where=norm[:, None] > 0), -1, 1)
    side = {"cos": c.astype("f4"), "sin": np.sqrt(1 - c * c).astype("f4"), "norm": norm}
    low, high = negatives._bounds(side, side)
    exact = negatives.products(m, m)
    assert (low <= exact).all() and (exact <= high).all() and (high - low < 2 * np.outer(norm, norm)).any()


# ---- WARC


def pages():
    rng = random.Random(2)
    rows = []
    for i in range(120):
        body = rng.choice(["é", "a", "WARC/1.1\r\n", "\r\n\r\n", "日本", "\x00\n"]) * rng.choice([0, 10, 999, 1000, 1001, 5000, 70000])
        if rows and rng.random() < 0.4:
            body = rng.choice(rows)[2]
        rows.append((3 * i, rng.choice([None, "", "http://a b/\r\nX: 1", "https://x.y/?q=ü"]), rng.choice([None, body, body, body])))
    return rows + [(None, "u", "z" * 2000), (None, "u", "z" * 2000), (6, "u", "q" * 2000), (6, "u", "q" * 2000)]


def archived(rows):
    lead, done, out = {}, set(), Counter()
    for key, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            lead[body] = max((key is not None, key or 0), lead.get(body, (False, 0)))
    for key, _, html in rows:
        body = (html or "").encode()
        keeps = len(body) < 1000 or (lead[body] == (key is not None, key or 0) and body not in done)
        if keeps:
            done.add(body)
        to = None if keeps else lead[body][1] if lead[body][0] else None
        out[key, len(body), hashlib.sha1(body).hexdigest(), "response" if keeps else "revisit", to] += 1
    return out


@pytest.mark.parametrize("o", [warc.Options(chunk=1 << 14), warc.Options(compression="none")])
def test_archives_give_back_every_page(spark, o):
    table = spark.createDataFrame([(*r, 1, "x") for r in pages()], "page_id long, url string, html string, record int, sha1 string").repartition(5)
    assert Counter(tuple(r) for r in warc.round_trip(table, o).collect()) == archived(pages())
    assert warc.round_trip(table.limit(0), o).count() == 0


def test_archives_hold_payloads_and_links(spark):
    table = spark.createDataFrame(pages()[:40], "page_id long, url string, html string")
    o, path = warc.Options(chunk=4096), new_path(spark, "archives")
    run = warc.write_archives(stage(warc.chunked(table, o=o)), path, o, date="2020-01-01T00:00:00Z")
    assert warc.archive_id(spark, path) == run
    chunks = warc.read_archives(spark, path).collect()
    bodies, most = {}, 0
    for r in sorted(chunks, key=lambda r: (r["record"], r["chunk"])):
        if r["kind"] != "revisit":
            bodies[r["key"]] = bodies.get(r["key"], b"") + bytes(r["data"])
        most = max(most, len(r["data"]))
    want = {str(k): (h or "").encode() for k, _, h in pages()[:40]}
    assert most == 4096 and set(bodies) <= set(want) and all(want[k] == b for k, b in bodies.items())
    urls = {r["key"]: r["url"] for r in chunks if r["chunk"] == 0}
    assert all(urls[str(k)] == (u if u and " " not in u else None) for k, u, _ in pages()[:40] if not u or " " not in u)
    assert all("\r" not in u for u in urls.values() if u)


def test_a_changed_archive_is_an_error(spark):
    table = spark.createDataFrame([(1, "u", "a" * 3000)], "page_id long, url string, html string")
    o, path = warc.Options(compression="none"), new_path(spark, "archives")
    run = warc.write_archives(stage(warc.chunked(table, o=o)), path, o)
    for change in (("aaaa", "aaab"), ("aaaa", "aaa")):
        text = spark.read.option("lineSep", "\r\n").text(path).withColumn("value", F.expr(f"replace(value, '{change[0]}', '{change[1]}')"))
        other = new_path(spark, "archives")
        text.coalesce(1).write.option("lineSep", "\r\n").text(other)
        with pytest.raises(Exception, match="as stated|as long as stated"):
            warc.records(warc.read_archives(spark, other, run)).collect()


# ---- periodic runs


def brute_runs(w, least=12):
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def tandem(doc, w):
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_texts():
    rng = random.Random(1)
    out = []
    for i in range(600):
        letters = rng.choice(["a", "ab", "ab", "abc", "abcdefgh"])
        w = [rng.choice(letters) for _ in range(rng.choice([0, 5, 11, 12, 13, 30, 60, 200]))]
        if rng.random() < 0.3:
            w = w + w
        out.append((i, rng.choice([" ", "\n", " \t"]).join(w) + rng.choice(["", " "])))
    return out + [(None, "a " * 30), (700, None), (701, ""), (702, " \n"), (3, out[3][1]), (703, "x" * 5000 + " é" * 40), (704, "b" * 100_000)]


def test_runs_and_collapsed_texts_are_brute_force(spark):
    table = spark.createDataFrame([(*r, 5, "r") for r in periodic_texts()], "doc_id long, text string, n_words int, runs string").repartition(4)
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periods.find_runs(table).collect())
    want = Counter()
    for doc, text in periodic_texts():
        w = (text or "").split()
        found = brute_runs(w)
        want[doc, len(w), tuple(found), collapsed(w, found)] += 1
    assert got == want
    assert periods.find_runs(table.limit(0)).count() == 0


def test_run_report_is_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 9, 40, 300])))) for i in range(-20, 300)] + periodic_texts()[-7:]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter()
    for doc, text in rows:
        w = tandem(doc, (text or "").split())
        found = brute_runs(w)
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found), collapsed(w, found))]
        want[doc, len(found), s, n, q, 1000 * n // q if found else None, *digest] += 1
    assert Counter(tuple(r) for r in periods.report(periods.find_runs(periods.with_tandems(table))).collect()) == want


@pytest.mark.parametrize("text", ["a " * 50_000, "a b " * 30_000, "a b a a b " * 10_000])
def test_long_periodic_texts_take_no_quadratic_time(text):
    w = words.split(pa.array([text]), hashes=False)
    start, length, period = periods.runs(w)
    assert (0, len(w.starts)) in set(zip(start.tolist(), length.tolist(), strict=True))
    assert len(start) < len(w.starts)
