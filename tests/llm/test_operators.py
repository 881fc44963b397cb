"""Training-data operators on small fixtures, against brute force, with odd rows in every table."""

import hashlib
import math
import random
import tracemalloc
import re

import numpy as np
import pyarrow as pa
import pytest

from textvane.llm import automata, buckets, jaccard, language, mixing, neighbours, packing, passages, quality, suffixes, tokencounts, tokenizer, urls, words as llm_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, lang string, n_words long"


def words(text):
    return WORD.findall(text or "")


def corpus():
    """Prose, exact and near copies, shared passages, long, empty, blank and null texts, null columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(70)
    texts = []
    for i in range(60):
        base = prose(rng.choice([3, 12, 40, 120, 300]))
        if i % 5 == 0:
            base = base[:20] + passage + base[20:]
        texts.append(base)
    for i in range(20):
        near = list(texts[i])
        if i % 2:
            near[rng.randrange(len(near))] = "changed"
        texts.append(near)
    texts.append(prose(5000))
    texts.append(texts[-1][:4990])
    rows = [(i, ("\n" if i % 7 == 0 else " ").join(t), f"s{i % 4}" if i % 9 else None, "en", 1) for i, t in enumerate(texts)]
    rows += [(900, None, "s0", None, None), (901, "", None, None, None), (902, " \t\n ", "s9", None, None), (903, "One two", "é", "fr", 2),
             (904, "one TWO", "é", "fr", 2), (None, rows[0][1], "s1", None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100)])
def test_jaccard_join_is_brute_force(docs, nothing, rule):
    rows = [(d, t) for d, t, *_ in corpus() if d is not None]
    sets = {d: shingles(t, rule.n) for d, t in rows}
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and rule.den * both >= rule.num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = {r[0]: tuple(r)[1:] for r in jaccard.linked_classes(docs, rule).collect()}
    assert got.pop(None)[1] is None
    assert got == {d: (len(sets[d]), root(d)) for d in sets}
    assert jaccard.linked_classes(nothing, rule).count() == 0
    kept = {r[0] for r in jaccard.keep_one(docs, rule).collect()}
    assert kept == {d for d in sets if root(d) == d} | {None}


def test_tiles_of_linked_sets_meet():
    rule, rng = jaccard.Rule(3, 80, 100), np.random.Generator(np.random.PCG64(1))
    for n in [9, 10, 17, 19, 40, 150, 700]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            spare = rng.integers(0, 2**63, n, dtype=np.uint64)
            k = int(rng.integers(0, max(1, rule.apart(2 * n) // 2) + 1))
            b = np.unique(np.concatenate([a[k:], spare[:k]]))
            both = len(np.intersect1d(a, b))
            if k and rule.linked(both, len(a) + len(b)):
                assert len(np.intersect1d(jaccard.tile_keys(a, rule), jaccard.tile_keys(b, rule)))
            assert jaccard.bound(jaccard.point(a), jaccard.point(b)) >= both


def test_tree_finds_every_bounded_pair():
    rng = np.random.Generator(np.random.PCG64(2))
    points = rng.integers(0, 6, (900, 16)) + rng.integers(0, 3, (900, 1))
    sizes, rule = points.sum(axis=1), jaccard.Rule(3, 80, 100)
    tree = jaccard.Tree(points, sizes)
    for i in range(0, 900, 37):
        least = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero((180 * least >= 80 * (sizes + sizes[i])))
        assert set(want) <= set(tree.search(points[i], int(sizes[i]), rule).tolist())


def test_unlike_sets_of_any_size_are_held_back_by_their_sketches():
    """What a tile lets out does not grow with the square of its members: unlike sets stop in it, links never do."""
    rule, rng = jaccard.Rule(5, 80, 100), np.random.Generator(np.random.PCG64(5))
    for n in [30, 90, 400, 3000, 12000]:
        sets = [np.unique(rng.integers(0, 2**63, int(n * x), dtype=np.uint64)) for x in np.linspace(1, 1.2, 12)]
        near = np.unique(np.concatenate([sets[0][: len(sets[0]) - n // 20], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        sets.append(near)
        assert rule.linked(len(np.intersect1d(sets[0], near)), len(sets[0]) + len(near))
        counts = [jaccard.sketch(jaccard.point(s)) for s in sets]
        packed = [np.frombuffer(jaccard.pack(c), np.uint8) for c in counts]
        assert all((jaccard.unpack(p) == c).all() for p, c in zip(packed, counts, strict=True))
        sketches = jaccard.Sketches(packed, np.array([len(s) for s in sets]))
        pairs = {(i, j) for i in range(len(sets)) for j in sketches.held(i, np.arange(i), rule).tolist()}
        assert (len(sets) - 1, 0) in pairs
        assert len(pairs) <= 3, (n, len(pairs))


@pytest.mark.parametrize("method", [automata, suffixes])
def test_repeated_windows_are_brute_force(docs, nothing, method):
    length = method.SHAPE.window
    seen, want = {}, {}
    for d, t in sorted((d, t) for d, t, *_ in corpus() if d is not None):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[i:i + length]), d) != d:
                gone[i:i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    rows = method.dedup(docs).rows.collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert got.pop(None)[1] == 0
    assert got == want
    for r in rows:
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"]
    assert method.dedup(nothing).rows.count() == 0


@pytest.mark.parametrize("method", [automata, suffixes])
def test_heavy_anchor_is_not_indexed_in_one_shard(spark, tmp_path, method):
    import pyarrow as pa

    rng = random.Random(6)
    prose = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    k, length = method.SHAPE.anchor, method.SHAPE.window
    # Of many lines the one whose hash is least is the anchor of every window around it.
    lines = [prose(k) for _ in range(500)]
    w = llm_words.split(pa.array([" ".join(x) for x in lines]))
    line = lines[int(np.argmin(passages.anchors(w, passages.Shape(k, k, 1))[2]))]
    texts = [prose(60) + line + prose(60) for _ in range(120)]
    texts += [t[:30] + prose(3) + t[40:] for t in texts[:20]] + [prose(5) + t[15:] for t in texts[20:30]]
    seen, want = {}, {}
    for d, w in enumerate(texts):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[i:i + length]), d) != d:
                gone[i:i + length] = [True] * length
        want[d] = sum(gone)
    assert sum(n > 0 for n in want.values()) == 30
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def index(runs, *rest):
        (sizes / str(random.random())).write_text(str(sum(map(len, runs))))
        return method.index(runs, *rest)

    shape = passages.Shape(length, k, 700)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in passages.repeats(docs, shape, index).rows.collect()}
    assert got == want
    # Not one of the shards holds all the different stretches around the line.
    assert max(int(f.read_text()) for f in sizes.iterdir()) < 2 * shape.shard_words


@pytest.mark.parametrize("module, run", [
    (passages, lambda docs: suffixes.dedup(docs).rows), (jaccard, lambda docs: jaccard.linked_classes(docs))])
def test_dedup_sends_texts_in_small_batches(spark, monkeypatch, module, run):
    name, given, seen = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), []
    stage = module.stage
    monkeypatch.setattr(module, "stage", lambda df, label="stage": seen.append(spark.conf.get(name)) or stage(df, label))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(3)]
    assert run(spark.createDataFrame([*rows, (9, rows[0][1])], "doc_id long, text string")).count() == 4
    assert set(seen) == {"4m"} and spark.conf.get(name) == given

    def fails(df, label="stage"):
        raise ValueError(label)

    monkeypatch.setattr(module, "stage", fails)
    with pytest.raises(ValueError):
        run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert spark.conf.get(name) == given


def _most_bytes(run):
    """The most memory in use at once while `run` works, and what it returns."""
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_worker_memory_of_a_batch_of_texts():
    rng = random.Random(4)
    column = pa.array([" ".join(rng.choices(["lorem", "ip", "dolores", "am"], k=100)) for _ in range(7000)])
    assert column.nbytes > 3 << 20
    most, windows = _most_bytes(lambda: sum(len(passages.anchors(llm_words.split(column.slice(lo, hi - lo)), suffixes.SHAPE)[0])
                                            for lo, hi in llm_words.chunks(column)))
    assert windows == 7000 * 51 and most < 40 << 20
    pairs = [(np.arange(i, i + 4096, dtype=np.uint64) << np.uint64(20), np.full(4096, i, np.uint64)) for i in range(200)]
    packed = [b for b in buckets.rows(iter(pairs), 4)]
    assert sum(len(x) for b in packed for x in b.column(1).to_pylist()) == 8 * 200 * 4096
    assert max(b.nbytes for b in packed) < 3 << 20


def test_shard_is_numbered_without_an_object_a_word():
    rng = random.Random(6)
    runs = [[rng.choice("abcdefgh") + str(rng.randrange(4000)) for _ in range(70)] for _ in range(2000)]
    texts = pa.chunked_array([pa.array([" ".join(x).encode() for x in runs[:900]]), pa.array([" ".join(x).encode() for x in [*runs[900:], *runs[:10]]])])
    at, anchor = np.full(2010, 31, np.int32), np.append(np.arange(2000), np.arange(10))
    docs = np.append(np.arange(2000) + 100, np.arange(10))
    most, found = _most_bytes(lambda: suffixes.index(passages.numbered(texts), at, anchor, docs, 50))
    assert most < 8 << 20
    numbers = passages.numbered(texts)
    assert [len(set(x.tolist())) for x in numbers] == [len(set(x)) for x in [*runs, *runs[:10]]]
    assert len(np.unique(np.concatenate(numbers))) == len({w for x in runs for w in x})
    assert found.to_pylist() == [[d % 100 if d < 110 else d] * 21 for d in docs.tolist()]


def test_strip_repeats_keeps_columns_and_other_text(docs):
    rows = {r["doc_id"]: r for r in suffixes.dedup(docs).rows.collect()}
    out = suffixes.strip_repeats(docs)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    texts = {d: t for d, t, *_ in corpus()}
    for d, r in rows.items():
        if d is None:
            continue
        if r["n_removed"] == 0:
            assert left[d] == texts[d]
        elif r["n_removed"] == r["n_words"]:
            assert d not in left
        else:
            assert hashlib.sha256(" ".join(words(left[d])).encode()).hexdigest() == r["kept_sha256"]


def test_mix_meets_targets_exactly(spark, docs, nothing):
    sizes = mixing.Sizes(block_words=64, block_docs=8, shard_blocks=4)
    found = mixing.mix(docs, sizes=sizes)
    rows = found.docs.collect()
    assert len(rows) == len(corpus())
    totals, taken, goal = {}, {}, {}
    for r in rows:
        totals[r["source"]] = totals.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(r["source_size"] == totals[r["source"]] for r in rows)
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_ = float(sum(totals.values())), set(totals)
    want = {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * totals[s]}
        if not full:
            break
        want |= {s: 3.0 * totals[s] for s in full}
        left -= sum(3 * totals[s] for s in full)
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    for s in totals:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in mixing.mix(docs, sizes=sizes).docs.collect()}
    assert again == {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in rows}
    assert mixing.mix(nothing).docs.count() == 0 and mixing.mixed_docs(nothing).columns == nothing.columns
    per_doc = {}
    for r in mixing.mixed_docs(docs.filter("doc_id is not null"), sizes=sizes).collect():
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + len(words(r["text"]))
    named = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.filter("doc_id is not null"), sizes=sizes).docs.collect() if r["taken"]}
    assert per_doc == named


def test_hypergeometric_draws(spark):
    rows = spark.range(4000).selectExpr(f"{mixing.hypergeometric('30L', '70L', '20L', '(id + 0.5D) / 4000D')} as x").collect()
    got = np.bincount([r[0] for r in rows], minlength=21) / 4000
    want = [math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20) for k in range(21)]
    assert np.abs(got - want).max() < 1e-3
    edges = spark.sql(f"select {mixing.hypergeometric('5L', '0L', '3L', '0.3D')}, {mixing.hypergeometric('0L', '5L', '3L', '0.3D')}").first()
    assert tuple(edges) == (3, 0)


def test_splitting_tree_shares_every_quota(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 7), (3, 1), (4, 0)], "at int, quota long")
    ranges = sorted((r["at"], r["start"], r["n"], r["shard"]) for r in mixing.shard_ranges(quotas, 11).collect())
    for at, total in ((1, 100), (2, 7), (3, 1)):
        position = 0
        for a, start, n, _ in ranges:
            if a == at:
                assert start == position
                position += n
        assert position == total
    per_shard = [sum(r[2] for r in ranges if r[3] == s) for s in range(11)]
    assert max(per_shard) - min(per_shard) <= 1 and sum(per_shard) == 108


def test_quality_measures_and_bands(spark, docs, nothing):
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(2000))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6)) for _ in range(900))
    repeated = "\n".join(f"{'same words in every line of the text and nothing else at all'} {i}" for i in range(400))
    extra = spark.createDataFrame([(2000, prose, "a", "en", 1), (2001, noise, "a", "en", 1), (2002, repeated, "a", "en", 1),
                                   (2003, "x # y\nx # y\n\n \nz", "a", "en", 1)], DOCS)
    got = {r["doc_id"]: r for r in quality.quality(docs.unionByName(extra), keep=("doc_id", "n_words")).collect()}
    assert got[2000]["n_words_in"] == 1 and got[2000]["n_words"] == 2000
    assert got[2001]["reason"] == "incompressible" and got[2002]["kept"] is False
    assert (got[2003]["n_symbols"], got[2003]["n_dup_lines"], got[2003]["n_words"]) == (2, 1, 7)
    for d, t, *_ in corpus():
        w = words(t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)} if len(w) < 1000 else set()
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert got[900]["ratio"] is None
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {d for d, r in got.items() if r["kept"] and (d is None or d < 2000)}
    assert quality.quality(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


RIGHTS = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать "
          "в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными "
          "настоящей Декларацией, без какого бы то ни было различия. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है "
          "और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है। "
          "कोई भी ग़ुलामी या दासता की हालत में न रखा जाएगा, ग़ुलामी-प्रथा और ग़ुलामों का व्यापार अपने सभी रूपों में निषिद्ध होगा।",
    "zh": "人人生而自由， 在尊严和权利上一律平等。 他们赋有理性和良心， 并应以兄弟关系的精神相对待。 人人有资格享有本宣言所载的一切权利和自由， "
          "不分种族、 肤色、 性别、 语言、 宗教、 政治或其他见解、 国籍或社会出身、 财产、 出生或其他身份等任何区别。",
}


def test_natural_prose_lies_inside_the_bands():
    import pyarrow as pa
    import zstandard
    from pydoc_data import topics

    packer = zstandard.ZstdCompressor(level=3)
    manual = "\n".join(t for _, t in sorted(topics.topics.items()) if "+---" not in t)  # prose, no tables
    english = [manual[i:i + n] for n in (300, 700, 2000, 8000, 30000, 100000) for i in range(0, len(manual) - n, 100000)]
    for texts in (english, list(RIGHTS.values())):
        got = quality.measure(pa.array(texts), quality.Bands(), packer)
        assert sum(not b for b in got["base_failed"]) >= 0.4 * len(texts)
        assert {r for r, b in zip(got["reason"], got["base_failed"], strict=True) if not b} == {None}
    rng = random.Random(8)
    few = [" ".join(rng.choice([8 * c for c in "abcdefghijklmnop"]) for _ in range(n)) for n in (300, 3000)]
    noise = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=40)).replace(" ", "") for _ in range(200)]
    got = quality.measure(pa.array([*few, " ".join(noise)]), quality.Bands(), packer)
    assert got["reason"] == ["repetitive", "repetitive", "incompressible"]


def test_packing_is_an_exact_cut(spark, docs, nothing):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer.DEFAULT)
    extra = spark.createDataFrame([(3000, "a<|endoftext|>b é 漢字", "a", "en", 1)], DOCS)
    source = docs.filter("doc_id is not null").unionByName(extra)
    texts = {r["doc_id"]: r["text"] or "" for r in source.collect()}
    ids = {d: np.array([*reference.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    at, sequences = dict.fromkeys(ids, 0), {}
    for r in sorted(packing.pack(source).collect(), key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert bytes(r["payload"]) == own[r["start"]:r["start"] + r["length"]].tobytes()
        at[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(v) for d, v in ids.items()}
    used = 0
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
        used += end
    assert 1024 * len(sequences) - used < 1024 + 12 * len(sequences)
    assert packing.pack(nothing).count() == 0


def test_plan_covers_any_histogram():
    rng = random.Random(7)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
        found = packing.plan(histogram, 64)
        used = dict.fromkeys(histogram, 0)
        for length, first, n, _, _ in sorted(found.fits):
            assert first == used[length]
            used[length] += n
        for length, first, _ in found.rest:
            assert used[length] == first
            used[length] = histogram[length]
        assert used == histogram
    a = np.array([[1.0, 1, 0], [1, 0, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([3.0, 1])), [3, 1])


def test_token_counts_cross_blocks(spark, docs, nothing):
    source = docs.filter("doc_id is not null")
    blocks, names = tokencounts.write_flat(source, block=64)
    got = {r["doc_id"]: r["n_tokens"] for r in names.join(tokencounts.token_counts(blocks, block=64), ["file", "ordinal"]).collect()}
    assert got == {r["doc_id"]: len(tokenizer.ids(r["text"], special=False)) for r in source.collect()}
    assert tokencounts.count_tokens(nothing).count() == 0


def test_token_files_without_index(spark, tmp_path):
    np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2").tofile(tmp_path / "a.bin")
    rows = tokencounts.token_counts(tokencounts.read_flat(spark, str(tmp_path), block=2), block=2).collect()
    assert sorted((r["ordinal"], r["n_tokens"]) for r in rows) == [(0, 2), (1, 0), (2, 3)]


@pytest.mark.parametrize("group", [1, 3, 64])
def test_token_files_of_many_groups_and_wide_ids(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(tokencounts, "GROUP", group)
    drawn, want = np.random.default_rng(group), []
    wraps = 50256 + (1 << 16)  # the separator, if cut to 16 bits
    for name, share in (("a", 0.3), ("b", 0.01), ("c", 0.0), ("d", 1.0)):
        ids = np.where(drawn.random(157) < share, 50256, drawn.choice([7, wraps, 199_999], 157))
        ids.astype("<u4").tofile(tmp_path / f"{name}.bin")
        documents = "".join("|" if x == 50256 else "x" for x in ids).split("|")
        documents = documents if documents[-1] else documents[:-1]
        want += [(name, i, len(d)) for i, d in enumerate(documents)]
    (tmp_path / "e.bin").write_bytes(b"")
    rows = tokencounts.token_counts(tokencounts.read_flat(spark, str(tmp_path), 4, "<u4"), block=4, kind="<u4").collect()
    assert sorted((r["file"][-5], r["ordinal"], r["n_tokens"]) for r in rows) == sorted(want)


def test_width_of_token_ids_follows_the_tokenizer(monkeypatch):
    assert tokencounts.id_type() == "<u2"
    assert tokencounts.id_type(end_id=1 << 16) == "<u4"


def test_url_rules_nest(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.example.net", "/en/x"), ("allow", "org", "/fr/"), ("block", None, "/")]
    addresses = ["http://A.Example.NET/en/xy?q", "https://b.example.net/en/", "http://example.net", "http://net/", "http://notnet.org/fr/a#b", "http://org/de",
                 "no scheme", None, "", "x://?a", "http://aexample.net/en/q", "http://example.net.org/fr/", "http://example.net/en/", "http://a.b.example.net:80/en/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(addresses * 2)], "page_id long, url string, rule string")
    got = urls.judge(pages, spark.createDataFrame(rules, "action string, host string, path string")).collect()
    assert len(got) == 2 * len(addresses)
    for r in got:
        u = r["url"] or ""
        rest = u.partition("://")[2]
        host = re.split(r"[/?#]", rest)[0].lower()
        path = re.split(r"[?#]", rest)[0][len(host):]
        fit = [(len(h + p), h + p, a) for a, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (max(fit)[1:] if fit else (None, "allow"))
    none = spark.createDataFrame([], "action string, host string, path string")
    assert {r["verdict"] for r in urls.judge(pages, none).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), none).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    centres = rng.standard_normal((12, 16))
    m = (centres[rng.integers(0, 12, 1500)] + 0.7 * rng.standard_normal((1500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [None] + [1.0] * 15), (5300, [float("nan")] * 16), (5400, [float("inf")] * 16), (5500, [1.0]), (None, [1.0] * 16),
           (1600, rows[0][1]), (1601, rows[0][1]), (7, rows[7][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    o = neighbours.Options(leaf=100)
    found = {}
    for r in neighbours.nearest(table, o=o).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    all_ = dict(rows) | {1600: rows[0][1], 1601: rows[0][1]}
    ids, x = np.array(list(all_)), np.array(list(all_.values()), np.float64)
    assert set(found) == set(range(0, 1500, 100)) | {1600}
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - np.array(all_[q])) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(best) & {v for _, _, v in got})
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert all(s == pytest.approx(d[np.flatnonzero(ids == v)[0]], abs=1e-12) for _, s, v in got)
    assert hits >= 0.9 * 10 * len(found)
    assert [v for _, _, v in found[0][:2]] == [1600, 1601]
    assert neighbours.nearest(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 3, math.sqrt(2))]


def test_language_of_pages(spark, nothing):
    rng = random.Random(9)
    letters = {"en": "etaoinshr", "de": "enisratdu", "fr": "esaitnrul"}
    common = {"en": "the and of that with", "de": "der und ist nicht ein", "fr": "les des est dans que"}
    text = lambda g, n: " ".join(rng.choice(common[g].split()) if rng.random() < 0.5 else "".join(rng.choice(letters[g]) for _ in range(5)) for _ in range(n))
    labelled = spark.createDataFrame([(i, text(g, 60), g) for i in range(90) for g in [("en", "de", "fr")[i % 3]]], "doc_id long, text string, lang string")
    rows, truth = [], {}
    for i in range(120):
        g = ("en", "de", "fr")[i % 3]
        said = g if i % 5 else "en"  # some pages declare what their server sets
        truth[i] = g
        rows.append((i, f"http://{g}{i % 4}.example.org/x", f"<html lang='{said}'><script>var the = 1</script><p>{text(g, 40)}</p></html>"))
    rows += [(500, None, None), (501, "http://fr1.example.org/", ""), (502, "nothing", "<html LANG=de>")]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["lang"] == g for i, g in truth.items()) >= 0.97 * len(truth)
    assert got[501]["lang"] == "fr" and got[502]["lang"] == "de" and got[500]["lang"] in letters
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["lang"] for r in language.identify(pages, nothing).collect()} == {None}
    assert language.identify(pages.limit(0), labelled).count() == 0


def test_pipeline_stages_on_odd_rows(spark, docs):
    import corpus_pipeline

    frame = docs.withColumnRenamed("n_words", "n_chars")
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, frame, "")
        if i < 4:
            assert out.columns == frame.columns
    kept = frame
    for _, function in corpus_pipeline.STAGES[:3]:
        kept = function(spark, kept, "")
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids and len(ids) == len(set(ids))
    assert not {900, 901, 902, 903} & set(ids)


def test_neighbours_with_a_dominating_component(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((1500, 8))
    m[:, 0] = 1000 + 0.1 * rng.standard_normal(1500)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    got = {}
    o = neighbours.Options(leaf=100, degree=16, pool=24)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), o=o).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 100):
        d = ((m - m[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    print("recall", hits / 150)
    assert hits >= 0.9 * 150


def test_neighbours_of_many_copies(spark):
    rng = np.random.default_rng(3)
    vectors = {i: (np.ones(4) if i % 3 == 0 else rng.standard_normal(4)).tolist() for i in range(400)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in (0, 100, 200, 300):
        order = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)
        assert got[q] == [i for _, i in order[:10]]
