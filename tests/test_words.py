import os
import random
import re

import pytest
from pyspark.sql import functions as F

from textvane.functions import text as X
from textvane.operators import compound, counts, lexicon, spelling
from textvane.operators.cleaning import clean_texts
from textvane.sources.textfiles import read_labelled_dirs, read_lines, write_labelled_dirs


def by_repr(values):
    return sorted(values, key=repr)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_token_class_is_a_range(spark):
    got = one(spark, "NH3-kuldeanlegg «x» café løft a~b {c} àd", X.words)
    assert got == ["nh", "kuldeanlegg", "«x»", "caf", "løft", "a~b", "{c}", "àd"]


def test_bow_tokens(spark):
    assert one(spark, "a,b. c's [d]", X.bow_tokens) == ["a", ",", "b", ".", "c", "'", "s", "[", "d", "]"]
    assert one(spark, "", X.bow_tokens) == [""]
    assert one(spark, "de en to", lambda c: X.bow_tokens(c, ["en"])) == ["de", "to"]


@pytest.mark.parametrize("path, want", [("/a//b/?q", "/a/b?q"), ("/a//b/;x?q", "/a/b;x?q"), ("/a///", "/a"), ("/a;x//y", "/a;x//y")])
def test_normalise_path(spark, path, want):
    assert one(spark, path, X.normalise_path) == want


def test_small_text_functions(spark):
    assert one(spark, "announcementDate2", X.snake_case) == "announcement_date_2"
    assert one(spark, "/i/img_flag_no.small.png", X.path_stem) == "no"
    assert one(spark, "Fylke: Oslo", lambda c: X.strip_prefix(c, "Fylke: ")) == "Oslo"
    assert one(spark, "1970-01-02", X.date_millis) == 86400000
    assert one(spark, "no date", X.date_millis) is None


DROPPED = [
    "*" * 72,
    "* Copyright 2006 The University *",
    "* under the terms of the licence *",
    "* see <http://example.org/licenses/>.*",
    "156248\t$\t$\tsubst normert\t000\t0",
    "156550\t’kke\t’kke\tadv unormert\t695\t0",
    "10\t-akter\t-akteren\tsubst mask\t711\t2",
    "86622\tAP-velger\tAP-velgerne\tsubst mask\t712\t4",
    "396\tAS\tA.S\tfork subst\t000\t0",
    "396\tAS\tA/S\tfork subst\t000\t0",
    "86667\tArbeiderparti-byråd\tArbeiderparti-byråd\tsubst\t700\t1",
]


def test_dictionary_lines_of_another_form_are_dropped(spark, rows):
    lines = spark.createDataFrame([(t, i) for i, t in enumerate(DROPPED + ["1\ta\ta\tsymb", "2\tåvokster\tåvokstrene\tsubst ub"])], "line string, line_no int")
    assert rows(lexicon.parse_dictionary(lines).drop("line_no")) == by_repr([("a", "a", "symb"), ("åvokster", "åvokstrene", "subst")])


def test_charset_and_line_order(spark, tmp_path):
    body = "1\tløft\tløftene\tsubst x\n\n" + "".join(f"{i}\tord\tord\tsubst\n" for i in range(50)) + "9\tåre\tårer\tsubst"
    (tmp_path / "words.txt").write_bytes(body.encode("iso-8859-1"))
    got = [r[0] for r in read_lines(spark, str(tmp_path / "words.txt")).orderBy("line_no").collect()]
    assert got == [t for t in body.split("\n") if t]


def test_labelled_dirs(spark, rows, tmp_path):
    for label, name, text in (("sport", "1", "ball\nmål"), ("news", "1", "avis")):
        (tmp_path / label).mkdir()
        (tmp_path / label / name).write_text(text)
    assert rows(read_labelled_dirs(spark, str(tmp_path))) == by_repr([("news", "avis"), ("sport", "ball\nmål")])


def test_labelled_texts_are_written_by_the_tasks_one_a_file(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("textvane.sources.textfiles.FOLDER_TEXTS", 3)
    texts = [("in_no", "ball\nmål"), ("in_no", "ball\nmål"), (None, "x"), ("", ""), ("a/b:c%", None), *[("in_en", f"t{i}") for i in range(9)]]
    df = spark.createDataFrame(texts, "label string, text string").repartition(2)
    plain, ours = str(tmp_path / "plain"), str(tmp_path / "ours")
    df.write.option("maxRecordsPerFile", 1).partitionBy("label").text(plain)
    folders = write_labelled_dirs(df, ours)
    assert len(folders) > 2 and len(list((tmp_path / "ours").rglob("*.txt"))) == len(texts)
    (tmp_path / "ours" / "lost-000000" / "label=in_no").mkdir(parents=True)
    (tmp_path / "ours" / "lost-000000" / "label=in_no" / "000000000.txt").write_text("of a lost try")
    assert rows(read_labelled_dirs(spark, folders)) == rows(read_labelled_dirs(spark, plain))
    assert rows(read_labelled_dirs(spark, write_labelled_dirs(df.limit(0), str(tmp_path / "none")))) == []


def test_folders_of_texts_are_listed_by_the_tasks_that_read_them(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("textvane.sources.textfiles.FOLDER_TEXTS", 4)
    monkeypatch.setattr("textvane.sources.textfiles.READ_BYTES", 20)
    df = spark.createDataFrame([(f"in_{i % 3}", f"tekst {i} å") for i in range(30)], "label string, text string").repartition(3)
    folders = write_labelled_dirs(df, str(tmp_path / "ours"))
    # Files named after the reader was made are read too: nobody listed them before.
    read = read_labelled_dirs(spark, folders)
    (tmp_path / "ours" / os.path.basename(folders[0]) / "label=late").mkdir()
    (tmp_path / "ours" / os.path.basename(folders[0]) / "label=late" / "0.txt").write_bytes(b"late\xff\n")
    assert not read.inputFiles() and "FileScan" not in read._jdf.queryExecution().toString()
    got = {(r["label"], bytes(r["raw"])) for r in read.select("label", F.col("text").cast("binary").alias("raw")).collect()}
    assert got == {(f"label=in_{i % 3}", f"tekst {i} å\n".encode()) for i in range(30)} | {("label=late", b"late\xff\n")}
    assert read.count() == 31
    odd = spark.createDataFrame([(label, "x") for label in ("på ny", "a|b<c>", "50%", "d`e~f", "g}h,i@j", "k\u00a0l\u2003m", "50 %25+&;$!()")], "label string, text string").coalesce(1)
    folders = write_labelled_dirs(odd, str(tmp_path / "odd"))
    assert rows(read_labelled_dirs(spark, folders)) == rows(read_labelled_dirs(spark, str(tmp_path / "odd")))


def entries(spark, *pairs):
    return spark.createDataFrame([(b, f, "subst", i) for i, (b, f) in enumerate(pairs)], "base string, full string, clazz string, line_no int")


def test_lemmas_and_endings(spark, rows):
    e = entries(spark, ("hus", "huset"), ("hus", "hus"), ("bad", "bader"), ("bade", "bader"), ("bade", "bade"), ("hus", "husene"))
    assert rows(lexicon.lemma_table(e)) == by_repr([("bade", "bade"), ("bader", "bad"), ("hus", "hus"), ("huset", "hus"), ("husene", "hus")])
    assert rows(lexicon.alt_endings(e)) == by_repr([("bade", "bader", "r"), ("hus", "huset", "et"), ("hus", "husene", "ene")])
    assert rows(lexicon.alts(spark.createDataFrame([("huset",)], "word string"), e)) == by_repr([("huset", "hus"), ("huset", "huset"), ("huset", "husene")])
    words = spark.createDataFrame([("bader",), ("ukjent",)], "word string")
    assert rows(lexicon.lemmatise(words, lexicon.lemma_table(e))) == by_repr([("bad",), ("ukjent",)])
    assert rows(lexicon.last_base_table(e, 5)) == by_repr([("bader", "bade"), ("huset", "hus"), ("husene", "hus")])
    long = "x" * 45
    e = entries(spark, ("x", long), ("x", long + "er"), ("x", "x"))
    assert (long, long + "er", "er") in rows(lexicon.alt_endings(e))


def test_frequency_list(spark, rows):
    lines = spark.createDataFrame([("  12 huset", 0), ("11 Og 5", 1), ("x 3", 2), ("9  to", 3)], "line string, line_no int")
    e = entries(spark, ("hus", "huset"))
    assert rows(lexicon.parse_frequency_list(lines, lexicon.lemma_table(e))) == by_repr([(0, "hus"), (1, "Og")])
    assert rows(counts.top_words(lexicon.parse_frequency_list(lines), 1)) == by_repr([("huset",)])


def test_counts_saturate(spark, rows):
    a = spark.createDataFrame([("x", 2147483647), ("y", 1)], "word string, cnt bigint")
    b = spark.createDataFrame([("x", 5), ("y", 5)], "word string, cnt bigint")
    assert rows(counts.merge_counts(a, b)) == by_repr([("x", 2147483647), ("y", 6)])


def corrected(spark, words, dictionary):
    w = spark.createDataFrame([(x,) for x in words], "word string")
    d = spark.createDataFrame(dictionary, "word string, cnt bigint")
    return {r["word"]: r["corrected"] for r in spelling.spell_correct(w, d).collect()}


def test_correction_cases(spark):
    known = [("saftig", 4), ("saftige", 5)]
    want = {"sfatig": "saftig", "sfatige": "saftige", "sfaty": "sfaty", "saftig": "saftig"}
    assert corrected(spark, list(want), known) == want


def python_edits(word):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    out |= {a + c + b[1:] for a, b in cuts if b for c in X.EDIT_LETTERS}
    return out | {a + c + b for a, b in cuts for c in X.EDIT_LETTERS}


def python_correct(word, known):
    def best(found):
        return min(found, key=lambda w: (-known[w], w))

    if word in known:
        return word
    near = python_edits(word) & known.keys()
    if near:
        return best(near)
    far = {w for m in python_edits(word) for w in python_edits(m)} & known.keys()
    return best(far) if far else word


def test_correction_equals_brute_force(spark):
    pick = random.Random(3)

    def word(letters, most):
        return "".join(pick.choice(letters) for _ in range(pick.randint(1, most)))

    # "à" and "{" may be kept, moved or removed by an edit, but not brought in.
    known = {word("abà{", 6): pick.randint(1, 5) for _ in range(60)} | {word("abcd", 7): pick.randint(1, 5) for _ in range(60)}
    asked = sorted({word("abcà{", 7) for _ in range(60)})
    assert corrected(spark, asked, list(known.items())) == {w: python_correct(w, known) for w in asked}


def test_correction_of_long_words(spark):
    pick = random.Random(5)
    known = {"".join(pick.choice("abcdefgh") for _ in range(n)): i + 1 for i, n in enumerate([38, 39, 40, 41, 42, 43, 44, 60, 75])}
    asked = {}
    for w in known:
        for _ in range(4):
            m = w
            for _ in range(2):
                i, kind = pick.randrange(len(m) - 1), pick.randrange(4)
                m = [m[:i] + m[i + 1:], m[:i] + m[i + 1] + m[i] + m[i + 2:], m[:i] + "z" + m[i + 1:], m[:i] + "y" + m[i:]][kind]
            asked[m] = w if m not in known else m
        asked["zz" + w + "z"] = "zz" + w + "z"
    assert corrected(spark, list(asked), list(known.items())) == asked


LEXICON = ["aaaaaa", "aaaaaas", "bbbbbb", "sbbbbbb", "aaaaaasbbbbbb", "cccccc"]


def lex(spark, words, bases=None):
    return spark.createDataFrame([(w, (bases or {}).get(w, w)) for w in words], "full string, base string")


def words_of(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_two_part_splits(spark, rows):
    got = compound.split_once(words_of(spark, "aaaaaasbbbbbb", "short"), lex(spark, LEXICON)).select("head", "tail")
    assert rows(got) == by_repr([("aaaaaa", "bbbbbb"), ("aaaaaa", "sbbbbbb"), ("aaaaaas", "bbbbbb")])
    own = lex(spark, LEXICON, {"aaaaaasbbbbbb": "aaaaaa"})
    assert rows(compound.split_once(words_of(spark, "aaaaaasbbbbbb"), own).select("head", "tail")) == by_repr([("aaaaaas", "bbbbbb")])


def test_shortest_and_all_splits(spark):
    w = words_of(spark, "aaaaaasbbbbbbcccccc", "aaaaaasbbbbbb", "unknownunknown")
    got = {r["word"]: r["parts"] for r in compound.split_shortest(w, lex(spark, LEXICON)).collect()}
    assert got == {
        "aaaaaasbbbbbbcccccc": ["aaaaaa", "bbbbbb", "cccccc"],
        "aaaaaasbbbbbb": ["aaaaaa", "bbbbbb"],
        "unknownunknown": ["unknownunknown"],
    }
    every = [tuple(r["parts"]) for r in compound.split_all(w, lex(spark, LEXICON)).collect() if r["word"].endswith("cccccc")]
    assert sorted(every) == [("aaaaaa", "bbbbbb", "cccccc"), ("aaaaaa", "sbbbbbb", "cccccc"), ("aaaaaas", "bbbbbb", "cccccc")]


def test_splits_give_the_word_back(spark):
    pick = random.Random(1)
    stems = ["".join(pick.choice("abcst") for _ in range(pick.randint(6, 9))) for _ in range(30)]
    pairs = [pick.choice(["", "e", "s", "a", "er"]).join(pick.sample(stems, 2)) for _ in range(20)]
    # Longer ones split when a pair in them is itself a dictionary word.
    planted = pairs + [p + pick.choice(["", "s", "er"]) + pick.choice(stems) for p in pairs]
    for r in compound.split_shortest(words_of(spark, *planted), lex(spark, stems + pairs)).collect():
        rest = r["word"]
        for i, part in enumerate(r["parts"]):
            cut = next(b for b in ("", "e", "s", "a", "er") if (i or b == "") and rest.startswith(b + part))
            rest = rest[len(cut + part):]
        assert rest == "" and len(r["parts"]) > 1 + (r["word"] not in pairs)


def test_cleaning(spark):
    items = spark.createDataFrame([(1, "Sfatige aaaaaasbbbbbb husene"), (2, "!!!")], "item bigint, text string")
    e = entries(spark, ("hus", "husene"), ("aaaaaa", "aaaaaa"), ("bbbbbb", "bbbbbb"), ("saftig", "saftige"))
    known = spark.createDataFrame([(w, 5) for w in ("saftige", "husene", "aaaaaasbbbbbb")], "word string, cnt bigint")
    got = dict(map(tuple, clean_texts(items, e, known).collect()))
    assert got == {1: "saftig aaaaaa bbbbbb hus", 2: ""}
    # With the batch counted first every word is known and stays as it is spelled.
    got = dict(map(tuple, clean_texts(items, e, known, count_batch=True).collect()))
    assert got[1] == "sfatige aaaaaa bbbbbb hus"


def test_vocabulary_is_dense(spark):
    words = words_of(spark, *[f"w{i % 500}" for i in range(1000)])
    got = {r["word"]: r["idx"] for r in counts.vocab_index(words).collect()}
    assert sorted(got.values()) == list(range(501)) and "DEFAULT" in got


def test_counts_in_row_move_nothing_and_match_a_plain_count(spark):
    texts = [None, "", "  ?! ", "b a b", "x", "a b a, b-c! a " * 3000, " ".join(f"w{'abcdefghij'[i % 10]}" for i in range(997))]
    source = spark.createDataFrame(list(enumerate(texts)), "item int, text string")
    want = {}
    for item, text in enumerate(texts):
        for word in re.findall("[a-z{-æøå]+", (text or "").lower()) or [""]:
            want[item, word] = want.get((item, word), 0) + 1
    counted = counts.item_words(source)
    assert {(r["item"], r["word"]): r["n"] for r in counted.collect()} == want
    assert counted.count() == len(want) and dict(counted.dtypes)["n"] == "bigint"
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    tokens = spark.createDataFrame([(1, ["b", None, "a", "b", None]), (2, []), (3, None)], "item int, tokens array<string>")
    got = sorted(map(tuple, counts.term_counts(tokens, "tokens").collect()), key=repr)
    assert got == sorted([(1, None, 2), (1, "a", 1), (1, "b", 2)], key=repr)


def test_inflections_of_any_length_equal_brute_force(spark):
    pick = random.Random(4)
    stems = ["".join(pick.choice("ab") for _ in range(n)) for n in (1, 3, 39, 40, 41, 60)]
    entries = sorted({(b, b + "".join(pick.choice("ab") for _ in range(pick.randrange(4))) + pick.choice(["", b[:2], b])) for b in stems for _ in range(12)})
    df = spark.createDataFrame([(b, f, "subst", n) for n, (b, f) in enumerate(entries)], "base string, full string, clazz string, line_no long")
    lemma = {}
    for b, f in entries:
        lemma[f] = f if (f, f) in entries else lemma.get(f, b)
    want = {(w, f, f[len(w):]) for w, base in lemma.items() for b, f in entries if b == base and w in f and len(w) < len(f)}
    got = list(map(tuple, lexicon.alt_endings(df).collect()))
    assert len(want) > 50 and any(len(w) > 40 for w, _, _ in want)
    assert len(got) == len(set(got)) and set(got) == want
