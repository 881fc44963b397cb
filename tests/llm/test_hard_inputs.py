"""Inputs made to break hashing, tokenising and markup: same words in mirrored order, long blank runs, hostile pages."""

import hashlib
import random
import re
import time

import pytest
import tokenizers
from pyspark.sql import functions as F

from textvane.llm import automata, jaccard, language, packing, suffixes, tokencounts, tokenizer

DOCS = "doc_id long, text string"


def mirrored(letters, doublings):
    """A word of 2**doublings letters in which every polynomial modulo a power of two sees its swap as equal."""
    word = letters[0]
    for _ in range(doublings):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def test_mirrored_words_and_texts_are_no_copies(spark):
    rng = random.Random(1)
    tail = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    one, two = mirrored("ab", 10)
    rows = [(1, " ".join([one, *tail])), (2, " ".join([two, *tail])), (3, " ".join(one)), (4, " ".join(two)), (5, " ".join(one) + " z")]
    docs = spark.createDataFrame(rows, DOCS)
    component = {r["doc_id"]: r["component_id"] for r in jaccard.linked_classes(docs, jaccard.Rule(60, 99, 100)).collect()}
    assert component[2] == 2
    for dedup, window in ((automata.dedup, 13), (suffixes.dedup, 50)):
        seen, want = set(), {}
        for doc, text in rows:
            w = text.split()
            grams = [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]
            want[doc] = len({i + k for i, g in enumerate(grams) if g in seen for k in range(window)})
            seen |= set(grams)
        assert want[2] == 60
        assert {r["doc_id"]: r["n_removed"] for r in dedup(docs).rows.collect()} == want


def test_documents_with_two_texts_are_one_document(spark):
    rng = random.Random(2)
    x, y = ([f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(2))
    rows = [(5, " ".join(x)), (5, " ".join(y)), (9, " ".join([*x, "more"])), (11, " ".join([*y, "more"])), (12, "other words")]
    for _ in range(2):
        got = jaccard.linked_classes(spark.createDataFrame(rows, DOCS).repartition(3), jaccard.Rule(3, 80, 100)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (9, 5), (11, 5), (12, 12)}


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n", "　 ", "\r\n"])
def test_long_blank_runs_have_the_ids_of_the_files_own_library(blank):
    own = tokenizers.Tokenizer.from_file(tokenizer.DEFAULT)
    for before, after in (("", ""), ("abc", "def"), ("a ", "\nb"), ("it's ", "  x")):
        text = 2 * (before + (blank * 15_000)[:15_000] + after)
        assert tokenizer.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_texts_of_blanks_alone_are_packed_and_counted(spark):
    rows = [(1, " " * 2_000_000), (2, "\n" * 1_500_000 + "end"), (3, "a" + " \t" * 700_000 + "b")]
    docs = spark.createDataFrame(rows, DOCS)
    want = {i: len(tokenizer.ids(t)) + 1 for i, t in rows}
    packed = packing.pack(docs, payload=F.crc32).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == want
    counted = {r["doc_id"]: r for r in tokencounts.count_tokens(docs).collect()}
    assert set(counted) == {1, 2, 3}


def test_page_text_is_its_pattern():
    pattern = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(3)
    parts = ["<", ">", "<script", "</script>", "</SCRIPT >", "<style>", "</style>", "<!--", "-->", "a", "<b>", " ", "--", "!", "<scripted>"]
    for _ in range(20_000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert language.page_text(html) == pattern.sub(" ", html)


@pytest.mark.parametrize("part", ["<", "<script ", "<!-- ", "<script><", "<html ", "<html lang = "])
def test_hostile_pages_take_linear_time(spark, part):
    html = part * (1_000_000 // len(part))
    begin = time.monotonic()
    language.page_text(html)
    page = spark.createDataFrame([(html,)], "html string").select(language._declared(F.col("html"))).collect()
    assert page[0][0] in ("", None) and time.monotonic() - begin < 20


def test_declared_language_is_that_of_the_first_html_tag(spark):
    pages = ["<HTML class=x LANG='DE'>", '<!doctype html>\n<html\nlang = "fr-CA">', "<html>lang=it</html>", "<htmlx lang=es>", "", "İ<html lang=nb"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select("i", language._declared(F.col("html")).alias("d"))
    assert [r["d"] for r in rows.orderBy("i").collect()] == ["de", "fr", "", "", "", "nb"]


def test_word_hashes_have_no_short_repeats():
    import pyarrow as pa
    from textvane.llm import words

    rng = random.Random(4)
    vocabulary = {"".join(rng.choice("abé日") for _ in range(rng.randrange(1, 120))) for _ in range(5000)}
    column = pa.array(sorted(vocabulary))
    w = words.split(column)
    assert len(set(w.hash.tolist())) == len(set(w.hash2.tolist())) == len(vocabulary)
    again = words.split(pa.array([" ".join(sorted(vocabulary))]))
    assert again.hash.tolist() == w.hash.tolist() and hashlib.sha256(again.text(0, 3)).digest()
