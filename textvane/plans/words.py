"""Queries over tokens, counts and the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import BOW_PUNCTUATION, FREQ_WORD_CLASS, WORD_CLASS, bow_tokens, words
from ..operators import counts as C, lexicon as L
from ..operators.numbering import number_rows
from ..operators.skew import spread
from ..session import new_path, stage
from ..sources.textfiles import read_lines, write_lines
from . import roles as R
from .roles import table

# A word of this many documents counts as a dictionary word of the test tables.
MIN_DOCUMENTS = 3
STEM = 6


def word_documents(spark, sf_dir) -> DataFrame:
    """(word, cnt, df): tokens and documents of each word."""
    per_item = C.item_words(R.items(spark, sf_dir)).filter(F.col("word") != "")
    return per_item.groupBy("word").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("df"))


def staged_words(spark, sf_dir) -> DataFrame:
    """word_documents written once, for queries that read it several times."""
    return stage(word_documents(spark, sf_dir), "word_documents")


def dictionary(spark, sf_dir, counted: DataFrame | None = None) -> DataFrame:
    """(base, full, clazz, line_no): words of MIN_DOCUMENTS documents.

    Base form: the shortest word with the same first letters, of equal length the first one.
    """
    counted = staged_words(spark, sf_dir) if counted is None else counted
    known = counted.filter(F.col("df") >= MIN_DOCUMENTS).select(F.col("word").alias("full"))
    stem = F.when(F.length("full") >= STEM, F.substring("full", 1, STEM)).otherwise(F.col("full"))
    known = known.withColumn("stem", stem)
    bases = known.groupBy("stem").agg(F.min(F.struct(F.length("full"), "full")).alias("b"))
    return known.join(bases, "stem").select(
        F.col("b.full").alias("base"), "full", F.lit("subst").alias("clazz"), F.col("full").alias("line_no")
    )


SQL_WORD_DOCUMENTS = f"""
select word, cast(count(*) as bigint) as cnt, count(distinct item) as df from ({R.SQL_ITEM_TOKENS}) group by word"""
SQL_DICTIONARY = f"""
select full_ as "full", first_value(full_) over (partition by stem order by length(full_), full_) as base
from (select word as full_, case when length(word) >= {STEM} then word[1:{STEM}] else word end as stem
      from ({SQL_WORD_DOCUMENTS}) where df >= {MIN_DOCUMENTS})"""


def tokenise(spark, sf_dir):
    tokens = words(F.col("text"))
    return R.items(spark, sf_dir).select("item", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def bow_tokens_query(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    tokens = bow_tokens(F.col("text"), ["the", "de", "la"])
    return c.select("conv_id", "turn", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def word_count(spark, sf_dir):
    return C.word_count(R.item_tokens(R.items(spark, sf_dir)))


def merge_counts(spark, sf_dir):
    """Dictionary words saturated from the start, plus two batches of texts."""
    def batch(name, column):
        return C.word_count(table(spark, sf_dir, name).select(F.explode(words(F.col(column))).alias("word")))

    known = dictionary(spark, sf_dir).select(F.col("full").alias("word"), F.lit(C.COUNT_MAX).cast("bigint").alias("cnt"))
    return C.merge_counts(known, batch("conversations", "text"), batch("benchmark", "text"))


def _part_words(spark, sf_dir):
    return R.item_tokens(R.items(spark, sf_dir)).select("word")


def vocab_index(spark, sf_dir):
    return C.vocab_index(_part_words(spark, sf_dir))


def term_counts(spark, sf_dir):
    docs = R.items(spark, sf_dir).select("item", bow_tokens(F.col("text")).alias("tokens"))
    return C.term_counts(docs, "tokens")


def tfidf(spark, sf_dir):
    items = R.items(spark, sf_dir)
    weights = C.tfidf(stage(C.item_words(items), "item_words"), items.count())
    return weights.select("item", "word", "n", F.round("tfidf", 6).alias("tfidf"))


def stopword_candidates(spark, sf_dir):
    # Rounded before the ranking, so that both engines order equal weights alike.
    return C.stopword_candidates(tfidf(spark, sf_dir))


def _listed(spark, sf_dir) -> DataFrame:
    """A frequency list in an 8-bit charset, most frequent word first, read and mapped to lemmas."""
    counted = staged_words(spark, sf_dir)
    ordered = counted.orderBy(F.desc("cnt"), "word")
    path = new_path(spark, "frequency-list")
    write_lines(ordered.select(F.concat(F.lit("   "), "cnt", F.lit(" "), "word")), path)
    return L.parse_frequency_list(read_lines(spark, path), L.lemma_table(dictionary(spark, sf_dir, counted)))


def freq_list_parse(spark, sf_dir):
    return number_rows(_listed(spark, sf_dir), [F.col("line_no")], name="place").select("place", "word")


def top_words(spark, sf_dir):
    return C.top_words(_listed(spark, sf_dir))


def _dictionary_lines(spark, sf_dir):
    """Lines of raw neighbouring words: id TAB base TAB full TAB class."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    raw = docs.select("doc_id", "lang", F.split("text", r"[ \t\n]+").alias("w"))
    pairs = raw.select("doc_id", "lang", F.explode(F.arrays_zip(F.col("w").alias("b"), F.slice("w", 2, F.size("w")).alias("f"))).alias("p"))
    line = F.concat_ws("\t", "doc_id", "p.b", "p.f", F.concat("lang", F.lit(" normert")))
    return pairs.filter(F.col("p.f").isNotNull()).select(line.alias("line"), F.col("doc_id").alias("line_no"))


def dictionary_parse(spark, sf_dir):
    return L.parse_dictionary(_dictionary_lines(spark, sf_dir))


def dictionary_groups(spark, sf_dir):
    return L.dictionary_groups(dictionary(spark, sf_dir))


def lemmatise(spark, sf_dir):
    tokens = R.item_tokens(R.items(spark, sf_dir)).select("item", "pos", F.col("word").alias("raw"), "word")
    out = L.lemmatise(tokens, L.lemma_table(dictionary(spark, sf_dir)), "word", ["item", "pos"])
    return out.groupBy("item", "word").agg(F.count(F.lit(1)).alias("n"))


def inflections(spark, sf_dir):
    return L.alt_endings(dictionary(spark, sf_dir))


QUERIES = {
    "tokenise": tokenise,
    "bow_tokens": bow_tokens_query,
    "word_count": word_count,
    "merge_counts": merge_counts,
    "vocab_index": vocab_index,
    "term_counts": term_counts,
    "tfidf": tfidf,
    "stopword_candidates": stopword_candidates,
    "freq_list_parse": freq_list_parse,
    "top_words": top_words,
    "dictionary_parse": dictionary_parse,
    "dictionary_groups": dictionary_groups,
    "lemmatise": lemmatise,
    "inflections": inflections,
}

_BOW = BOW_PUNCTUATION.replace("'", "''")
SQL_BOW = rf"""string_split_regex(regexp_replace(regexp_replace(text, '{_BOW}', ' \1 ', 'g'), '^\s+|\s+$', '', 'g'), '\s+')"""
SQL_TFIDF = f"""
with c as ({R.SQL_ITEM_WORDS}), total as (select count(distinct item) as n_items from c),
d as (select word, count(*) as df from c group by word)
select item, c.word, n, round(n * ln(n_items / df), 6) as tfidf from c join d using (word), total"""
SQL_FREQ = f"""
select row_number() over (order by cnt desc, listed) as place, coalesce(base, parsed) as word from (
  select cnt, word as listed, regexp_extract(word, '^{FREQ_WORD_CLASS}+') as parsed from ({SQL_WORD_DOCUMENTS}))
left join ({SQL_DICTIONARY}) on "full" = parsed
where parsed <> ''"""

SQL = {
    "tokenise": f"""
select item, cast(len(tokens) as bigint) as n_tokens, array_to_string(tokens, ' ') as tokens from ({R.SQL_TOKEN_LISTS})""",
    "bow_tokens": f"""
select conv_id, turn, cast(len(t) as bigint) as n_tokens, array_to_string(t, ' ') as tokens
from (select conv_id, turn, list_filter({SQL_BOW}, lambda x: x not in ('the', 'de', 'la')) as t from conversations)""",
    "word_count": f"select word, count(*) as cnt from ({R.SQL_ITEM_TOKENS}) group by word",
    "merge_counts": f"""
select word, least(cast(sum(cnt) as bigint), 2147483647) as cnt from (
  select "full" as word, 2147483647 as cnt from ({SQL_DICTIONARY})
  union all select unnest(regexp_extract_all(lower(text), '{R.TOKEN_CLASS}+')), 1 from conversations
  union all select unnest(regexp_extract_all(lower(text), '{R.TOKEN_CLASS}+')), 1 from benchmark)
group by word""",
    "vocab_index": f"""
select word, row_number() over (order by md5(word), word) - 1 as idx
from (select distinct word from ({R.SQL_ITEM_TOKENS}) union select 'DEFAULT')""",
    "term_counts": f"""
select item, word, count(*) as n from (select doc_id as item, unnest({SQL_BOW}) as word from documents) group by item, word""",
    "tfidf": SQL_TFIDF,
    "stopword_candidates": f"""
select word, min(tfidf) as least from ({SQL_TFIDF}) group by word order by least desc, word limit 30""",
    "freq_list_parse": SQL_FREQ,
    "top_words": f"select distinct word from (select word from ({SQL_FREQ}) order by place limit 64)",
    "dictionary_parse": f"""
with raw as (select doc_id, lang, regexp_split_to_array(text, '[ \\t\\n]+') as w from documents),
pairs as (select doc_id, lang, unnest(w[:len(w) - 1]) as b, unnest(w[2:]) as f from raw)
select regexp_extract(b, '^{WORD_CLASS}+$') as base, regexp_extract(f, '^{WORD_CLASS}+$') as "full",
       regexp_extract(lang, '^{WORD_CLASS}+') as clazz, min(doc_id) as line_no
from pairs where regexp_matches(b, '^{WORD_CLASS}+$') and regexp_matches(f, '^{WORD_CLASS}+$')
  and regexp_matches(lang, '^{WORD_CLASS}+')
group by 1, 2, 3""",
    "dictionary_groups": f"""
select base, "full", count(*) over (partition by "full") as n_bases, count(*) over (partition by base) as n_fulls
from ({SQL_DICTIONARY})""",
    "lemmatise": f"""
select item, coalesce(base, t.word) as word, count(*) as n from ({R.SQL_ITEM_TOKENS}) t
left join ({SQL_DICTIONARY}) d on d."full" = t.word group by 1, 2""",
    "inflections": f"""
with d as ({SQL_DICTIONARY})
select w."full" as word, a."full" as alt, a."full"[length(w."full") + 1:] as ending
from d w join d a using (base)
where strpos(a."full", w."full") > 0 and length(w."full") < length(a."full")""",
}
