"""Word counts, vocabularies and tf-idf."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bow_tokens, words
from .numbering import number_distinct
from .skew import salted_join

# Fixed value: counts saturate at the largest 32-bit integer, which also marks dictionary words.
COUNT_MAX = 2147483647


def word_count(tokens: DataFrame) -> DataFrame:
    """(word, cnt) of a token table; counts combine before the shuffle."""
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum (word, cnt) tables, saturating at COUNT_MAX."""
    both = counts[0].select("word", F.col("cnt").cast("bigint").alias("cnt"))
    for other in counts[1:]:
        both = both.unionByName(other.select("word", F.col("cnt").cast("bigint").alias("cnt")))
    return both.groupBy("word").agg(F.least(F.sum("cnt"), F.lit(COUNT_MAX).cast("bigint")).alias("cnt"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often `use` reads it."""
    return F.transform(F.array(value), use)[0]


def counts_in_row(tokens: Column) -> Column:
    """The distinct tokens of an array with their counts, as an array of (word, n): the runs of the sorted array."""

    def runs(ordered: Column) -> Column:
        def begins(i: Column) -> Column:
            return (i == 0) | ~ordered[i].eqNullSafe(ordered[F.greatest(i - 1, F.lit(0))])

        def sized(begin: Column) -> Column:
            end = lambda k: F.coalesce(F.get(begin, k + 1), F.size(ordered))
            return F.transform(begin, lambda at, k: F.struct(ordered[at].alias("word"), (end(k) - at).cast("bigint").alias("n")))

        places = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), begins)
        return F.when(F.size(ordered) > 0, once(places, sized))

    return once(F.sort_array(tokens), runs)


def _unfold(source: DataFrame, tokens: Column) -> DataFrame:
    return source.select("item", F.explode(counts_in_row(tokens)).alias("_c")).select("item", "_c.word", "_c.n")


def item_words(source: DataFrame) -> DataFrame:
    """(item, word, n) of every (item, text), one row an item; one empty word for a text without words.

    Words are counted inside the row: neither texts nor tokens are moved.
    """
    return _unfold(source, once(words(F.col("text")), lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit("")))))


def item_bow_words(source: DataFrame) -> DataFrame:
    """(item, word, n) of the blank-joined tokens, as the linear models read them; one row an item."""
    return _unfold(source, bow_tokens(F.array_join(words(F.col("text")), " ")))


def term_counts(source: DataFrame, tokens_column: str) -> DataFrame:
    """(item, word, n) from an array column of tokens, one row an item."""
    return _unfold(source, F.col(tokens_column))


def vocab_index(words: DataFrame, sentinels: Iterable[str] = ("DEFAULT",)) -> DataFrame:
    """(word, idx): consecutive feature numbers of the distinct words and sentinel tokens."""
    extra = words.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in sentinels])).alias("word")
    )
    return number_distinct(words.select("word").unionByName(extra).distinct(), "word", "idx")


def tfidf(counts: DataFrame, n_items: int | None = None, hot: list | None = None) -> DataFrame:
    """(item, word, n, tfidf) with weight n * ln(N / df) over the items of `counts`.

    `counts` has one row per (item, word), so a document frequency is a plain count.
    """
    df_rows = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n_items = counts.select(F.countDistinct("item")).first()[0] if n_items is None else n_items
    # A word occurs once per item here: the hot words are those in many items.
    joined = salted_join(counts, df_rows, ["word"], "word", ["item"], "inner", hot)
    weight = F.col("n") * F.log(F.lit(float(n_items)) / F.col("df"))
    return joined.select(*counts.columns, weight.alias("tfidf"))


def user_tfidf(examples: DataFrame, hot: list | None = None) -> DataFrame:
    """(user, item, word, n, tfidf, held_out) of (user, item, word, n) rows, one for each word of a labelled item.

    tfidf is n * ln(N / df) over the user's own N labelled items; held_out is what it is without the item itself,
    by subtraction, and null for a word that no other item of the user has.
    """
    in_items = examples.groupBy("user", "word").agg(F.count(F.lit(1)).alias("df"))
    sizes = examples.groupBy("user", "item").agg(F.lit(1).alias("one")).groupBy("user").agg(F.count(F.lit(1)).alias("items"))
    # One short row a user: a shuffle by user would put all rows of a few users on as few tasks.
    joined = salted_join(examples, in_items, ["user", "word"], "word", ["item"], "inner", hot).join(F.broadcast(sizes), "user")
    others = F.when(F.col("df") > 1, F.col("n") * F.log((F.col("items") - 1) / (F.col("df") - 1)))
    return joined.select("user", "item", "word", "n", (F.col("n") * F.log(F.col("items") / F.col("df"))).alias("tfidf"), others.alias("held_out"))


def stopword_candidates(weights: DataFrame, top: int = 30) -> DataFrame:
    """The `top` words by their least tf-idf weight, greatest first."""
    least = weights.groupBy("word").agg(F.min("tfidf").alias("least"))
    return least.orderBy(F.desc("least"), "word").limit(top)


def top_words(ranked: DataFrame, top: int = 64) -> DataFrame:
    """The distinct words of the first `top` entries of a frequency list (line_no, word)."""
    return ranked.orderBy("line_no").limit(top).select("word").distinct()
