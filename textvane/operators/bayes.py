"""Multinomial naive Bayes for many users at once.

Per-label figures lie in one column per label, so a word meets a user's model once and all
labels of a pair are scored in one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .skew import hot_values, salted_join
from .tables import LABELS

# The smoothing of word and class counts (the latter is added twice).
WORD_SMOOTHING = 0.05
CLASS_SMOOTHING = 0.01


@dataclass
class NaiveBayes:
    """classes: user, docs_i, tokens_i, vocab; words: user, word, docs, wc_i (i = place in labels)."""

    classes: DataFrame
    words: DataFrame
    labels: Sequence[str] = LABELS


def training_examples(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(user, item, label, word, n): the word counts of each labelled item."""
    return labels.select("user", "item", "label").join(counts, "item").select("user", "item", "label", "word", "n")


def fit(examples: DataFrame, labels: Sequence[str] = LABELS) -> NaiveBayes:
    """Sufficient statistics of every user, by aggregates that combine before the shuffle."""
    def of(i: int, value: Column) -> Column:
        return F.when(F.col("label") == labels[i], value).otherwise(0)

    places = range(len(labels))
    words = examples.groupBy("user", "word").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(of(i, F.col("n"))).alias(f"wc_{i}") for i in places]
    )
    per_item = examples.groupBy("user", "item", "label").agg(F.sum("n").alias("len"))
    sizes = per_item.groupBy("user").agg(
        *[F.sum(of(i, F.lit(1))).cast("bigint").alias(f"docs_{i}") for i in places],
        *[F.sum(of(i, F.col("len"))).alias(f"tokens_{i}") for i in places],
    )
    vocab = words.groupBy("user").agg(F.count(F.lit(1)).alias("vocab"))
    return NaiveBayes(sizes.join(vocab, "user"), words, labels)


def _posterior(out: DataFrame, places: range, keep: Sequence[Column]) -> DataFrame:
    """p_i by soft-max of s_i over the labels the user has given; 0 for the others."""
    known = [F.when(F.col(f"d_{i}") > 0, F.col(f"s_{i}")) for i in places]
    top = F.greatest(*known)
    parts = [F.coalesce(F.exp(k - top), F.lit(0.0)) for k in known]
    total = sum(parts[1:], parts[0])
    return out.select(*keep, *[F.col(f"s_{i}").alias(f"s_{i}") for i in places], *[(p / total).alias(f"p_{i}") for i, p in zip(places, parts)])


def _start(i: int) -> Column:
    """The score of a text of `len` tokens if the model knew none of its words."""
    denom = F.log(F.col(f"tokens_{i}") + F.col("vocab") * WORD_SMOOTHING)
    return F.log(F.col(f"docs_{i}") + 2 * CLASS_SMOOTHING) + F.col("len") * (F.log(F.lit(WORD_SMOOTHING)) - denom)


def standing(rows: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(user, item, s_i, p_i) of rows with the user's class figures, the item's len, and what known words add (g_i, or null)."""
    places = range(len(labels))
    scored = rows.select("user", "item", *[F.col(f"docs_{i}").alias(f"d_{i}") for i in places],
                         *[(_start(i) + F.coalesce(f"g_{i}", F.lit(0.0))).alias(f"s_{i}") for i in places])
    return _posterior(scored, places, [F.col("user"), F.col("item")])


def score(model: NaiveBayes, pairs: DataFrame, counts: DataFrame, hot: list | None = None) -> DataFrame:
    """(user, item, s_i, p_i) for the asked (user, item) pairs.

    Every token contributes the term of an unseen word; words the user's model knows add the
    difference. Both kinds of rows are summed in one aggregation by (user, item).
    """
    places = range(len(model.labels))
    lengths = counts.groupBy("item").agg(F.sum("n").alias("len"))
    base = pairs.select("user", "item").join(model.classes, "user").join(lengths, "item")
    unseen = F.log(F.lit(WORD_SMOOTHING))
    base = base.select(
        "user", "item", *[_start(i).alias(f"s_{i}") for i in places], *[F.col(f"docs_{i}").alias(f"d_{i}") for i in places]
    )
    # The logarithm is taken once per model word, before the words meet the tokens.
    gains = model.words.select(
        "user", "word", *[(F.log(F.col(f"wc_{i}") + WORD_SMOOTHING) - unseen).alias(f"g_{i}") for i in places]
    )
    seen = salted_join(counts, gains, ["word"], "word", ["item"], "inner", hot)
    seen = seen.select(
        "user",
        "item",
        *[(F.col("n") * F.col(f"g_{i}")).alias(f"s_{i}") for i in places],
        *[F.lit(None).cast("bigint").alias(f"d_{i}") for i in places],
    )
    sums = base.unionByName(seen).groupBy("user", "item").agg(
        *[F.sum(f"s_{i}").alias(f"s_{i}") for i in places], *[F.max(f"d_{i}").alias(f"d_{i}") for i in places]
    )
    # Pairs that were not asked for have no base row.
    return _posterior(sums.filter(F.col("d_0").isNotNull()), places, [F.col("user"), F.col("item")])


def leave_one_out(model: NaiveBayes, examples: DataFrame, hot: list | None = None) -> DataFrame:
    """(user, item, label, s_i, p_i): each example scored by a model that has not seen it.

    The example's own counts are taken off the user's statistics, which equals a refit.
    """
    places = range(len(model.labels))
    hot = hot_values(examples, "word") if hot is None else hot
    joined = salted_join(examples, model.words, ["user", "word"], "word", ["item"], "inner", hot)
    unseen = F.log(F.lit(WORD_SMOOTHING))

    def own(i: int, value: Column) -> Column:
        return F.when(F.col("label") == model.labels[i], value).otherwise(0)

    sums = joined.groupBy("user", "item", "label").agg(
        F.sum("n").alias("len"),
        F.count_if(F.col("docs") == 1).alias("only"),
        *[
            F.sum(
                F.col("n") * (F.log(F.col(f"wc_{i}") - own(i, F.col("n")) + WORD_SMOOTHING) - unseen)
            ).alias(f"w_{i}")
            for i in places
        ],
    )
    both = sums.join(model.classes, "user")

    def total(i: int) -> Column:
        denom = F.log(
            F.col(f"tokens_{i}") - own(i, F.col("len")) + (F.col("vocab") - F.col("only")) * WORD_SMOOTHING
        )
        prior = F.log(F.col(f"d_{i}") + 2 * CLASS_SMOOTHING)
        return prior + F.col(f"w_{i}") + F.col("len") * (unseen - denom)

    both = both.select("*", *[(F.col(f"docs_{i}") - own(i, F.lit(1))).alias(f"d_{i}") for i in places])
    both = both.select("*", *[total(i).alias(f"s_{i}") for i in places])
    return _posterior(both, places, [F.col("user"), F.col("item"), F.col("label")])


def leave_fold_out(model: NaiveBayes, examples: DataFrame, hot: list | None = None) -> DataFrame:
    """(user, item, label, fold, s_i, p_i): each example, with its fold, scored by a model that has not seen the fold.

    The fold's own statistics are taken off the user's, which equals a fit on the other folds. Where a fold holds all
    that a user has labelled, nothing is left and p_i is 0.
    """
    places = range(len(model.labels))
    hot = hot_values(examples, "word") if hot is None else hot

    def of(i: int, value: Column) -> Column:
        return F.when(F.col("label") == model.labels[i], value).otherwise(0)

    fold_words = examples.groupBy("user", "fold", "word").agg(
        F.count(F.lit(1)).alias("f_docs"), *[F.sum(of(i, F.col("n"))).alias(f"f_wc_{i}") for i in places])
    lengths = examples.groupBy("user", "fold", "item", "label").agg(F.sum("n").alias("len"))
    fold_sizes = lengths.groupBy("user", "fold").agg(
        *[F.sum(of(i, F.lit(1))).alias(f"f_docs_{i}") for i in places], *[F.sum(of(i, F.col("len"))).alias(f"f_tokens_{i}") for i in places])
    left = fold_words.join(model.words, ["user", "word"])
    gone = left.groupBy("user", "fold").agg(F.count_if(F.col("docs") == F.col("f_docs")).alias("only"))
    unseen = F.log(F.lit(WORD_SMOOTHING))
    gains = left.select("user", "fold", "word", *[(F.log(F.col(f"wc_{i}") - F.col(f"f_wc_{i}") + WORD_SMOOTHING) - unseen).alias(f"g_{i}") for i in places])
    seen = salted_join(examples, gains, ["user", "fold", "word"], "word", ["item"], "inner", hot)
    sums = seen.groupBy("user", "fold", "item").agg(*[F.sum(F.col("n") * F.col(f"g_{i}")).alias(f"w_{i}") for i in places])
    rows = lengths.join(sums, ["user", "fold", "item"]).join(model.classes, "user").join(fold_sizes, ["user", "fold"]).join(gone, ["user", "fold"])
    rows = rows.select("*", *[(F.col(f"docs_{i}") - F.col(f"f_docs_{i}")).alias(f"d_{i}") for i in places])

    def total(i: int) -> Column:
        denom = F.log(F.col(f"tokens_{i}") - F.col(f"f_tokens_{i}") + (F.col("vocab") - F.col("only")) * WORD_SMOOTHING)
        return F.log(F.col(f"d_{i}") + 2 * CLASS_SMOOTHING) + F.col(f"w_{i}") + F.col("len") * (unseen - denom)

    scored = rows.select("*", *[total(i).alias(f"s_{i}") for i in places])
    out = _posterior(scored, places, [F.col("user"), F.col("item"), F.col("label"), F.col("fold")])
    return out.select("user", "item", "label", "fold", *[f"s_{i}" for i in places], *[F.coalesce(f"p_{i}", F.lit(0.0)).alias(f"p_{i}") for i in places])
