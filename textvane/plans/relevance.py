"""From texts and labels to ranked items: the product's main answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import bayes, ensemble, linear, tables as T
from ..operators.counts import item_bow_words, item_words, user_tfidf as counts_of_users
from ..operators.numbering import number_rows
from ..operators.skew import hot_values
from ..session import stage
from . import roles as R
from .roles import table
from .spelled import clean_titles


def _counts(spark, sf_dir) -> DataFrame:
    return stage(item_words(R.items(spark, sf_dir)), "item_words")


def _labelled(spark, sf_dir, labels: DataFrame) -> DataFrame:
    """The items that carry a label: the others need not be tokenised for training."""
    return R.items(spark, sf_dir).join(labels.select("item").distinct(), "item", "left_semi")


def _labels(spark, sf_dir) -> DataFrame:
    return T.latest_labels(R.document_labels(spark, sf_dir))


def training_examples(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return bayes.training_examples(labels, item_words(_labelled(spark, sf_dir, labels)))


def nb_stats(spark, sf_dir):
    return bayes.fit(training_examples(spark, sf_dir)).classes


def nb_word_counts(spark, sf_dir):
    return bayes.fit(training_examples(spark, sf_dir)).words


def _nb(spark, sf_dir, users: list[str] | None = None) -> DataFrame:
    labels = _labels(spark, sf_dir)
    if users:
        labels = labels.filter(F.col("user").isin(users))
    counts = _counts(spark, sf_dir)
    pairs = T.unlabelled(labels.select("user"), R.items(spark, sf_dir), labels)
    model = bayes.fit(bayes.training_examples(labels, counts))
    return bayes.score(model, pairs, counts)


def nb_scores(spark, sf_dir):
    out = _nb(spark, sf_dir)
    return out.select(
        "user", "item", F.round("p_1", 6).alias("p"), F.round(F.col("s_1") - F.col("s_0"), 4).alias("log_odds")
    )


def relevant_items(spark, sf_dir):
    """Items one user has not labelled, by score, with their fields."""
    scores = _nb(spark, sf_dir, ["quality"]).select(
        "item", F.round("p_1", 6).alias("p"), F.round(F.col("s_1") - F.col("s_0"), 4).alias("log_odds")
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "lang", "source", "n_chars")
    ranked = number_rows(scores, [F.desc("p"), F.col("item")], name="rank")
    return ranked.join(docs, "item").select("rank", "item", "lang", "source", "n_chars", "p", "log_odds")


def nb_leave_one_out(spark, sf_dir):
    examples = stage(training_examples(spark, sf_dir), "examples")
    out = bayes.leave_one_out(bayes.fit(examples), examples)
    return out.select("user", "item", "label", F.round("p_1", 6).alias("p"))


FOLDS = 4


def _folded_examples(spark, sf_dir) -> DataFrame:
    return stage(training_examples(spark, sf_dir).withColumn("fold", F.pmod("item", F.lit(FOLDS)).cast("int")), "examples")


def kfold_trained(spark, sf_dir):
    """Each labelled item scored by a model trained on the other folds of its user's items."""
    examples = _folded_examples(spark, sf_dir)
    out = bayes.leave_fold_out(bayes.fit(examples), examples)
    return out.select("user", "item", "label", "fold", F.round("p_1", 6).alias("p"))


def user_tfidf(spark, sf_dir):
    """Weights of words over each user's own labelled items, all of them and all but the item itself."""
    out = counts_of_users(training_examples(spark, sf_dir))
    return out.select("user", "item", "word", "n", F.round("tfidf", 6).alias("tfidf"), F.round("held_out", 6).alias("held_out"))


# Two stand-in models whose scores SQL can give: the share of label 1 among the user's
# labels of the same language, and of the same source.
STAND_INS = {"bow": "lang", "tfidf": "source"}


def _shares(spark, sf_dir, column: str, name: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), column)
    joined = _labels(spark, sf_dir).join(docs, "item")
    return joined.groupBy("user", column).agg(F.avg(F.col("label").cast("double")).alias(name))


def _with_stand_ins(spark, sf_dir, rows: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), *STAND_INS.values())
    out = rows.join(docs, "item")
    for name, column in STAND_INS.items():
        out = out.join(_shares(spark, sf_dir, column, name), ["user", column], "left")
    return out.select(*rows.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in STAND_INS])


def given_predictions(spark, sf_dir) -> DataFrame:
    """(user, item, label, bow, tfidf, nb) of the labelled items."""
    held_out = nb_leave_one_out(spark, sf_dir).select("user", "item", "label", F.col("p").alias("nb"))
    return _with_stand_ins(spark, sf_dir, held_out)


def ensemble_weights(spark, sf_dir):
    w = ensemble.ensemble_weights(given_predictions(spark, sf_dir))
    return w.select("user", *[F.round(f"w_{m}", 6).alias(f"w_{m}") for m in ensemble.MODELS])


def weighted_scores(spark, sf_dir):
    """Weighted and mean scores of unlabelled items, from the given models."""
    scores = nb_scores(spark, sf_dir).select("user", "item", F.col("p").alias("nb"))
    scores = _with_stand_ins(spark, sf_dir, scores)
    out = ensemble.ensemble_scores(scores, ensemble_weights(spark, sf_dir))
    return out.select("user", "item", *[F.round(c, 6).alias(c) for c in (*ensemble.MODELS, "weighted", "mean")])


def rank_scores(spark, sf_dir):
    """Each user's items by tf-idf, by bag of words and by weighted score, best first."""
    out = weighted_scores(spark, sf_dir).select("user", "item", "tfidf", "bow", "weighted")
    for c in ("tfidf", "bow", "weighted"):
        out = number_rows(out, [F.desc(c), F.col("item")], ["user"], f"rank_{c}")
    return out.select("user", "item", "rank_tfidf", "rank_bow", "rank_weighted")


def score_lookup(spark, sf_dir):
    """The scores of asked (user, item) keys: here every benchmark item for both users."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("user"), F.col("item_id").alias("item")
    )
    counts = _counts(spark, sf_dir)
    wanted = counts.join(asked.select("item").distinct(), "item", "left_semi")
    model = bayes.fit(bayes.training_examples(_labels(spark, sf_dir), counts))
    out = bayes.score(model, asked, wanted)
    return out.select("user", "item", F.round("p_1", 6).alias("p"))


def _fitted_linear(labels: DataFrame, items: DataFrame):
    counts = stage(item_bow_words(items), "bow_words")
    rows = stage(linear.with_folds(bayes.training_examples(labels, counts)), "linear_rows")
    return linear.fit_linear(rows), rows, counts, T.unlabelled(labels.select("user"), items, labels)


def _linear(spark, sf_dir):
    return _fitted_linear(_labels(spark, sf_dir), R.items(spark, sf_dir))


def linear_scores(spark, sf_dir):
    weights, _, counts, pairs = _linear(spark, sf_dir)
    return linear.score_linear(weights, pairs, counts)


def bow_scores(spark, sf_dir):
    return linear_scores(spark, sf_dir).select("user", "item", F.round("bow", 6).alias("p"))


def tfidf_scores(spark, sf_dir):
    return linear_scores(spark, sf_dir).select("user", "item", F.round("tfidf", 6).alias("p"))


def scores_of_all_models(labels: DataFrame, items: DataFrame) -> DataFrame:
    """(user, item, bow, tfidf, nb, weighted, mean) of the pairs without a label.

    From latest `labels` (user, item, label) and `items` (item, text): three models are fitted for every user,
    weighed by their errors on held-out items, and applied.
    """
    weights, rows, counts, pairs = _fitted_linear(labels, items)
    plain = stage(item_words(items), "item_words")
    hot = hot_values(plain, "word")
    examples = stage(bayes.training_examples(labels, plain), "examples")
    model = bayes.fit(examples)
    held = linear.held_out_linear(weights, rows).join(
        bayes.leave_one_out(model, examples, hot).select("user", "item", F.col("p_1").alias("nb")), ["user", "item"]
    )
    shares = ensemble.ensemble_weights(held)
    scores = linear.score_linear(weights, pairs, counts, hot).join(
        bayes.score(model, pairs, plain, hot).select("user", "item", F.col("p_1").alias("nb")),
        ["user", "item"],
    )
    return ensemble.ensemble_scores(scores, shares)


def ensemble_scores(spark, sf_dir):
    """All three models fitted, weighed by their held-out errors and applied to unlabelled items."""
    return scores_of_all_models(_labels(spark, sf_dir), R.items(spark, sf_dir))


def recommended_items(spark, sf_dir):
    """What each user has not labelled, best first by the weighted score of all models over cleaned texts, with its fields."""
    cleaned = clean_titles(spark, sf_dir).withColumnRenamed("processed", "text")
    scores = scores_of_all_models(_labels(spark, sf_dir), stage(cleaned, "cleaned"))
    ranked = number_rows(scores, [F.desc("weighted"), F.col("item")], ["user"], "rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "lang", "source", "n_chars")
    shown = [F.round(c, 6).alias(c) for c in (*ensemble.MODELS, "weighted")]
    return ranked.join(docs, "item").select("user", "rank", "item", "lang", "source", "n_chars", *shown)


QUERIES = {
    "bow_scores": bow_scores,
    "tfidf_scores": tfidf_scores,
    "ensemble_scores": ensemble_scores,
    "recommended_items": recommended_items,
    "training_examples": training_examples,
    "nb_stats": nb_stats,
    "nb_word_counts": nb_word_counts,
    "nb_scores": nb_scores,
    "relevant_items": relevant_items,
    "nb_leave_one_out": nb_leave_one_out,
    "kfold_trained": kfold_trained,
    "user_tfidf": user_tfidf,
    "ensemble_weights": ensemble_weights,
    "weighted_scores": weighted_scores,
    "rank_scores": rank_scores,
    "score_lookup": score_lookup,
}

SQL_MODEL = f"""
iw as materialized ({R.SQL_ITEM_WORDS}),
lab as ({R.SQL_DOCUMENT_LABELS}),
ex as materialized (select "user", item, label, word, n from lab join iw using (item)),
words as materialized (
  select "user", word, count(*) as docs, cast(sum(case when label = '0' then n else 0 end) as bigint) as wc_0,
         cast(sum(case when label = '1' then n else 0 end) as bigint) as wc_1 from ex group by all),
classes as (
  select "user", cast(count(distinct item) filter (where label = '0') as bigint) as docs_0,
         cast(count(distinct item) filter (where label = '1') as bigint) as docs_1,
         cast(coalesce(sum(n) filter (where label = '0'), 0) as bigint) as tokens_0,
         cast(coalesce(sum(n) filter (where label = '1'), 0) as bigint) as tokens_1,
         count(distinct word) as vocab from ex group by "user")"""


def _sql_score(pairs: str) -> str:
    """Scores straight from the definition: one term per token and label."""
    return f"""
pair as ({pairs}),
raw as (
  select p."user", p.item, any_value(docs_0) as docs_0, any_value(docs_1) as docs_1,
         ln(any_value(docs_0) + 0.02) + sum(n * (ln(coalesce(wc_0, 0) + 0.05) - ln(tokens_0 + vocab * 0.05))) as s_0,
         ln(any_value(docs_1) + 0.02) + sum(n * (ln(coalesce(wc_1, 0) + 0.05) - ln(tokens_1 + vocab * 0.05))) as s_1
  from pair p join iw on iw.item = p.item join classes c on c."user" = p."user"
  left join words w on w."user" = p."user" and w.word = iw.word
  group by p."user", p.item),
scored as (
  select "user", item, s_0, s_1,
         case when docs_1 = 0 then 0 when docs_0 = 0 then 1
              when s_1 >= s_0 then 1 / (1 + exp(s_0 - s_1)) else exp(s_1 - s_0) / (1 + exp(s_1 - s_0)) end as p_1
  from raw)"""


_PAIRS = """select u."user", d.doc_id as item from (select unnest(['quality', 'toxic']) as "user") u, documents d
where d.doc_id not in (select doc_id from labels)"""
SQL_NB = f"""with {SQL_MODEL}, {_sql_score(_PAIRS)}
select "user", item, round(p_1, 6) as p, round(s_1 - s_0, 4) as log_odds from scored"""
SQL_LOO = f"""with {SQL_MODEL},
less as (
  select e."user", e.item, e.label, any_value(docs_0) - any_value(case when label = '0' then 1 else 0 end) as d_0,
         any_value(docs_1) - any_value(case when label = '1' then 1 else 0 end) as d_1,
         sum(n) as len, any_value(vocab) - count(*) filter (where docs = 1) as v,
         any_value(tokens_0) as t_0, any_value(tokens_1) as t_1,
         sum(n * ln(wc_0 - case when label = '0' then n else 0 end + 0.05)) as w_0,
         sum(n * ln(wc_1 - case when label = '1' then n else 0 end + 0.05)) as w_1
  from ex e join words using ("user", word) join classes using ("user") group by e."user", e.item, e.label),
raw as (
  select *, ln(d_0 + 0.02) + w_0 - len * ln(t_0 - case when label = '0' then len else 0 end + v * 0.05) as s_0,
         ln(d_1 + 0.02) + w_1 - len * ln(t_1 - case when label = '1' then len else 0 end + v * 0.05) as s_1 from less)
select "user", item, label,
       round(case when d_1 = 0 then 0 when d_0 = 0 then 1
            when s_1 >= s_0 then 1 / (1 + exp(s_0 - s_1)) else exp(s_1 - s_0) / (1 + exp(s_1 - s_0)) end, 6) as p
from raw"""
# A fit on the rows of the other folds, straight from the definition.
SQL_KFOLD = f"""with {SQL_MODEL},
fx as (select *, cast(item % {FOLDS} as integer) as fold from ex),
f as (select distinct "user", fold from fx),
tr as (select f."user", f.fold as held, fx.item, fx.label, fx.word, fx.n from f join fx on fx."user" = f."user" and fx.fold <> f.fold),
tw as (select "user", held, word, sum(case when label = '0' then n else 0 end) as wc_0, sum(case when label = '1' then n else 0 end) as wc_1 from tr group by all),
tc as (select "user", held, count(distinct item) filter (where label = '0') as d_0, count(distinct item) filter (where label = '1') as d_1,
              coalesce(sum(n) filter (where label = '0'), 0) as t_0, coalesce(sum(n) filter (where label = '1'), 0) as t_1, count(distinct word) as v
       from tr group by "user", held),
raw as (
  select fx."user", fx.item, fx.label, fx.fold, any_value(d_0) as d_0, any_value(d_1) as d_1,
         ln(any_value(d_0) + 0.02) + sum(n * (ln(coalesce(wc_0, 0) + 0.05) - ln(t_0 + v * 0.05))) as s_0,
         ln(any_value(d_1) + 0.02) + sum(n * (ln(coalesce(wc_1, 0) + 0.05) - ln(t_1 + v * 0.05))) as s_1
  from fx join tc on tc."user" = fx."user" and tc.held = fx.fold
  left join tw on tw."user" = fx."user" and tw.held = fx.fold and tw.word = fx.word group by fx."user", fx.item, fx.label, fx.fold)
select "user", item, label, fold,
       round(case when d_1 = 0 then 0 when d_0 = 0 then 1
            when s_1 >= s_0 then 1 / (1 + exp(s_0 - s_1)) else exp(s_1 - s_0) / (1 + exp(s_1 - s_0)) end, 6) as p
from raw"""
SQL_USER_TFIDF = f"""with {SQL_MODEL},
df as (select "user", word, count(*) as df from ex group by all), sizes as (select "user", count(distinct item) as items from ex group by all)
select "user", item, word, n, round(n * ln(items / df), 6) as tfidf,
       round(case when df > 1 then n * ln((items - 1) / (df - 1)) end, 6) as held_out
from ex join df using ("user", word) join sizes using ("user")"""
SQL_SHARES = f"""
dl as (select l.*, lang, source from ({R.SQL_DOCUMENT_LABELS}) l join documents on doc_id = item),
by_lang as (select "user", lang, avg(cast(label as double)) as bow from dl group by 1, 2),
by_source as (select "user", source, avg(cast(label as double)) as tfidf from dl group by 1, 2)"""
SQL_PREDICTIONS = f"""
{SQL_SHARES}, loo as ({SQL_LOO}),
pred as (
  select loo."user", item, label, coalesce(bow, 0) as bow, coalesce(tfidf, 0) as tfidf, p as nb
  from loo join documents d on d.doc_id = item left join by_lang b on b."user" = loo."user" and b.lang = d.lang
  left join by_source s on s."user" = loo."user" and s.source = d.source)"""
SQL_WEIGHTS = f"""
{SQL_PREDICTIONS},
err as (select "user", count(*) as n, sum((cast(label as double) - bow) ** 2) as e1, sum((cast(label as double) - tfidf) ** 2) as e2,
               sum((cast(label as double) - nb) ** 2) as e3 from pred group by "user"),
turned as (select "user", n, 1 - e1 / sqrt(e1 * e1 + e2 * e2 + e3 * e3) as a, 1 - e2 / sqrt(e1 * e1 + e2 * e2 + e3 * e3) as b,
                  1 - e3 / sqrt(e1 * e1 + e2 * e2 + e3 * e3) as c from err),
weights as (select "user", round(a / (a + b + c), 6) as w_bow, round(b / (a + b + c), 6) as w_tfidf, round(c / (a + b + c), 6) as w_nb from turned)"""
SQL_WEIGHTED = f"""
with {SQL_WEIGHTS}, nb as ({SQL_NB}),
given as (
  select nb."user", item, coalesce(bow, 0) as bow, coalesce(tfidf, 0) as tfidf, p as nb
  from nb join documents d on d.doc_id = item left join by_lang b on b."user" = nb."user" and b.lang = d.lang
  left join by_source s on s."user" = nb."user" and s.source = d.source)
select "user", item, round(bow, 6) as bow, round(tfidf, 6) as tfidf, round(nb, 6) as nb,
       round(bow * w_bow + tfidf * w_tfidf + nb * w_nb, 6) as weighted, round((bow + tfidf + nb) / 3, 6) as mean
from given join weights using ("user")"""
_ASKED = """select u."user", item_id as item from (select unnest(['quality', 'toxic']) as "user") u, benchmark"""

SQL = {
    "training_examples": f"""with {SQL_MODEL} select "user", item, label, word, n from ex""",
    "nb_stats": f"with {SQL_MODEL} select * from classes",
    "nb_word_counts": f"with {SQL_MODEL} select * from words",
    "nb_scores": SQL_NB,
    "relevant_items": f"""
select row_number() over (order by p desc, item) as rank, item, lang, source, n_chars, p, log_odds
from ({SQL_NB}) join documents on doc_id = item where "user" = 'quality'""",
    "nb_leave_one_out": SQL_LOO,
    "kfold_trained": SQL_KFOLD,
    "user_tfidf": SQL_USER_TFIDF,
    "ensemble_weights": f"with {SQL_WEIGHTS} select * from weights",
    "weighted_scores": SQL_WEIGHTED,
    "rank_scores": f"""
select "user", item, row_number() over (partition by "user" order by tfidf desc, item) as rank_tfidf,
       row_number() over (partition by "user" order by bow desc, item) as rank_bow,
       row_number() over (partition by "user" order by weighted desc, item) as rank_weighted
from ({SQL_WEIGHTED})""",
    "score_lookup": f"""with {SQL_MODEL}, {_sql_score(_ASKED)} select "user", item, round(p_1, 6) as p from scored""",
}
