"""The registered queries of this folder and, where DuckDB can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import read_table
from . import automata, jaccard, language, mixing, negatives, neighbours, packing, periods, quality, suffixes, tokencounts, urls, warc


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources at weights 1, 2, 3 takes of every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).docs.drop("source")


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document, linked from 90 % of three-word shingles on."""
    return jaccard.linked_classes(read_table(spark, sf_dir, "documents"), jaccard.Rule(3, 90, 100))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word measures, compression ratios and verdict of every document."""
    return quality.quality(read_table(spark, sf_dir, "documents"))


def automata_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in 13-word windows that an earlier document has."""
    return automata.dedup(read_table(spark, sf_dir, "documents")).rows.drop("spans")


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in 50-word windows that an earlier document has."""
    return suffixes.dedup(read_table(spark, sf_dir, "documents")).rows.drop("spans")


def neighbour_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth one."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page."""
    return language.identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences."""
    packed = packing.pack(read_table(spark, sf_dir, "documents"), payload=F.crc32)
    return packed.withColumnRenamed("payload", "ids_crc32")


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return tokencounts.count_tokens(read_table(spark, sf_dir, "documents"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, where every seventh label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(rows, F.col("id") % 50 == 0)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as WARC archives give it back."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def period_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which repeat a stretch of their words up to their end."""
    return periods.report(periods.find_runs(periods.with_tandems(read_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_mixing": mixing_query,
    "op2_ngram_jaccard": jaccard_query,
    "op3_nearest_neighbours": neighbour_query,
    "op4_quality_rules": quality_query,
    "op5_substring_dedup": automata_query,
    "op6_language_id": language_query,
    "op7_packing": packing_query,
    "op8_suffix_array_dedup": suffix_query,
    "op9_token_counts": token_query,
    "op10_url_filters": url_query,
    "op11_hard_negatives": negatives_query,
    "op12_warc": warc_query,
    "op13_periodic_runs": period_query,
    "pipeline": corpus_pipeline.run,
}

def _repeats_sql(n: int) -> str:
    """Words of documents in n-word windows that a smaller doc_id has, and the checksum of the rest."""
    return f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
g as (select doc_id, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') as gram
      from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) as i from d where len(w) >= {n})),
f as (select gram, min(doc_id) as first_doc from g group by gram),
c as (select distinct doc_id, unnest(range(i, i + {n})) as i from g join f using (gram) where first_doc < doc_id),
k as (select p.doc_id, array_to_string(list(word order by i), ' ') as kept from p anti join c using (doc_id, i) group by p.doc_id),
r as (select doc_id, count(*) as n from c group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(r.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join r using (doc_id) left join k using (doc_id)"""


SQL = {
    "op2_ngram_jaccard": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g from (
        select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as both_have from s x join s y using (g)
                        where x.doc_id <> y.doc_id group by 1, 2)
      join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * both_have >= 90 * (na.n + nb.n - both_have)),
r(a, b) as (select doc_id, doc_id from d union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.b) as component_id
from d left join n using (doc_id) join r on r.a = d.doc_id group by d.doc_id""",
    "op5_substring_dedup": _repeats_sql(13),
    "op8_suffix_array_dedup": _repeats_sql(50),
    "op10_url_filters": r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(action, host, path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f as (
  select page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(action, length(r.host || r.path)) as action
  from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by page_id)
select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') as verdict from p left join f using (page_id)""",
    "op11_hard_negatives": r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as alike, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, score from s where alike qualify row_number() over (partition by a order by score desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, cast(row_number() over w as int) as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.a = p.a and not s.alike and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
window w as (partition by p.a, p.b order by s.score desc, s.b) qualify row_number() over w <= 3""",
    "op12_warc": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
r as (select *, strlen(html) as n, max(page_id) over (partition by html) as lead from p)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
       case when n >= 1000 and page_id <> lead then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> lead then lead end as refers_to from r""",
}
