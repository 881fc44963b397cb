"""Queries over keyed tables and label events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import date_millis, snake_case
from ..operators import tables as T
from ..operators.numbering import number_rows
from ..sources.incremental import published_since
from ..sources.jsonrows import from_json_rows, to_json_rows
from ..sources.schemas import snake_columns
from ..sources.tables import load_tables
from . import roles as R
from .roles import table

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, errors = load_tables(spark, sf_dir, [*NAMES, "tender"])
    out = None
    for name, df in found.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(True).alias("loaded"))
        out = part if out is None else out.unionByName(part)
    for name in errors:
        part = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(False).alias("loaded"))
        out = part if out is None else out.unionByName(part)
    return out


def append_new(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"))
    return T.new_rows(customers.unionByName(customers), seen, ["user"])


def upsert_latest(spark, sf_dir):
    current = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("day"),
    )
    return T.upsert(current, T.one_per_key(lines, ["o_orderkey"], ["day", "price", "status"]), ["o_orderkey"])


def labels_of_user(spark, sf_dir):
    return R.document_labels(spark, sf_dir).filter(F.col("user") == "toxic")


def latest_labels(spark, sf_dir):
    return T.latest_labels(R.event_labels(spark, sf_dir))


def labels_valid(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item"))
    return T.events_of_items(R.document_labels(spark, sf_dir), pages)


def unlabelled_items(spark, sf_dir):
    labels = R.document_labels(spark, sf_dir)
    return T.unlabelled(labels.select("user"), R.items(spark, sf_dir), labels)


def key_set_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return T.rows_in_keys(T.rows_in_keys(docs, "lang", ["de", "en", "fr"]), "doc_id", toxic)


def _raw_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.floor(F.col("value") / 20).cast("string").alias("label"))


def validate_labels(spark, sf_dir):
    return T.split_labels(_raw_labels(spark, sf_dir))


def label_union(spark, sf_dir):
    return T.union_events(R.event_labels(spark, sf_dir, 10.0), R.event_labels(spark, sf_dir, 30.0))


def affected_users(spark, sf_dir):
    events = R.event_labels(spark, sf_dir)
    touched = T.affected_users(events.filter(F.col("label") == "1").filter(F.col("item") == "error"))
    latest = T.latest_labels(events.join(touched, "user", "left_semi"))
    return latest.groupBy("user").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("label") == "1").alias("n_liked"))


def sequence_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return number_rows(e, [F.col("ts"), F.col("event_id")], ["event_type"], "id", 0).select("event_type", "event_id", "id")


def default_columns(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"),
        F.lit(None).cast("bigint").alias("time"),
    )
    return T.with_defaults(users)


def json_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custKey"), F.col("c_name").alias("fullName"), F.col("c_nationkey").alias("nationKey"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("marketSegment"),
    )
    text = to_json_rows(rows, keep=["custKey"])
    back = from_json_rows(text, rows.schema, "json")
    return back.select(F.col("custKey").alias("key"), "json", "fullName", "nationKey", "marketSegment")


def snake_columns_query(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("docId"), F.col("lang").alias("textLang"), F.col("n_chars").alias("nChars")
    )
    return snake_columns(d)


def snake_case_query(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("Of"), "p_type", "p_size").alias("name"))
    return p.select("p_partkey", "name", snake_case(F.col("name")).alias("snake"))


def ingest_counts(spark, sf_dir):
    batch = R.document_labels(spark, sf_dir)
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.lit(True).alias("known"))
    valid = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), F.lit(True).alias("valid"))
    marked = batch.join(known, "item", "left").join(valid, "item", "left")
    is_new = F.col("known").isNull()
    return marked.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(is_new).alias("new"),
        F.count_if(is_new & F.col("valid").isNotNull()).alias("valid"),
    )


def incremental_window(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate")).first()[0]
    return published_since(orders, "o_orderdate", last="1999-06-01", now=now, lookback_days=300).select(
        "o_orderkey", "o_orderdate"
    )


def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    return o.select("o_orderkey", "day", date_millis(F.col("day")).alias("millis"))


QUERIES = {
    "scan_tables": scan_tables,
    "append_new": append_new,
    "upsert_latest": upsert_latest,
    "labels_of_user": labels_of_user,
    "latest_labels": latest_labels,
    "labels_valid": labels_valid,
    "unlabelled_items": unlabelled_items,
    "key_set_filter": key_set_filter,
    "validate_labels": validate_labels,
    "label_union": label_union,
    "affected_users": affected_users,
    "sequence_ids": sequence_ids,
    "default_columns": default_columns,
    "json_roundtrip": json_roundtrip,
    "snake_columns": snake_columns_query,
    "snake_case": snake_case_query,
    "ingest_counts": ingest_counts,
    "incremental_window": incremental_window,
    "date_parse": date_parse,
}

SQL = {
    "scan_tables": " union all ".join(
        f"select '{n}' as name, (select count(*) from {n}) as n_rows, true as loaded" for n in NAMES
    ) + " union all select 'tender', cast(0 as bigint), false",
    "append_new": """
select c_custkey as "user", c_name as name from customer
where c_custkey not in (select user_id from events where user_id is not null)""",
    "upsert_latest": """
with last as (
  select l_orderkey as o_orderkey, l_linestatus as status, l_extendedprice as price, l_shipdate as day,
         row_number() over (partition by l_orderkey order by l_shipdate desc, l_extendedprice desc, l_linestatus desc) as rn
  from lineitem)
select o_orderkey, status, price, day from last where rn = 1
union all
select o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders o
where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)""",
    "labels_of_user": f"""select * from ({R.SQL_DOCUMENT_LABELS}) where "user" = 'toxic'""",
    "latest_labels": f"""
select "user", item, label, "time" from (
  select *, row_number() over (partition by "user", item order by "time" desc, label desc) as rn
  from ({R.SQL_EVENT_LABELS})) where rn = 1""",
    "labels_valid": f"""select * from ({R.SQL_DOCUMENT_LABELS}) where item in (select page_id from pages)""",
    "unlabelled_items": """
select u."user", d.doc_id as item from (select unnest(['quality', 'toxic']) as "user") u, documents d
where d.doc_id not in (select doc_id from labels)""",
    "key_set_filter": """
select doc_id, lang, source, n_chars from documents
where lang in ('de', 'en', 'fr') and doc_id in (select doc_id from labels where toxic = 1)""",
    "validate_labels": """
select event_id, label, case when label in ('0', '1') then null else 'Label must be 0 or 1' end as error
from (select event_id, cast(cast(floor(value / 20) as bigint) as varchar) as label from events)""",
    "label_union": """
select user_id as "user", event_type as item, epoch_us(ts) // 1000 as "time",
       max(case when value > 10 then '1' else '0' end) as label from events group by 1, 2, 3""",
    "affected_users": f"""
with e as ({R.SQL_EVENT_LABELS}),
hit as (select distinct "user" from e where label = '1' and item = 'error'),
latest as (select "user", item, arg_max(label, ("time", label)) as label from e
           where "user" in (select "user" from hit) group by 1, 2)
select "user", count(*) as n_items, count(*) filter (where label = '1') as n_liked from latest group by 1""",
    "sequence_ids": """
select event_type, event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as id from events""",
    "json_roundtrip": """
select c_custkey as key, c_name as "fullName", c_nationkey as "nationKey",
       case when c_acctbal > 0 then c_mktsegment end as "marketSegment",
       '{"custKey":' || c_custkey || ',"fullName":"' || c_name || '","nationKey":' || c_nationkey
         || case when c_acctbal > 0 then ',"marketSegment":"' || c_mktsegment || '"' else '' end || '}' as json
from customer""",
    "snake_columns": "select doc_id, lang as text_lang, n_chars from documents",
    "snake_case": r"""
select p_partkey, name, lower(name[1] || regexp_replace(name[2:], '([A-Z0-9])', '_\1', 'g')) as snake
from (select p_partkey, p_brand || 'Of' || p_type || p_size as name from part)""",
    "ingest_counts": f"""
select count(*) as received, count(*) filter (where item not in (select item_id from benchmark)) as "new",
       count(*) filter (where item not in (select item_id from benchmark) and item in (select page_id from pages)) as valid
from ({R.SQL_DOCUMENT_LABELS})""",
    "incremental_window": """
select o_orderkey, o_orderdate from orders
where o_orderdate >= greatest(timestamp '1999-06-01', date_trunc('day', (select max(o_orderdate) from orders) - interval 300 day))""",
    "date_parse": """
select o_orderkey, day, case when ok then epoch_ms(cast(day as timestamp)) end as millis
from (select o_orderkey, o_orderstatus <> 'P' as ok,
             case when o_orderstatus = 'P' then o_orderpriority else strftime(o_orderdate, '%Y-%m-%d') end as day from orders)""",
}
