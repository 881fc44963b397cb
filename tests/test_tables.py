import datetime
import random

import pytest
from pyspark.sql import functions as F

from textvane.functions.text import EDIT_LETTERS
from textvane.operators import numbering, skew, tables as T
from textvane.sources import html as H, tables
from textvane.sources.incremental import window_start
from textvane.sources.jsonrows import from_json_rows, to_json_rows
from textvane.sources.schemas import TENDER, snake_columns
from textvane.sources.tables import append_rows, load_tables, read_table, upsert_buckets, write_buckets
from textvane.streaming import ingest as I
from textvane.streaming.refresh import Refresher


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "user string, item string, time bigint, label string")


def test_latest_and_union(spark, rows):
    e = events(spark, ("u", "a", 1, "0"), ("u", "a", 2, "1"), ("u", "a", 2, "0"), ("v", "a", 5, "0"))
    assert rows(T.latest_labels(e)) == [("u", "a", "1", 2), ("v", "a", "0", 5)]
    assert rows(T.union_events(e, e)) == [("u", "a", 1, "0"), ("u", "a", 2, "1"), ("v", "a", 5, "0")]


def test_label_domain(spark):
    e = events(spark, ("u", "a", 1, "0"), ("u", "a", 2, "2"), ("u", "a", 3, None))
    assert [r["error"] is None for r in T.split_labels(e).orderBy("time").collect()] == [True, False, False]


def test_new_rows_drop_repeats_of_the_batch(spark, rows):
    known = spark.createDataFrame([(1, "x")], "k int, v string")
    batch = spark.createDataFrame([(1, "y"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    assert rows(T.new_rows(batch, known, ["k"], ["v"])) == [(2, "b"), (3, None)]


def test_upsert_rewrites_only_touched_buckets(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    write_buckets(spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, ["k"], 8)
    before = {str(f) for f in (tmp_path / "t").rglob("*.parquet")}
    upsert_buckets(spark, spark.createDataFrame([(7, "new"), (99, "new")], "k bigint, v string"), path, ["k"])
    got = dict(map(tuple, spark.read.parquet(path).select("k", "v").collect()))
    assert len(got) == 51 and got[7] == got[99] == "new" and got[8] == "old"
    assert len(before & {str(f) for f in (tmp_path / "t").rglob("*.parquet")}) >= 6


def test_bucket_count_follows_the_rows_and_is_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(tables, "MIN_BUCKETS", 2)
    monkeypatch.setattr(tables, "BUCKET_ROWS", 10)
    write_buckets(spark.range(45).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, ["k"])
    monkeypatch.setattr(tables, "BUCKET_ROWS", 3)
    upsert_buckets(spark, spark.range(40, 50).select(F.col("id").alias("k"), F.lit("new").alias("v")), path, ["k"])
    got = list(map(tuple, spark.read.parquet(path).select("k", "v", "bucket").collect()))
    assert sorted(r[:2] for r in got) == [(k, "old" if k < 40 else "new") for k in range(50)]
    assert {r[2] for r in got} == set(range(5))


def test_reading_and_appending(spark, tmp_path):
    append_rows(spark.range(3), str(tmp_path / "a"))
    append_rows(spark.range(2), str(tmp_path / "a"))
    found, errors = load_tables(spark, str(tmp_path), ["a", "gone"])
    assert found["a"].count() == 5 and list(errors) == ["gone"]
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "a", "xml")


def test_sequences_per_type(spark):
    calls = spark.createDataFrame([(1, "Person"), (2, "Person"), (3, "Booking")], "call int, type string")
    got = numbering.number_rows(calls, [F.col("call")], ["type"], "id", 0)
    assert [r["id"] for r in got.orderBy("call").collect()] == [0, 1, 0]


def test_numbers_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = numbering.number_rows(df, [F.desc("id")], ["g"], "no", 5).filter("g = 'hot'").orderBy("no").collect()
    assert [r["no"] for r in got] == list(range(5, 2005)) and [r["id"] for r in got] == sorted((r["id"] for r in got), reverse=True)
    everything = numbering.number_rows(df, [F.col("id")], name="no")
    assert everything.filter(F.col("no") != F.col("id") + 1).count() == 0


def test_salted_join_equals_plain_join(spark, rows):
    big = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", 3)], "k string, v int")
    assert skew.hot_values(big, "k")[0] == "hot"
    for how in ("inner", "left"):
        got = skew.salted_join(big, lookup, ["k"], "k", ["id"], how)
        assert rows(got.select("id", "v")) == rows(big.join(lookup, "k", how).select("id", "v"))


def test_grid_in_blocks_equals_grid_in_plan(spark, rows, monkeypatch):
    few, many = spark.range(23).withColumnRenamed("id", "a"), spark.range(17).withColumnRenamed("id", "b")
    want = sorted(((a, b) for a in range(23) for b in range(17)), key=repr)
    assert rows(skew.grid(few, many)) == want
    assert rows(skew.grid(few, many, literal_rows=5, slices=3)) == want
    monkeypatch.setattr(skew, "SLICE_ROWS", 4)
    assert rows(skew.grid(few, many, literal_rows=5)) == want
    assert skew.grid(few.limit(0), many).count() == 0


def test_window_start():
    day = datetime.date
    assert window_start("2020-01-01", datetime.datetime(2020, 6, 1, 12), 30) == day(2020, 5, 2)
    assert window_start("2020-05-20", day(2020, 6, 1), 30) == day(2020, 5, 20)


LISTING = """<html><body><article class="widget-content widget-eps-search-result-widget widget">
<div class="notice-search-item"><div class="notice-search-item-header"><img src="/img/flags/flag_no.png">
<a class="pull-right doc-icon" href=" https://docs.example.org/1 ">doc</a><a href="/Notice/1">Drift &amp; vedlikehold av <b>vei</b></a></div>
<div class="left-col"><div>Publisert av: <a href=" https://by.example.org ">Byen</a></div><div>Kunngjøringstype: Kunngjøring</div></div>
<div class="right-col"><div>Doffin referanse: 2016-1</div><div>Frist: <span>2016-04-02</span></div><div>Kunngjøringsdato: 2016-03-01</div></div>
<div>Kommune: Oslo</div><div>Fylke: Akershus</div></div>
<div class="notice-search-item"><div class="notice-search-item-header"><img src="/x_eu.gif"><a href="/Notice/2">Kort</a></div>
<div class="left-col"><div>Publisert av: Kontoret</div><div>Kunngjøringstype: Veiledende</div></div>
<div class="right-col"><div>Doffin referanse: 2016-2</div><div>Kunngjøringsdato: 2016-03-02</div></div></div></article></body></html>"""


def test_listing_records(spark):
    pages = spark.createDataFrame([(1, LISTING), (2, "<p>no listing"), (3, None)], "page_id bigint, html string")
    df = H.extract_listing(pages)
    assert df.schema.fieldNames() == TENDER.fieldNames()
    one, two = df.orderBy("doffinReference").collect()
    assert one["name"] == "Drift & vedlikehold av vei" and one["internalUrl"] == "/Notice/1" and one["flag"] == "no"
    assert (one["publishedBy"], one["publishedByUrl"], one["externalUrl"]) == ("Byen", "https://by.example.org", "https://docs.example.org/1")
    assert (one["county"], one["municipality"], one["announcementType"]) == ("Akershus", "Oslo", "Kunngjøring")
    assert one["announcementDate"] == 1456790400000 and one["tenderDeadline"] == 1459555200000
    assert (two["doffinReference"], two["tenderDeadline"], two["county"], two["externalUrl"], two["flag"]) == ("2016-2", None, None, None, "eu")


def test_json_and_names(spark):
    t = spark.createDataFrame([("navn", "/1", "no", "by", None, "r", "t", 1, None, None, None, None, None)], TENDER)
    text = to_json_rows(t)
    assert '"internalUrl":"/1"' in text.first()["json"]
    assert from_json_rows(text, TENDER).drop("json").collect() == t.collect()
    assert "announcement_date" in snake_columns(t).columns


def test_stream_replay_adds_nothing(spark, rows, tmp_path):
    table, source = str(tmp_path / "t"), str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.parquet(source)
    fold = I.append_unseen(table, ["k"], ["v"])

    def run(checkpoint):
        stream = I.read_stream(spark, source, spark.read.parquet(source).schema)
        I.write_stream(stream, fold, str(tmp_path / checkpoint), available_now=True).awaitTermination()
        return rows(I.read_batches(spark, table, stream.schema))

    assert run("one") == [(1, "b"), (2, "c")]
    # The position is kept: nothing is read again; a lost position runs the batch once more.
    assert run("one") == run("two") == [(1, "b"), (2, "c")]
    spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string").write.mode("append").parquet(source)
    assert run("one") == [(1, "b"), (2, "c"), (3, "d")]


def test_unseen_keys_over_many_batches(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(I.KeyIndex, "FOLD", 3)
    table = str(tmp_path / "t")
    schema = "k bigint, g string, v int"

    def written():
        return rows(I.read_batches(spark, table, spark.createDataFrame([], schema).schema))

    # A table from before it had an index; batch 1 was empty, batch 2 never came.
    I.append_batches(table)(spark.createDataFrame([(0, "a", 0), (None, "a", 0)], schema), 0)
    I.append_batches(table)(spark.createDataFrame([], schema), 1)
    fold, want = I.append_unseen(table, ["k", "g"], ["v"], buckets=8), {(0, "a"): 0, (None, "a"): 0}
    rng = random.Random(1)
    for batch in range(3, 12):
        some = [(rng.randrange(12), rng.choice("ab"), batch * 10 + i) for i in range(4)]
        for k, g, v in some:
            if want.get((k, g), batch * 10) >= batch * 10:
                want[k, g] = v
        for _ in range(2 if batch % 4 == 0 else 1):  # some batches are run again
            fold(spark.createDataFrame(some, schema), batch)
    assert written() == sorted(((k, g, v) for (k, g), v in want.items()), key=repr)


def test_unseen_keys_read_their_buckets_only(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    fold = I.append_unseen(table, ["k"], buckets=16)
    fold(spark.range(100).toDF("k"), 0)
    index = I.KeyIndex(spark, table, spark.range(1).toDF("k").schema, buckets=5)
    assert index.buckets == 16
    assert rows(index.met(spark.range(99, 103).toDF("k"), 1)) == [(99,), (100,), (101,), (102,)][:1]
    asked = index._bucketed(spark.range(7, 8).toDF("k")).first()["key_bucket"]
    spoiled = [p for p in tmp_path.glob("t-keys/level=0/number=0/key_bucket=*/*.parquet") if p.parent.name != f"key_bucket={asked}"]
    assert len(spoiled) == 15
    for path in spoiled:
        path.with_name(f".{path.name}.crc").unlink()
        path.write_bytes(b"no table")
    assert rows(index.met(spark.range(7, 8).toDF("k"), 1)) == [(7,)]


def test_unseen_keys_after_a_lost_position(spark, rows, tmp_path):
    table = str(tmp_path / "t")
    fold = I.append_unseen(table, ["k"])
    for batch, (low, high) in enumerate([(0, 2), (1, 4), (3, 5)]):
        fold(spark.range(low, high).toDF("k"), batch)
    # The stream starts again, with other batches under the same numbers.
    for batch, (low, high) in enumerate([(0, 4), (2, 5), (4, 6)]):
        fold(spark.range(low, high).toDF("k"), batch)
    assert rows(spark.read.parquet(table).select("k")) == [(i,) for i in range(6)]


def test_dedup_within_a_watermark(spark, rows, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at), (1, at + datetime.timedelta(seconds=5)), (2, at)], "k int, ts timestamp").write.parquet(source)
    stream = I.dedup_within(I.read_stream(spark, source, spark.read.parquet(source).schema), ["k"], "ts", "1 hour")
    I.write_stream(stream.select("k"), I.append_batches(out), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert rows(spark.read.parquet(out).select("k")) == [(1,), (2,)]


def test_defaults(spark):
    df = spark.createDataFrame([(None, None), ("n", 3)], "name string, time bigint")
    filled = T.with_defaults(df).collect()
    assert filled[1]["name"] == "n" and filled[1]["time"] == 3 and len(filled[0]["name"]) == 36 and filled[0]["time"] > 0
    labelled = T.with_defaults(spark.createDataFrame([(None,), ("0",)], "label string")).collect()
    assert [r["label"] for r in labelled] == ["1", "0"]


def test_letters():
    assert len(EDIT_LETTERS) == 30


def test_labels_of_place_fields_start_their_text(spark):
    page = LISTING.replace("Kommune: Oslo", "Kommune: Voss")
    page = page.replace('<div>Kommune:', '<div>Publisert for: Bergen Kommune, Hordaland Fylkeskommune</div><div>Kommune:')
    got = H.extract_listing(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first().asDict()
    assert "Voss" in got["municipality"] and "Akershus" in got["county"]


def test_tag_text_needs_the_whole_name(spark):
    df = spark.createDataFrame([("<article>x</article><A href='y'>z</A>",)], "h string")
    assert df.select(H.tag_text(df["h"], "a")).first()[0] == "z"


def test_lines_keep_control_characters(spark, tmp_path):
    from textvane.sources.textfiles import read_lines

    (tmp_path / "a.txt").write_bytes("abc\x01def\r\n\nblåbær".encode("latin-1"))
    assert [r["line"] for r in read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["abc\x01def", "blåbær"]


def test_only_a_missing_folder_counts_as_empty(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from pyspark.sql import types as T

    from textvane.streaming.ingest import read_batches

    schema = T.StructType([T.StructField("k", T.LongType())])
    assert read_batches(spark, str(tmp_path / "none"), schema).count() == 0
    twice = T.StructType([T.StructField("k", T.LongType()), T.StructField("k", T.LongType())])
    spark.range(1).write.parquet(str(tmp_path / "some" / "batch=0"))
    with pytest.raises(AnalysisException):
        read_batches(spark, str(tmp_path / "some"), twice).count()


def test_refresh_forgets_scores_of_labelled_items(spark, tmp_path):
    service = Refresher(spark, str(tmp_path))
    service.on_items(spark.createDataFrame([(1, "red sun"), (2, "blue sea"), (3, "red sea")], "item long, text string"), 0)
    columns = "user string, item long, time long, label string"
    service.on_labels(spark.createDataFrame([("u", 1, 1, "1"), ("v", 1, 1, "0")], columns), 0)
    assert sorted((r.user, r["item"]) for r in service.scores().collect()) == [("u", 2), ("u", 3), ("v", 2), ("v", 3)]
    service.on_labels(spark.createDataFrame([("u", 2, 2, "0"), ("u", 3, 3, "1")], columns), 1)
    service.on_labels(spark.createDataFrame([("u", 2, 2, "0"), ("u", 3, 3, "1")], columns), 1)
    assert sorted((r.user, r["item"]) for r in service.scores().collect()) == [("v", 2), ("v", 3)]
