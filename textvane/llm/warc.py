"""WARC archives by way of a chunked record table.

A payload becomes rows of (record, chunk number, at most `chunk` bytes) as it is read, each with the digests of
the payload up to its end, carried from row to row; no task holds more of a payload than its row. In the
archives every chunk is a record of its own: the first a `response`, the others `continuation` segments that
name their origin and number, as the format provides. So chunks need not stay together: writing moves nothing
but the chunks of payloads that have an equal elsewhere, and a reader meets no record above the chunk size.

Every record starts with its version and the identifier of one `warcinfo` record, drawn when the archives are
written. No payload can hold that line, so Spark's text reader cuts archives exactly at it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.skew import salted_join
from ..session import new_path, stage
from . import semijoin

# Fixed values of the format: line ends, version, content types, revisit profile.
END = "\r\n"
VERSION = "WARC/1.1"
HTTP = "application/http; msgtype=response"
FIELDS = "application/warc-fields"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Options:
    chunk: int = 128 << 10  # payload bytes of a row and of a record
    least: int = 1000  # smaller payloads are written out however often they come
    compression: str = "gzip"  # of whole files; "none" lets readers split them


def chunked(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url", o: Options = Options()) -> DataFrame:
    """(record, key, url, chunk, last, size, sha1, sha256, data): the payloads of `pages` in rows of `o.chunk` bytes.

    Strings count in UTF-8; null is an empty payload, which has one empty chunk. size, sha1 and sha256 are those of
    the payload up to the end of the row's chunk. `record` numbers the rows of `pages`, repeated ones each for
    itself; it holds for this table only, so write the table before it is used twice.
    """
    link = F.col(url).cast("string") if url else F.lit(None).cast("string")
    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col(key).cast("string").alias("key"), link.alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("whole"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("whole") / o.chunk)).cast("int")
    rows = rows.withColumn("chunks", count).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    data = F.expr(f"substring(whole, chunk * {o.chunk} + 1, {o.chunk})")
    rows = rows.select("record", "key", "url", "chunk", (F.col("chunk") == F.col("chunks") - 1).alias("last"), data.alias("data"))
    return _carried(rows, "record long, key string, url string, chunk int, last boolean, size long, sha1 string, sha256 string, data binary")


def _carried(rows: DataFrame, schema: str) -> DataFrame:
    """`rows` with size, sha1 and sha256 of all data since chunk 0, before `data`; chunks follow each other in order."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, one, two = 0, hashlib.sha1(), hashlib.sha256()
        for batch in batches:
            sizes, ones, twos = [], [], []
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                if number == 0:
                    size, one, two = 0, hashlib.sha1(), hashlib.sha256()
                piece = data.as_buffer()
                size += len(piece)
                one.update(piece)
                two.update(piece)
                sizes.append(size)
                ones.append(one.hexdigest())
                twos.append(two.hexdigest())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(ones, pa.string()), pa.array(twos, pa.string()), batch.column("data")],
                names=[*names, "size", "sha1", "sha256", "data"])

    return rows.mapInArrow(carry, schema)


def revisits(chunks: DataFrame, o: Options = Options()) -> DataFrame:
    """(record, key, url, size, sha1, lead_record, lead_key): records whose payload another one keeps.

    Of equal payloads of at least `o.least` bytes the record of largest key is kept (by number, then as text, null keys
    last), of equal keys that of largest record number. Payloads are equal if their lengths and SHA-256 digests are.
    """
    whole = chunks.filter(F.col("last") & (F.col("size") >= o.least)).select("record", "key", "url", "size", "sha1", "sha256")
    number = F.col("key").try_cast("decimal(38,0)")
    lead = whole.groupBy("sha256").agg(F.max(F.struct(number.alias("n"), "key", "record")).alias("lead"), F.count(F.lit(1)).alias("copies"))
    lead = lead.filter("copies > 1").select("sha256", F.col("lead.record").alias("lead_record"), F.col("lead.key").alias("lead_key"))
    return salted_join(whole, lead, ["sha256"], "sha256", ["record"]).filter("record != lead_record").drop("sha256")


def _urn(run: str, record: str, chunk: Column | str, key: str) -> Column:
    """The identifier of a record: archive, record number, chunk number, and the key behind a `k` (null: nothing)."""
    named = F.coalesce(F.concat(F.lit("k"), F.url_encode(key)), F.lit(""))
    return F.concat(F.lit(f"<urn:textvane:{run}:"), F.col(record).cast("string"), F.lit(":"), F.col(chunk).cast("string") if isinstance(chunk, str) else chunk, F.lit(":"), named, F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _entry(run: str, date: str, kind: Column, lines: list[Column], block: Column) -> Column:
    """One record as the text writer takes it: it adds the second of the two line ends behind the block."""
    top = F.concat(F.lit(f"{VERSION}{END}WARC-Warcinfo-ID: <urn:uuid:{run}>{END}"), _line("WARC-Type", kind), _line("WARC-Date", F.lit(date)),
                   *lines, _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
                   _line("Content-Length", F.octet_length(block).cast("string")), F.lit(END))
    return F.concat(top.cast("binary"), block, F.lit(END).cast("binary")).cast("string").alias("value")


def _http(size: Column) -> Column:
    """The head of a response; the length is left out where a chunked payload's is not known yet."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), _line("Content-Length", size), F.lit(END)).cast("binary")


def write_archives(chunks: DataFrame, path: str, o: Options = Options(), date: str | None = None) -> str:
    """Write the records of a written chunk table (`chunked`) as WARC files into the folder `path`; returns their identifier.

    A payload's digest stands in its last record, as a writer that streams knows it only then. Urls with blanks or
    control characters are percent-encoded whole, null urls and keys left out. An empty table gives a `warcinfo` alone.
    """
    spark = chunks.sparkSession
    run = str(uuid.uuid4())
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = stage(revisits(chunks, o), "revisits")
    link = F.when(F.col("url").rlike("[\\x00-\\x20\\x7F]"), F.url_encode("url")).otherwise(F.col("url"))
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    one, first = F.col("last") & (F.col("chunk") == 0), F.col("chunk") == 0
    kept = semijoin.without(chunks, "record", again.select("record"))
    head = F.when(first, _http(F.when(one, F.col("size").cast("string")))).otherwise(F.lit(b""))
    kept = kept.withColumn("block", F.concat(head, F.col("data"))).select(_entry(run, date, F.when(first, "response").otherwise("continuation"), [
        _line("WARC-Record-ID", _urn(run, "record", "chunk", "key")), _line("WARC-Target-URI", link),
        _line("Content-Type", F.when(first, HTTP)), _line("WARC-Payload-Digest", F.when(F.col("last"), digest)),
        _line("WARC-Segment-Number", F.when(~one, (F.col("chunk") + 1).cast("string"))),
        _line("WARC-Segment-Origin-ID", F.when(~first, _urn(run, "record", F.lit("0"), "key"))),
        _line("WARC-Segment-Total-Length", F.when(F.col("last") & ~first, (F.col("size") + F.octet_length(_http(F.lit(None).cast("string")))).cast("string"))),
    ], F.col("block")))
    repeats = again.withColumn("block", _http(F.col("size").cast("string"))).select(_entry(run, date, F.lit("revisit"), [
        _line("WARC-Record-ID", _urn(run, "record", F.lit("0"), "key")), _line("WARC-Target-URI", link), _line("Content-Type", F.lit(HTTP)),
        _line("WARC-Payload-Digest", digest), _line("WARC-Profile", F.lit(IDENTICAL)),
        _line("WARC-Refers-To", _urn(run, "lead_record", F.lit("0"), "lead_key")),
    ], F.col("block")))
    about = spark.range(1, numPartitions=1).withColumn("block", F.lit(f"format: WARC File Format 1.1{END}").cast("binary")).select(_entry(run, date, F.lit("warcinfo"), [
        _line("WARC-Record-ID", F.lit(f"<urn:uuid:{run}>")), _line("Content-Type", F.lit(FIELDS))], F.col("block")))
    kept.unionByName(repeats).unionByName(about).write.mode("error").option("lineSep", END).option("compression", o.compression).text(path)
    return run


def _field(name: str) -> Column:
    """A header field of `head`, null where absent."""
    found = F.regexp_extract("head", f"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive_id(spark: SparkSession, path: str) -> str:
    """The identifier that all records below `path` carry, from any of them."""
    lines = spark.read.option("lineSep", END).text(path).filter(F.col("value").startswith("WARC-Warcinfo-ID: <urn:uuid:"))
    return lines.select(F.regexp_extract("value", "<urn:uuid:([^>]*)>", 1)).first()[0]


def read_archives(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """(record, key, url, kind, chunk, last, digest, refers_to, stated, data): the chunks in the archives below `path`.

    `run` is what `write_archives` returned; without it, it is looked up. stated is the payload length that a
    record's HTTP head gives, refers_to the key of the record that a revisit names. A record whose length or block
    digest is not as stated ends the job with an error.
    """
    run = run or archive_id(spark, path)
    mark = f"{VERSION}{END}WARC-Warcinfo-ID: <urn:uuid:{run}>{END}"
    rows = spark.read.option("lineSep", mark).text(path).filter(F.octet_length("value") > 0)
    rows = rows.select(F.substring_index("value", END * 2, 1).alias("head"), F.col("value").cast("binary").alias("raw"))
    rows = rows.withColumn("length", _field("Content-Length").cast("long"))
    block = F.expr("substring(raw, octet_length(head) + 5, cast(length as int))")
    whole = F.octet_length("raw") == F.octet_length("head") + 8 + F.col("length")
    block = F.when(~whole, F.raise_error(F.concat(F.lit("a record is not as long as stated: "), "head")).cast("binary")).otherwise(block)
    rows = rows.withColumn("block", block)
    stated = _field("WARC-Block-Digest")
    right = F.when(stated != F.concat(F.lit("sha1:"), F.sha1("block")), F.raise_error(F.concat(F.lit("a block is not as stated: "), "head")).cast("binary")).otherwise(F.col("block"))
    rows = rows.withColumn("block", right).withColumn("kind", _field("WARC-Type")).filter("kind != 'warcinfo'")
    own = _field("WARC-Record-ID")
    key_of = lambda urn: F.when(F.regexp_extract(urn, ":(k?)[^:]*>$", 1) == "k", F.url_decode(F.regexp_extract(urn, ":k([^:]*)>$", 1)))
    http = F.when(F.col("kind") == "continuation", "").otherwise(F.concat(F.substring_index(F.col("block").cast("string"), END * 2, 1), F.lit(END * 2)))
    rows = rows.withColumn("urn", own).withColumn("http", http).withColumn("digest", F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1))
    return rows.select(
        F.regexp_extract("urn", ":(\\d+):\\d+:[^:]*>$", 1).cast("long").alias("record"), key_of(F.col("urn")).alias("key"),
        _field("WARC-Target-URI").alias("url"), "kind", (F.coalesce(_field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk"),
        F.col("digest").isNotNull().alias("last"), "digest", key_of(_field("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract("http", "Content-Length: (\\d+)", 1).try_cast("long").alias("stated"),
        F.expr("substring(block, octet_length(http) + 1)").alias("data"))


def records(chunks: DataFrame) -> DataFrame:
    """(record, key, url, kind, size, sha1, refers_to): the records of `read_archives`, payloads digested anew.

    Only chunks of divided payloads move, each payload's to one task that takes them one after the other; whole ones
    send their digest. A missing chunk or another digest than stated ends the job with an error.
    """
    divided = ~(F.col("last") & (F.col("chunk") == 0))
    rows = chunks.withColumn("kind", F.when(F.col("kind") != "revisit", "response").otherwise("revisit"))
    rows = rows.withColumn("own", F.when(~divided & (F.col("kind") == "response"), F.sha1("data"))).withColumn("bytes", F.octet_length("data").cast("long"))
    rows = rows.withColumn("data", F.when(divided, F.col("data")).otherwise(F.lit(b"")))
    columns = ["record", "key", "url", "kind", "chunk", "last", "digest", "refers_to", "stated", "own", "bytes", "data"]
    rows = rows.select(columns).repartition("record").sortWithinPartitions("record", "chunk")
    schema = ("record long, key string, url string, kind string, chunk int, last boolean, digest string, refers_to string, stated long, "
              "own string, bytes long, size long, sha1 string, sha256 string, data binary")
    done = _carried(rows, schema).filter("last")
    sha1 = F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.coalesce("own", "sha1"))
    size = F.when(F.col("kind") == "revisit", F.col("stated")).when(F.col("own").isNotNull(), F.col("bytes")).otherwise(F.col("size"))
    sound = F.when(sha1 != F.col("digest"), F.raise_error(F.concat(F.lit("a payload is not as stated: record "), F.col("record").cast("string"))).cast("string")).otherwise(sha1)
    return done.select("record", "key", "url", "kind", size.alias("size"), sound.alias("sha1"), "refers_to")


def round_trip(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of (page_id, url, html) after a way through archives."""
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    run = write_archives(stage(chunked(pages, o=o), "chunks"), path, o)
    found = records(read_archives(spark, path, run))
    return found.select(F.col("key").cast("long").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
                        F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))
