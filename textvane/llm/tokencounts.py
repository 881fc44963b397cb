"""Token counts of documents in flat token files without an index, by a separator scan.

A file is one run of ids in which every document ends with a separator. It is read in blocks of
fixed size that know nothing of documents; each block finds its separators in one vector
comparison, and a prefix scan over the blocks of a file stitches the documents that cross them: first
over groups of blocks by their totals, then inside each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import new_path, stage
from . import tokenizer

BLOCK = 1 << 16
END_ID = 50256
GROUP = 64  # blocks that one task scans with their documents' lengths


def id_type(path: str = tokenizer.DEFAULT, end_id: int = END_ID) -> str:
    """The narrowest form of an id that holds every id of a tokenizer, and the separator."""
    return "<u2" if max(tokenizer.encoding(path).max_token_value, end_id) < 1 << 16 else "<u4"


def write_flat(docs: DataFrame, path: str = tokenizer.DEFAULT, end_id: int = END_ID, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, names): the flat files of (doc_id, text), one a task, and which document came in which place.

    blocks: file, block, tokens (ids as `id_type` says; all but a file's last have `block` ids).
    names: file, ordinal, doc_id. A special token spelt out in a text is plain text, so the separator
    marks ends only. Null texts have no ids but their separator.
    """
    schema = "file int, block long, tokens binary, ordinal long, doc_id long"
    kind = id_type(path, end_id)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, ordinal = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        have = 0

        def rows(tokens: list[bytes], first: int, ids: list[int | None], at: int) -> pa.RecordBatch:
            n, m = len(tokens), len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * (n + m), pa.int32()),
                pa.array([*range(first, first + n), *[None] * m], pa.int64()),
                pa.array([*tokens, *[None] * m], pa.binary()),
                pa.array([*[None] * n, *range(at, at + m)], pa.int64()),
                pa.array([*[None] * n, *ids], pa.int64()),
            ], names=["file", "block", "tokens", "ordinal", "doc_id"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                for text in batch.column(1).to_pylist():
                    got = np.append(tokenizer.ids(text, path, special=False), end_id).astype(kind)
                    held.append(got)
                    have += len(got)
                run = np.concatenate(held) if held else np.zeros(0, kind)
                full = have // block
                yield rows([run[k * block:(k + 1) * block].tobytes() for k in range(full)], number,
                           batch.column(0).to_pylist(), ordinal)
                held, have = [run[full * block:]], have - full * block
                number, ordinal = number + full, ordinal + batch.num_rows
        if have:
            yield rows([np.concatenate(held).tobytes()], number, [], ordinal)

    spark = docs.sparkSession
    target = new_path(spark, "flat")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(flat, schema).write.option("compression", "zstd").parquet(target)
    stored = spark.read.schema(schema).parquet(target)
    return (stored.filter("tokens is not null").select("file", "block", "tokens"),
            stored.filter("ordinal is not null").select("file", "ordinal", "doc_id"))


def read_flat(spark: SparkSession, path: str, block: int = BLOCK, kind: str = "<u2") -> DataFrame:
    """Blocks (file, block, tokens) of binary files of ids below `path`; `file` is the file's path."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = block * np.dtype(kind).itemsize
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [content[k:k + width] for k in range(0, len(content), width)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary()),
                ], names=["file", "block", "tokens"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cut, "file string, block long, tokens binary")


def token_counts(blocks: DataFrame, end_id: int = END_ID, block: int = BLOCK, kind: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens): the ids (each as `kind`) before each separator, which itself is not counted.

    Ids after a file's last separator make one more document. Empty documents count 0; a document
    may cross any number of blocks. Files without ids give nothing.
    """
    file_type = dict(blocks.dtypes)["file"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts, counts, gaps, ends = [], [], [], [], []
            for number, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind)
                at = np.flatnonzero(ids == end_id) + number * block
                counts.append(len(at))
                firsts.append(int(at[0]) if len(at) else None)
                lasts.append(int(at[-1]) if len(at) else None)
                gaps.append((np.diff(at) - 1).tolist())
                ends.append(number * block + len(ids))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()),
                pa.array(lasts, pa.int64()), pa.array(gaps, pa.list_(pa.int64())), pa.array(ends, pa.int64()),
            ], names=["file", "block", "n", "first", "last", "gaps", "end"])

    found = blocks.select("file", "block", "tokens").mapInArrow(
        scan, f"file {file_type}, block long, n long, first long, last long, gaps array<long>, end long")
    # Read for the totals of the groups and again for their blocks.
    found = stage(found.withColumn("part", F.floor(F.col("block") / GROUP)), "separators")
    totals = found.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("block").alias("top"))
    whole, before = Window.partitionBy("file"), Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.select(
        "file", "part", F.sum("n").over(before).alias("n_before"), F.max("last").over(before).alias("last_before"),
        F.max("top").over(whole).alias("top"))
    earlier = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = found.select("*", F.max("last").over(earlier).alias("near"), F.sum("n").over(earlier).alias("n_near"))
    scanned = inside.join(groups, ["file", "part"]).select(
        "file", "first", "gaps", "end", "last",
        F.coalesce("near", "last_before", F.lit(-1)).alias("open"),
        (F.coalesce("n_before", F.lit(0)) + F.coalesce("n_near", F.lit(0))).alias("base"),
        (F.col("block") == F.col("top")).alias("final"))
    lengths = F.when(F.col("first").isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(
        F.concat(F.array(F.col("first") - F.col("open") - 1), "gaps"))
    tail = F.col("end") - F.coalesce("last", "open") - 1
    lengths = F.when(F.col("final") & (tail > 0), F.concat(lengths, F.array(tail))).otherwise(lengths)
    return scanned.select("file", "base", F.posexplode(lengths).alias("pos", "n_tokens")).select(
        "file", (F.col("base") + F.col("pos")).alias("ordinal"), "n_tokens")


def count_tokens(docs: DataFrame, path: str = tokenizer.DEFAULT) -> DataFrame:
    """(doc_id, n_tokens) of every row of `docs`, read back from its flat token files."""
    blocks, names = write_flat(docs, path)
    return names.join(token_counts(blocks, kind=id_type(path)), ["file", "ordinal"]).select("doc_id", "n_tokens")
