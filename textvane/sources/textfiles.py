"""Text in an explicit charset, and texts labelled by their directory."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# Texts below one folder of `write_labelled_dirs`, so that many folders can be listed side by side.
FOLDER_TEXTS = 5_000
# Bytes of texts that a task which reads them holds at a time.
READ_BYTES = 4 << 20
# What Spark's writers put for a null, and the characters they escape in the name of a directory.
NULL_DIRECTORY = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
# The characters that are escaped once more where Spark names a file.
QUOTED = re.compile("[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def read_lines(spark: SparkSession, path: str, charset: str = "ISO-8859-1") -> DataFrame:
    """(line, line_no) of text files in the given charset.

    The text reader hands on the bytes of a line as they are, so they are decoded after it; empty
    lines are left out. line_no grows with the place in the file: its block start followed by a
    counter, so no task needs to see the lines before its own.
    """
    lines = spark.read.text(path).select(F.decode(F.col("value").cast("binary"), charset).alias("line"), "_metadata")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("line", place.alias("line_no")).filter(F.col("line") != "")


def write_lines(lines: DataFrame, path: str, charset: str = "ISO-8859-1") -> None:
    """Write a one-column table as text files in the given charset, in row order."""
    (
        lines.write.option("encoding", charset)
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escape", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def _label_directory(label: str | None) -> str:
    value = NULL_DIRECTORY if not label else ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", label)
    return f"label={value}"


def _write_texts(path: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        place, made, folder, n = uuid.uuid4().hex, set(), "", 0
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n % FOLDER_TEXTS == 0:
                    folder = f"{place}-{n // FOLDER_TEXTS:06d}"
                    yield pa.RecordBatch.from_pydict({"folder": [folder]})
                where = f"{root}/{folder}/{_label_directory(label)}"
                if where not in made:
                    store.create_dir(where)
                    made.add(where)
                with store.open_output_stream(f"{where}/{n:09d}.txt", compression=None) as out:
                    out.write((text or b"") + b"\n")
                n += 1

    return write


def write_labelled_dirs(texts: DataFrame, path: str) -> list[str]:
    """Write (label, text) one text per file, ended by a line break, in a `label=` directory for each label.

    The directories lie in folders of FOLDER_TEXTS texts, which are returned. A try of a task writes folders of its own and
    only those of tries that came through are returned, so what a lost try left is never read. The files are written by
    the tasks themselves: Spark's writer moves each of them once more in the driver, one after the other.
    """
    plain = texts.select("label", F.col("text").cast("binary").alias("text"))
    return [os.path.join(path, r["folder"]) for r in plain.mapInArrow(_write_texts(path), "folder string").collect()]


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.binary())], ["label", "text"])

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, root = fs.FileSystem.from_uri(folder)
            for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
                if info.type != fs.FileType.File:
                    continue
                with store.open_input_stream(info.path, compression=None) as given:
                    held.append((QUOTED.sub(lambda c: quote(c[0]), info.path.rsplit("/", 2)[-2]), given.read()))
                size += len(held[-1][1])
                if size >= READ_BYTES:
                    yield sent()
                    held, size = [], 0
    if held:
        yield sent()


def read_labelled_dirs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(label, text): whole files below one folder, or several folders of write_labelled_dirs, labelled with the name of their directory.

    Several folders are listed by the tasks that read them: the driver never holds the names of their files.
    """
    if not path:
        return spark.createDataFrame([], "label string, text string")
    if not isinstance(path, str):
        folders = spark.createDataFrame([(p,) for p in path], "folder string").repartition(len(path))
        read = folders.mapInArrow(_read_texts, "label string, text binary")
        return read.select("label", F.col("text").cast("string").alias("text"))
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("label"),
        F.col("value").alias("text"),
    )
