"""Quality rules by compression bands.

zstandard ratios (compressed over raw bytes) of the whole text and of its fixed-size chunks are
held against limits for the text's length: below the band a text is repetitive, above it
incompressible. Scripts of two or three bytes a character have regular lead bytes, so the low limit
is held against compressed bytes a character, and the high one rises with the bytes a character.
Base rules on words come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from . import words

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by the text's length in bytes.

    Each entry holds from its length up to the next: (bytes, lowest compressed bytes a character,
    highest ratio of the whole where a character is one byte; `wide` is added for each further one).
    Longer texts compress better, so the limits fall with length. Of licence texts and message
    catalogues in some 100 languages, cut at each length, the lowest had 0.57, 0.50, 0.46, 0.39, 0.34,
    0.33 and 0.34 bytes a character, the lowest chunk 0.33: the low limits are what only repetition reaches.
    Chunks of exactly `chunk_bytes` have their own band; a text fails when more than `chunk_share`
    of its full chunks lie outside. Texts below the first length have no ratio that tells.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (256, 0.40, 0.85),
        (512, 0.35, 0.76),
        (1024, 0.30, 0.68),
        (4096, 0.25, 0.58),
        (16384, 0.25, 0.52),
        (65536, 0.20, 0.50),
        (262144, 0.15, 0.48),
    )
    wide: float = 0.1
    chunk_bytes: int = 4096
    chunk_low: float = 0.25
    chunk_high: float = 0.62
    chunk_share: float = 0.5
    level: int = 3


FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"),
    ("n_chunks", "long"), ("n_low_chunks", "long"), ("n_high_chunks", "long"), ("reason", "string"),
]


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def repeat_words(w: words.Words, rows: int) -> np.ndarray:
    """Of each row the words inside windows of five that its text holds twice or more."""
    at, key = words.windows(w, REPEAT_WINDOW)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(at):
        key = words.mix(key + w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + REPEAT_WINDOW, -1)
    hit = np.cumsum(covered[:-1]) > 0
    return np.bincount(w.row[hit], minlength=rows)[:rows]


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(column: pa.Array, bands: Bands, packer: zstandard.ZstdCompressor) -> dict[str, list]:
    """All measures and verdicts of one chunk of rows."""
    rows = len(column)
    data, off = words.text_bytes(column)
    w = words.split(column)
    out: dict[str, list] = {}
    n_words = np.diff(w.first)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    repeated = repeat_words(w, rows)
    out["n_words"] = n_words.tolist()
    out["word_chars"] = _per_row(~words.SPACE[data] & ((data & 0xC0) != 0x80), off).tolist()
    out["n_symbols"] = _per_row(symbol[data], off).tolist()
    out["n_repeat_words"] = repeated.tolist()
    failed = (n_words < 10) | (100 * repeated > 20 * n_words)
    out["base_failed"] = failed.tolist()
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    for name in ("n_dup_lines", "kept", "ratio", "n_chunks", "n_low_chunks", "n_high_chunks", "reason"):
        out[name] = []
    for i, text in enumerate(column.to_pylist()):
        raw = data[off[i]:off[i + 1]].tobytes()
        out["n_dup_lines"].append(dup_lines(text) if text and "\n" in text else 0)
        ratio = len(packer.compress(raw)) / len(raw) if raw else None
        size = bands.chunk_bytes
        starts = np.arange(0, len(raw) - size + 1, size)
        parts = np.array([len(packer.compress(raw[k:k + size])) / size for k in starts.tolist()])
        broad = size / np.maximum(1, chars[off[i] + starts + size] - chars[off[i] + starts])
        low = int((parts * broad < bands.chunk_low).sum())
        high = int((parts > bands.chunk_high + bands.wide * (broad - 1)).sum())
        width = len(raw) / max(1, chars[off[i + 1]] - chars[off[i]])
        limits = [b for b in bands.whole if b[0] <= len(raw)]
        reason = None
        if failed[i]:
            reason = "short" if n_words[i] < 10 else "repeated windows"
        elif limits and ratio * width < limits[-1][1] or low > bands.chunk_share * len(parts):
            reason = "repetitive"
        elif limits and ratio > limits[-1][2] + bands.wide * (width - 1) or high > bands.chunk_share * len(parts):
            reason = "incompressible"
        out["ratio"].append(ratio)
        out["n_chunks"].append(len(parts))
        out["n_low_chunks"].append(low)
        out["n_high_chunks"].append(high)
        out["kept"].append(reason is None)
        out["reason"].append(reason)
    return out


def quality(docs: DataFrame, bands: Bands = Bands(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of `docs`: its `keep` columns, then word measures, ratios and the verdict.

    Null and empty texts have no words and fail the base rules; their ratio is null. Repeated rows
    are judged one by one. A `keep` column named like a measure gets the suffix "_in". Texts of any
    length are taken whole. No shuffle.
    """
    taken = {name for name, _ in FIELDS}
    source = docs.select(*[F.col(c).alias(f"{c}_in" if c in taken else c) for c in keep], F.col("text").alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, *T._parse_datatype_string(
        ", ".join(f"{n} {t}" for n, t in FIELDS)).fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi in words.chunks(column):
                got = measure(column.slice(lo, hi - lo), bands, packer)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                    + [pa.array(got[n], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
                                         "string": pa.string()}[t]) for n, t in FIELDS],
                    names=schema.names,
                )

    return source.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of `docs` that every rule keeps, with their columns; rows are judged in place."""
    schema = docs.schema
    at = schema.names.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for lo, hi in words.chunks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(measure(part.column(at), bands, packer)["kept"], pa.bool_()))

    return docs.mapInArrow(judge, schema)
