"""Grouping of many 64-bit keys: packed by task into a few rows a bucket, unpacked where they meet."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, keys binary, vals binary"
# Pairs that one bucket holds on average; a bucket is worked on in one task's memory.
BUCKET_PAIRS = 1 << 18
# Pairs that a task gathers before it sends them on; each lies several times in the worker and in the JVM.
HELD_PAIRS = 1 << 17


def count_for(pairs: int) -> int:
    return max(1, -(-pairs // BUCKET_PAIRS))


def rows(pairs: Iterable[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, keys, vals) from arrays of unsigned keys and values, gathered before they are cut up."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    have = 0
    for keys, vals in pairs:
        held.append((keys, vals))
        have += len(keys)
        if have >= max(HELD_PAIRS, 64 * buckets):
            yield _cut(held, buckets)
            held, have = [], 0
    if have:
        yield _cut(held, buckets)


def _cut(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    keys = np.concatenate([k for k, _ in held])
    vals = np.concatenate([v for _, v in held])
    place = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    keys, vals, place = keys[order], vals[order], place[order]
    found, first = np.unique(place, return_index=True)
    ends = [*first[1:], len(place)]
    return pa.RecordBatch.from_arrays([
        pa.array(found, pa.int32()),
        pa.array([keys[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
        pa.array([vals[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
    ], names=["bucket", "keys", "vals"])


def shared(packed: DataFrame) -> DataFrame:
    """(key, val), each once, of all keys that have two or more different values."""

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        vals = np.frombuffer(b"".join(table.column("vals").to_pylist()), np.uint64)
        # Most keys have one value; sort the few that come twice.
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        keys, vals = keys[twice], vals[twice]
        order = np.lexsort((vals, keys))
        keys, vals = keys[order], vals[order]
        new_key = np.ones(len(keys), bool)
        new_key[1:] = keys[1:] != keys[:-1]
        once = new_key.copy()
        once[1:] |= vals[1:] != vals[:-1]
        keys, vals, new_key = keys[once], vals[once], new_key[once]
        group = np.cumsum(new_key) - 1
        many = (np.bincount(group)[group] > 1) if len(group) else np.zeros(0, bool)
        return pa.table({"key": pa.array(keys[many].view(np.int64)), "val": pa.array(vals[many].view(np.int64))})

    return packed.groupBy("bucket").applyInArrow(meet, "key long, val long")
