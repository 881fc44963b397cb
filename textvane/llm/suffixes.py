"""Suffix-array dedup with sparse suffix arrays.

Only suffixes that start at an anchor, the smallest k-gram hash of some window, are kept. A shard sorts them
by what follows the anchor and by what comes before it, read backwards, and compares neighbours in
both orders. A match reaches as far right as the least common prefix between two places in the one order
and as far left as in the other; a window is repeated where both together span it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from . import semijoin
from .passages import Repeats, Shape, repeats

SHAPE = Shape(window=50, anchor=8, shard_words=1_000_000)


def _sorted(parts: list[np.ndarray], anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the parts (first by anchor) and the common prefix of each with the one before it."""
    n = len(parts)
    table = np.full((n, width), -1, np.int64)
    sizes = np.array([len(p) for p in parts])
    for i, p in enumerate(parts):
        table[i, :len(p)] = p
    order = np.lexsort((*table.T[::-1], anchor))
    table, sizes, anchor = table[order], sizes[order], anchor[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = np.hstack([table[1:] != table[:-1], np.ones((n - 1, 1), bool)])
        common[1:] = np.minimum(np.argmax(differ, axis=1), np.minimum(sizes[1:], sizes[:-1]))
        common[1:][anchor[1:] != anchor[:-1]] = -1
    common[0] = -1
    return order, common


def index(runs: list[np.ndarray], at: np.ndarray, anchor: np.ndarray, docs: np.ndarray, window: int) -> pa.ListArray:
    n = len(runs)
    right = [run[a:a + window] for run, a in zip(runs, at, strict=True)]
    left = [run[:a][::-1] for run, a in zip(runs, at, strict=True)]
    right_order, right_common = _sorted(right, anchor, window)
    left_order, left_common = _sorted(left, anchor, window)
    right_size, left_size = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    # Windows of all runs one after the other.
    first = np.concatenate([[0], np.cumsum([max(0, len(run) - window + 1) for run in runs])])
    out, known = np.zeros(first[-1], np.int64), np.zeros(first[-1], bool)
    for back in range(int(left_size.max(initial=0)) + 1):
        ahead = window - back
        has = np.flatnonzero((left_size >= back) & (right_size >= ahead))
        if not len(has):
            continue
        # Neighbours that agree on enough words stand in one run of the order.
        group = np.zeros((2, n), np.int64)
        group[0, right_order] = np.cumsum(right_common < ahead)
        group[1, left_order] = np.cumsum(left_common < back)
        _, which = np.unique(group[0, has] * (n + 1) + group[1, has], return_inverse=True)
        least = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, which, docs[has])
        place = first[has] + at[has] - back
        out[place], known[place] = least[which], True
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(out, mask=~known))


def dedup(docs: DataFrame, shape: Shape = SHAPE) -> Repeats:
    """Suffix-array dedup of (doc_id, text): passages of `window` words or more that a smaller doc_id has.

    See `repeats` for rows, edge cases and columns.
    """
    return repeats(docs, shape, index)


def strip_repeats(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """The rows of `docs` without repeated passages; rows that lose all their words go.

    Texts keep their spacing; only removed words and the space behind them go.
    """
    found = dedup(docs, shape)
    gone = stage(found.rows.filter("n_removed > 0 and n_removed = n_words").select("doc_id").distinct(), "gone")
    part = stage(found.changed.filter("kept_text is not null").select("doc_id", F.col("kept_text").alias("_kept")).join(gone, "doc_id", "left_anti"), "part")
    rest = semijoin.without(docs, "doc_id", stage(gone.unionByName(part.select("doc_id")).distinct(), "touched"))
    cut = semijoin.matching(docs, "doc_id", part.dropDuplicates(["doc_id"]))
    return rest.unionByName(cut.select(*[F.col("_kept").alias(c) if c == "text" else F.col(c) for c in docs.columns]))
