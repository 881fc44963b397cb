"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the likelihood of the text under byte trigram models, the
language the markup declares, the address suffix, and the host. How far declarations, suffixes and
hosts can be trusted is learnt from all pages by grouped sums of the text posteriors; a host's prior is
smoothed towards its suffix's, and that towards all pages', with the page itself left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from . import semijoin
from .urls import host

SLOTS = 1 << 14
_OPEN = re.compile(r"(?i)<(?:(script|style)\b|!--|)")
_CLOSE = {kind: re.compile(rf"(?i)</{kind}\s*>") for kind in ("script", "style")}
_DECLARED = r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})"


@dataclass(frozen=True)
class Options:
    """sample: labelled texts for each language that the trigram models are fitted on, the only bound here.

    full_text: trigrams from which on more text adds no weight; trigrams overlap, so their
    likelihoods are tempered. strength: pages that a smoothed prior counts as.
    """

    sample: int = 500
    full_text: int = 200
    strength: float = 20.0
    trust: float = 5.0


def _slots(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int64)
    return (raw[:-2] * 7919 + raw[1:-1] * 613 + raw[2:]) % SLOTS if len(raw) > 2 else np.zeros(0, np.int64)


def train(labelled: DataFrame, options: Options = Options()) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and slot) from (doc_id, text, lang).

    Per language the `sample` documents of smallest id hash are taken, whole texts each.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    named = labelled.filter("lang is not null and doc_id is not null")
    chosen = named.select("doc_id", "lang").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= options.sample)
    texts = semijoin.matching(named.select("doc_id", "text"), "doc_id", chosen.select("doc_id", "lang").dropDuplicates(["doc_id"]))

    def fit(table: pa.Table) -> pa.Table:
        counts = np.zeros(SLOTS)
        for text in table.column("text").to_pylist():
            np.add.at(counts, _slots(text or ""), 1)
        logs = np.log((counts + 0.5) / (counts.sum() + 0.5 * SLOTS))
        return pa.table({"lang": table.column("lang").slice(0, 1), "logs": pa.array([logs.astype("<f8").tobytes()], pa.binary())})

    # One row for each language.
    rows = sorted(texts.groupBy("lang").applyInArrow(fit, "lang string, logs binary").collect())
    return [r["lang"] for r in rows], np.stack([np.frombuffer(r["logs"], "<f8") for r in rows]) if rows else np.zeros((0, SLOTS))


def page_text(html: str) -> str:
    """What a reader sees: without scripts, styles, comments and tags, in one pass.

    A script, style or comment that nothing closes loses its opening tag alone; an open tag is text.
    """
    out, at, unclosed = [], 0, set()
    while (start := html.find("<", at)) >= 0:
        found = _OPEN.match(html, start)
        kind, end = (found.group(1) or found.group(0)).lower(), -1
        if kind in _CLOSE and kind not in unclosed:
            close = _CLOSE[kind].search(html, found.end())
            end = close.end() if close else -1
        elif kind == "<!--" and kind not in unclosed:
            close = html.find("-->", start + 4)
            end = close + 3 if close >= 0 else -1
        if end < 0:
            unclosed.add(kind)
            if (end := html.find(">", start) + 1) == 0:
                break
        out += html[at:start], " "
        at = end
    return "".join([*out, html[at:]])


def _declared(html: Column) -> Column:
    """The language that the first html tag names, empty where none does."""
    start = F.regexp_instr(html, F.lit("(?i)<html\\b"))
    tag = F.when(start > 0, F.substring_index(F.substring(html, start, F.length(html)), ">", 1)).otherwise("")
    return F.lower(F.regexp_extract(tag, _DECLARED, 1))


def _text_evidence(pages: DataFrame, model: np.ndarray, options: Options) -> DataFrame:
    """The columns of `pages` with `html` replaced by `text_logs`, the tempered likelihood by language."""
    at = pages.columns.index("html")
    fields = [f for f in pages.schema.fields if f.name != "html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text_logs array<double>"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = []
            for html in batch.column(at).to_pylist():
                slots = _slots(page_text(html or ""))
                logs.append((model @ np.bincount(slots, minlength=SLOTS) * min(1.0, options.full_text / max(1, len(slots)))).tolist())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(logs, pa.list_(pa.float64()))],
                                             names=[f.name for f in fields] + ["text_logs"])

    return pages.mapInArrow(read, schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def _sums(n: int) -> Column:
    return F.array(*[F.sum(F.element_at("p", i + 1)) for i in range(n)])


def identify(pages: DataFrame, labelled: DataFrame, options: Options = Options()) -> DataFrame:
    """(page_id, lang, probability, declared, suffix, host), one row for every row of `pages`.

    A null or empty page has no text evidence, a null url an empty host; the other evidence then
    decides. Without labelled texts lang is null. Ties go to the language first in the alphabet.
    """
    languages, model = train(labelled, options)
    n = len(languages)
    where = host(F.col("url"))
    declared = _declared(F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", where.alias("host"), F.substring_index(where, ".", -1).alias("suffix"), declared.alias("declared"), "html")
    if not n:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), "declared", "suffix", "host")
    seen = stage(_text_evidence(rows, model, options).withColumn("p", _softmax(F.col("text_logs"))), "evidence")
    k, even = options.strength, F.array_repeat(F.lit(1.0 / n), n)
    blend = lambda own, size, prior: F.zip_with(own, prior, lambda x, q: (x + k * q) / (size + k))
    # A number for each language in all; then one row a suffix, a host, a declared language, each small against the pages.
    overall = seen.agg(_sums(n).alias("all"), F.count(F.lit(1)).alias("n")).first()
    every = F.array(*[F.lit(float(x or 0.0)) for x in overall["all"]])
    suffixes = seen.groupBy("suffix").agg(_sums(n).alias("sum"), F.count(F.lit(1)).alias("n"))
    suffixes = suffixes.select("suffix", blend(F.col("sum"), F.col("n"), blend(every, F.lit(overall["n"]), even)).alias("suffix_prior"))
    hosts = stage(seen.groupBy("host", "suffix").agg(_sums(n).alias("sum"), F.count(F.lit(1)).alias("n")).join(suffixes, "suffix").drop("suffix"), "hosts")
    said = seen.groupBy("declared").agg(_sums(n).alias("said")).withColumn("all", every)
    names = F.array(*map(F.lit, languages))
    trust = options.trust
    said = stage(said.select("declared", F.when(F.col("declared") == "", F.array_repeat(F.lit(0.0), n)).otherwise(F.transform(
        F.arrays_zip("said", "all", names.alias("names")),
        lambda x: F.log((x["said"] + F.when(x["names"] == F.col("declared"), trust).otherwise(trust / (2 * n))) / (x["all"] + 2 * trust)))).alias("said_logs")), "declared")
    joined = seen.join(hosts, "host").join(said, "declared")
    rest = F.zip_with("sum", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
    prior = blend(rest, F.col("n") - 1, F.col("suffix_prior"))
    logs = F.transform(F.arrays_zip("text_logs", "said_logs", prior.alias("prior")), lambda x: x["text_logs"] + x["said_logs"] + F.log(x["prior"]))
    fused = joined.withColumn("posterior", _softmax(logs))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return fused.select("page_id", F.element_at(names, best).alias("lang"), F.array_max("posterior").alias("probability"), "declared", "suffix", "host")
