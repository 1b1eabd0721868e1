"""Quality rules at host level.

Base counts come from a whole text. Soft rules (symbols, repeated lines, word length) are counted by
host; each host's failure rate is shrunk towards the corpus by an empirical beta prior, and the host
verdict is joined back to its documents: in a strict host a document that fails a soft rule is
rejected, in a lenient host it passes. Documents that fail the base rules are always rejected, and a
document that fails no rule is always kept, whatever its host.

Null text counts as empty; a null host is a host of its own. Repeated rows and ties are judged one by one, each alike.
Texts of any length are read whole. An empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, fresh_name, own_keys, store

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A host is strict if its shrunk rate of soft failures is at least this.
STRICT_RATE = 0.05
#: Soft rules: symbols per word, share of repeated lines (of two and more), characters per word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 0.1, 0.3, (2.0, 15.0)

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in an 8-word window that the text has at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    order = np.argsort(acc, kind="stable")
    same = acc[order[1:]] == acc[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    at = np.flatnonzero(same)
    for i, j in zip(order[at].tolist(), order[at + 1].tolist(), strict=True):
        if words[i : i + WINDOW] != words[j : j + WINDOW]:  # two windows with one hash: count them by their words
            seen: dict[tuple, list[int]] = {}
            for k in range(n):
                seen.setdefault(tuple(words[k : k + WINDOW]), []).append(k)
            hit[:] = False
            for places in seen.values():
                hit[places] = len(places) > 1
            break
        hit[i] = hit[j] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[WINDOW : WINDOW + n] -= hit
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the counts of COUNTS."""
    keep = [f for f in docs.schema.fields if f.name != text]
    whole = fresh_name(docs, "whole")
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_text(x.as_py() or "") for x in batch.column(whole)]
            columns = [np.array(x, np.int64) for x in zip(*counts, strict=True)] or [np.zeros(0, np.int64)] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *map(pa.array, columns)], [*(f.name for f in keep), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), COUNTS])
    return docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text}`").alias(whole)).mapInArrow(run, schema)


def rule_columns(counts: DataFrame) -> DataFrame:
    """Adds base_failed and soft_failed."""
    n = F.col("n_words")
    return counts.withColumns({
        "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "soft_failed": (F.col("n_symbols") > MAX_SYMBOLS * n) | ((F.col("n_dup_lines") > 1) & (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))) | (F.col("word_chars") < WORD_LENGTH[0] * n) | (F.col("word_chars") > WORD_LENGTH[1] * n),
    })


def host_verdicts(judged: DataFrame, host: str = "host") -> DataFrame:
    """(host, n_docs, n_failed, rate, strict): the failure rate of each host under a beta prior.

    The prior's mean is the corpus rate m and its strength comes from the spread of the host rates by
    the method of moments: with within-host variance taken off, a+b = m(1-m)/v - 1. Without any spread
    every host gets the corpus rate.
    """
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = store(judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed")), "hosts")
    n, x, m2, k = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")), F.count("*")).first()
    mean = x / n if n else 0.0
    spread = (m2 / n - mean * mean if n else 0.0) - (k / n if n else 0.0) * mean * (1 - mean)
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("strict", F.col("rate") >= STRICT_RATE)


def judge(docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, host, counts, base_failed, soft_failed, host_rate, kept."""
    narrow = docs.select(F.col(key), F.col(host).alias("host"), F.col(text).alias("text"))
    judged = store(rule_columns(base_counts(narrow)), "judged")
    verdicts = broadcast_if_small(host_verdicts(judged).select(F.col("host").alias("named"), F.col("rate").alias("host_rate"), "strict"))
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("named")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("soft_failed") & F.col("strict"))).drop("named", "strict")


def op8_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that op8 keeps. Verdicts are joined back by the document's own key and host, so repeated ids are safe."""
    row = fresh_name(docs, "row")
    keyed, _, _ = own_keys(docs, "doc_id", "text", row)
    bad = judge(keyed, key=row).where("not kept").select(F.col(row).alias("bad"), F.col("host").alias("bad_host")).distinct()
    same = (keyed[row] == bad["bad"]) & keyed["source"].eqNullSafe(bad["bad_host"])
    return keyed.join(bad, same, "left_anti").select(*docs.columns)
