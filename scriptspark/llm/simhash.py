"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, so that fingerprints that differ in at most two bits have
a half that differs in at most one. Each half is indexed under its 32 variants with one bit taken out;
equal variants are joined and the whole fingerprints verified. Links run between distinct
fingerprints only: documents with one fingerprint are one node, however many there are.

Null or wordless text has fingerprint zero and is linked like any other. Ties and repeated rows share a fingerprint
and so a group; a group is named by its smallest key (null keys count only where a group has no other). Texts of any
length are read whole. An empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, fresh_name, one_row_each, own_keys, store
from .passages import BANDS, band_keys, near_copies
from .wordhash import grouped, lists, signed, words_of

SHINGLE, SEED, BITS, MAX_BITS = 3, 42, 64, 2
_BLOCK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if more than half of the shingles' XXH64 have it. No words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    votes, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py() or "", shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def with_signature(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, h, words, bands): fingerprint, hash of the words, their number and MinHash bands, from one reading of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in grouped(batch.column(1)):
                w = words_of(texts)
                at, size = w.first[:-1], np.diff(w.first)
                full = np.flatnonzero(size)
                fp = np.array([fingerprint(x.decode()) for x in texts], np.uint64)
                bands = lists(np.cumsum(np.r_[0, (size > 0) * BANDS]), signed(band_keys(w, at[full], size[full]).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), signed(fp), signed(w.runs(at, size)), pa.array(size.astype(np.int32)), bands], ["key", "fp", "h", "words", "bands"])

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, "key long, fp long, h long, words int, bands array<long>")


def variants(fps: DataFrame) -> DataFrame:
    """(fp, variant): 64 rows per fingerprint; the place of the bit taken out and the 31 bits that stay."""
    half = "(case when p < 32 then fp & 4294967295 else shiftrightunsigned(fp, 32) end)"
    spot = "cast(p % 32 as int)"
    rest = f"(({half} & (shiftleft(1L, {spot}) - 1L)) | shiftleft(shiftrightunsigned({half}, {spot} + 1), {spot}))"
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select("fp", F.expr(f"shiftleft(cast(p as bigint), 32) | {rest}").alias("variant"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that differ in at most two bits, each once."""
    index = variants(fps)
    other = index.withColumnRenamed("fp", "b").withColumnRenamed("variant", "other")
    near = (F.col("variant") == F.col("other")) & (F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    # Spark takes the variants to be no larger than the fingerprints before the explode, and would broadcast 64 rows of each
    return index.join(other.hint("merge"), near).select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(marked: DataFrame, key: str) -> DataFrame:
    """(key, fp, component) of the stored marked (key, fp): component is the smallest key that it can reach, itself included."""
    nodes = store(marked.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    found = store(components(links(nodes.select("fp")), "a", "b", "fp-components"), "fp-components")
    # a row a fingerprint or document: Spark would broadcast them by the size of their files
    roots = nodes.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = roots.join(lowest.hint("merge"), "root").select("fp", "component")
    return marked.join(by_fp.hint("merge"), "fp")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(store(with_fingerprint(docs), "fingerprints"), "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id (of rows alike in id and text, one).

    Fingerprints at two bits link texts that differ in a word or so; copies with similarity 0.8 over
    five-word shingles differ in six and more, beyond what an index of one-bit variants reaches. So the
    documents that stay are held against each other once more by banded MinHash and exact Jaccard.
    """
    row = fresh_name(docs, "row")
    keyed, odd, _ = own_keys(docs, "doc_id", "text", row)
    signed_ = store(with_signature(keyed, row, "text"), "signatures")
    firsts = store(near_duplicates(signed_.select("key", "fp"), "key").where("key = component").select("key").distinct(), "firsts")
    units = store(signed_.where("words > 0").select("key", "h", "words", "bands").join(broadcast_if_small(firsts, merge=True), "key", "left_semi"), "first-texts")
    again = near_copies(units, keyed, row, "text")
    kept = store(firsts.join(again, "key", "left_anti").withColumnRenamed("key", row), "kept")
    return one_row_each(keyed.join(broadcast_if_small(kept, merge=True), row, "left_semi"), row, odd).select(*docs.columns)
