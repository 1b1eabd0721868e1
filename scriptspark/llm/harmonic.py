"""Harmonic packing of token documents into fixed-length sequences.

A piece of n tokens is of class k = capacity // n, so its length lies in (capacity/(k+1), capacity/k] and k such
pieces fill a bin, whatever their lengths. Documents are cut first so that the classes waste little: whole
sequences, then, of what is left, the piece of the next class's full length, until the rest comes within
1/CLOSE of its own class's full length or is under FINEST (such a class wastes under 2 * FINEST of a bin).

Every task fills bins of its own, class by class, k pieces each; no piece moves between tasks, and a hot class is
spread over all of them. What a task has left of a class (under k pieces) meets the left pieces of other tasks, again k
to a bin. What is then left of a class (under k pieces in all, so a bounded number) goes first-fit-decreasing into common sequences.

Null text is an empty document: its end id alone. Texts of any length are read whole. Repeated rows are documents of
their own, and ties stand in the order of a task's rows. An empty table gives an empty result. Other columns play no
part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, store
from .tokens import END_ID, coder, default_path

CAPACITY, FINEST, CLOSE = 2048, 64, 128


def cuts(n: int, capacity: int = CAPACITY, finest: int = FINEST, close: int = CLOSE) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        full, k = capacity // (capacity // n), capacity // n
        size = n if n < finest or n * close >= full * (close - 1) else capacity // (k + 1)
        out.append(size)
        n -= size
    return out


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, part, k, rank, inside[, ids]).

    rank numbers the pieces of class k inside the task `part`, in the order of its rows; each k of them share a bin,
    where inside tokens stand before the piece.
    """
    kind = docs.schema[key].dataType.simpleString()
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "part", "k", "rank", "inside"]
    names = ["key", *numbers, *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = coder(tokenizer), TaskContext.get().partitionId()
        met, filled = [0] * (CAPACITY + 1), [0] * (CAPACITY + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                small = batch.slice(at, 1024)
                row, rows, blobs = [], [], []
                for i, x in enumerate(small.column(1)):
                    ids = np.append(own.ids(x.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    raw, start, n = ids.tobytes(), 0, len(ids)
                    for length in cuts(n):
                        blob, k = raw[4 * start : 4 * (start + length)], CAPACITY // length
                        if met[k] % k == 0:
                            filled[k] = 0
                        row.append(i)
                        rows.append((start, length, zlib.crc32(blob), n, part, k, met[k], filled[k]))
                        if with_ids:
                            blobs.append(np.frombuffer(blob, "<i4"))
                        met[k] += 1
                        filled[k] += length
                        start += length
                columns = [pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(numbers)
                ids = [pa.array([], pa.list_(pa.int32()))] * with_ids
                if blobs:
                    ids = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, blobs)], dtype=np.int32)), pa.array(np.concatenate(blobs)))]
                yield pa.RecordBatch.from_arrays([small.column(0).take(pa.array(row, pa.int64())), *columns, *ids], names)

    schema = ", ".join([f"key {kind}", *(f"{n} long" for n in numbers), *["ids array<int>"] * with_ids])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def fill_rest(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """First-fit-decreasing: (bin, offset) of each length. For a bounded number of pieces."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    used: list[int] = []
    open_from = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        while open_from < len(used) and used[open_from] == capacity:
            open_from += 1
        at = next((b for b in range(open_from, len(used)) if used[b] + lengths[i] <= capacity), len(used))
        if at == len(used):
            used.append(0)
        out[i] = (at, used[at])
        used[at] += lengths[i]
    return out


def harmonic_pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    Sequence ids run without gaps: the bins of tasks, class by class, then bins of pieces that tasks had left, then the common ones.
    """
    spark = docs.sparkSession
    cut = store(pieces(docs, key, text, tokenizer or default_path(), end_id, with_ids), "pieces")
    counts = store(cut.groupBy("part", "k").agg(F.count("*").alias("n")).withColumn("bins", F.expr("n div k")), "piece-counts")
    counts = counts.withColumn("left", F.col("n") % F.col("k"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
    offsets = store(counts.select("part", "k", "bins", before("bins"), before("left")), "piece-offsets")
    # one row a class: under a hundred, as most lengths under FINEST have a class of their own
    totals = counts.groupBy("k").agg(F.sum("bins").alias("bins"), F.sum("left").alias("left")).orderBy("k").collect()
    classes, at = [], 0
    for r in totals:
        classes.append((r["k"], at, at + r["bins"], r["left"] // r["k"]))
        at += r["bins"] + r["left"] // r["k"]
    kinds = spark.createDataFrame(classes, "k long, own_base long, left_base long, left_bins long")
    ranked = cut.join(broadcast_if_small(offsets), ["part", "k"]).join(F.broadcast(kinds), "k")
    own_bin, place = F.expr("rank div k"), F.col("left_before") + F.col("rank") - F.col("bins") * F.col("k")
    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    own = ranked.where(own_bin < F.col("bins")).withColumn("sequence_id", F.col("own_base") + F.col("bins_before") + own_bin)
    left = ranked.where(own_bin >= F.col("bins")).withColumn("place", place)
    shared = left.where("place < left_bins * k").withColumn("sequence_id", F.expr("left_base + place div k"))
    inside = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place")) - F.col("length")  # k pieces at most
    common = left.where("place >= left_bins * k")
    rest = common.select("k", "place", "length").orderBy("k", "place").collect()  # under k of each class: some 10,000 at most
    placed = [(r["k"], r["place"], at + b, offset) for r, (b, offset) in zip(rest, fill_rest([r["length"] for r in rest]), strict=True)]
    places = spark.createDataFrame(placed, "k long, place long, sequence_id long, offset long")
    parts = [own.withColumn("offset", F.col("inside")), shared.withColumn("offset", inside), common.join(F.broadcast(places), ["k", "place"])]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))


def op10_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return harmonic_pack(docs)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_pack(docs, with_ids=True)
