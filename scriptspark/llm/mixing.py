"""Mixing sources to target weights.

Each source is one long row of words: its documents in a pseudorandom order, cut into blocks of
BLOCK_WORDS. A source's target sets how many blocks it gives. The output is cut into shards of
SLOTS_PER_SHARD slots (the last may be shorter), and the number of slots of each source is drawn shard by
shard: a multinomial draw under the condition that every source meets its total (so a multivariate
hypergeometric one), taken along a binary tree over the shards, so that each task draws its own shards and
no table of all of them is made. Inside a shard a permutation spreads the sources over its slots. The
draws of a source run through a pseudorandom permutation of its block numbers (whole
passes first, then the start of one more), and slots and blocks meet in an equality join. The last draw
of a source takes only the words that its target still lacks, so totals meet targets to a word.

Sources up to SOURCES_HELD go to each task as one small array, after a count. Beyond that many, one permutation of all slots
gives every draw its place: the same law, without a table.

All draws follow from the seed and the source's rank: reruns agree. Ties: documents alike in key and size are alike to
the order. A null source is a source of its own, sorted last; null or wordless texts have size 0 and are never drawn; repeated
rows are documents of their own; long texts are drawn block by block. An empty table gives an empty mix. Other columns play no
part, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, chunk_of, fresh_name, running_total, store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
_WORD_AND_SPACE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
BLOCK_WORDS, SLOTS_PER_SHARD, SEED = 256, 4096, 42
#: A task draws 2**TASK_LEVEL shards. Sources held by every task, at most.
TASK_LEVEL, SOURCES_HELD = 3, 20_000


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) gets rank, weight and target.

    Shares go by weight; a source stops at MOST times its size and the excess is shared again by weight
    until none is above. With the sources in order of cap / weight, those that stop are a prefix: the
    first rate at which the rest stay below their caps is the one that holds for all of them.
    """
    named = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    named = named.withColumn("cap", MOST * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    lighter = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    named = named.withColumn("rate", (F.lit(SHARE) * F.sum("source_size").over(everything) - stopped) / lighter)
    named = named.withColumn("open", F.col("rate") * F.col("weight") < F.col("cap"))
    rate = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("rate")))).over(everything)["rate"]
    return named.withColumn("target", F.coalesce(F.least("cap", rate * F.col("weight")), F.col("cap"))).select("source", "source_size", "rank", "weight", "target")


def _permuted(index: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) sends each index (back: what it sends there).

    A four-round Feistel network over the next even power of two, walked until below n.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(zlib.crc32(f"{seed}:{r}".encode()) | 1 << 32) for r in range(4)]

    def mixed(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return x >> np.uint64(32) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in reversed(keys) if back else keys:
            left, right = (right ^ mixed(left, k), left) if back else (right, left ^ mixed(right, k))
        return left << half | right

    out = once(index.astype(np.uint64))
    while (beyond := out >= n).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _plan(rank: int, size: int, target: int) -> tuple[int, int, int, int]:
    """Blocks of a source, whole passes, slots of one more pass, words that the last slot takes (0: its whole block)."""
    n = -(-size // BLOCK_WORDS)
    passes, rest = divmod(target, size)
    if not rest:
        return n, passes, 0, 0
    lacking = n * BLOCK_WORDS - size
    short_at = int(_permuted(np.array([n - 1]), n, _seed(rank, passes), back=True)[0])
    more = -(-rest // BLOCK_WORDS)
    if more > short_at:  # the short block is among them
        more = max(short_at + 1, -(-(rest + lacking) // BLOCK_WORDS))
    over = more * BLOCK_WORDS - lacking * (more > short_at) - rest
    return n, passes, more, BLOCK_WORDS - lacking * (more - 1 == short_at) - over


def _seed(rank: int, passes: int) -> int:
    return zlib.crc32(f"{SEED}:{rank}:{passes}".encode())


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss of digits where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return more
        total, j = more, j + 1


def _stirling_rest(n: int) -> float:
    """What Stirling's formula lacks of log n!."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log of the chance of x in n, by the saddle point: digits don't suffer where n is large."""
    if not n:
        return 0.0
    if x == 0 or x == n:
        return n * (math.log(q) if p > 0.1 else math.log1p(-p)) if x == 0 else n * (math.log(p) if q > 0.1 else math.log1p(-q))
    rests = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x)
    return rests - _deviance(x, n * p) - _deviance(n - x, n * q) - 0.5 * (math.log(2 * math.pi * x) + math.log1p(-x / n))


def _hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of `take` drawn from good + bad are good: one draw of that law, by ratio of uniforms, for numbers of any size."""
    total = good + bad
    low, high = max(0, take - bad), min(take, good)
    if low == high:
        return low
    p, q = take / total, (total - take) / total

    def log_chance(x: int) -> float:
        return _log_binomial(x, good, p, q) + _log_binomial(take - x, bad, p, q)

    mean = take * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - take) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = log_chance(min(high, max(low, (take + 1) * (good + 1) // (total + 2))))
    while True:
        u = 1 - rng.random()
        x = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_chance(x) - top:
            return x


def _taken_of(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `take` slots, drawn from counts[i] slots of each source i, fall to each: multivariate hypergeometric."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i in np.flatnonzero(counts).tolist():
        n = int(counts[i])
        if not take:
            break
        out[i] = _hypergeometric(n, rest - n, take, rng)
        rest, take = rest - n, take - int(out[i])
    return out


def shard_counts(counts: np.ndarray, shard: int, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first, n) of an output shard: slots of each source in the shards before it and in itself.

    From the root down, a node's slots are dealt to its halves; each draw has its node's own seed, so all tasks
    see the same tree.
    """
    top = (-(-int(counts.sum()) // per_shard) - 1).bit_length()
    first, own, at = np.zeros_like(counts), counts, 0
    for depth in range(top, 0, -1):
        left = _taken_of(own, min(per_shard << depth - 1, int(own.sum())), np.random.default_rng([seed, depth, at]))
        at *= 2
        if shard >> depth - 1 & 1:
            first, own, at = first + left, own - left, at + 1
        else:
            own = left
    return first, own


_SLOTS = "rank long, block long, pass long, shard long, slot long, words long"


def _drawn(rank: int, plan: tuple[int, int, int], draw: np.ndarray, shard: np.ndarray, slot: np.ndarray) -> pd.DataFrame:
    """The draws of a source as slots: which block each takes, words: how many of it."""
    blocks, slots, cut = plan
    at, number, block = draw % blocks, draw // blocks, np.empty_like(draw)
    for p in np.unique(number).tolist():
        block[number == p] = _permuted(at[number == p], blocks, _seed(rank, p))
    words = np.where((draw == slots - 1) & (cut > 0), cut, BLOCK_WORDS)
    return pd.DataFrame({"rank": rank, "block": block, "pass": number, "shard": shard, "slot": slot, "words": words})


def slots(goals: DataFrame, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """(rank, block, pass, shard, slot, words): which block fills each slot, and how many words of it."""
    spark = goals.sparkSession

    def plans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(r.rank, *_plan(r.rank, r.source_size, round(r.target))) for r in frame.itertuples() if r.source_size]
            yield pd.DataFrame([(rank, blocks, passes * blocks + more, cut) for rank, blocks, passes, more, cut in made], columns=["rank", "blocks", "slots", "cut"])

    planned = store(goals.select("rank", "source_size", "target").mapInPandas(plans, "rank long, blocks long, slots long, cut long"), "plans")
    if planned.count() > SOURCES_HELD:
        return _slots_by_permutation(planned, per_shard)
    held = [tuple(r) for r in planned.orderBy("rank").collect()]
    counts = np.array([r[2] for r in held], np.int64)
    n_shards = -(-int(counts.sum()) // per_shard)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"].tolist():
                for shard in range(number << TASK_LEVEL, min(n_shards, number + 1 << TASK_LEVEL)):
                    first, n = shard_counts(counts, shard, per_shard, seed)
                    spots = _permuted(np.arange(int(n.sum())), int(n.sum()), _seed(shard, -1))
                    for i in np.flatnonzero(n).tolist():
                        begin = int(n[:i].sum())
                        draw = np.arange(first[i], first[i] + n[i])
                        yield _drawn(held[i][0], held[i][1:], draw, np.full(len(draw), shard), spots[begin : begin + len(draw)])

    groups = -(-n_shards >> TASK_LEVEL)
    return spark.range(0, groups, 1, max(1, min(groups, 4096))).mapInPandas(run, _SLOTS)


def _slots_by_permutation(planned: DataFrame, per_shard: int) -> DataFrame:
    """slots() for any number of sources: all draws, source after source, go through one permutation of all slots."""
    chunk = per_shard << TASK_LEVEL
    total = planned.agg(F.sum("slots")).first()[0]
    begun = running_total(planned, [], "slots", ["rank"], chunk_of(planned.count()), "begin")
    parts = begun.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {chunk}"))).alias("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                draw = np.arange(r.part * chunk, min(r.slots, (r.part + 1) * chunk))
                spot = _permuted(r.begin + draw, total, _seed(0, -2))
                yield _drawn(r.rank, (r.blocks, r.slots, r.cut), draw, spot // per_shard, spot % per_shard)

    return parts.repartition(F.col("rank"), F.col("part")).mapInPandas(run, _SLOTS)


def place(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with size, rank, target and their start in their source; sources), both stored."""
    sized = store(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    goals = store(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    named = broadcast_if_small(goals.withColumnRenamed("source", "named"))
    ranked = store(sized.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named"), "ranked")
    chunks = chunk_of(ranked.count())
    return store(running_total(ranked, ["rank"], "size", ["key", "size"], chunks, "start"), "placed"), goals


def draws(placed: DataFrame, goals: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, rank, start, size, pass, shard, slot, first, last): the words first..last-1 of a document that a slot takes."""
    words = F.lit(BLOCK_WORDS)
    blocks = F.sequence(F.expr(f"start div {BLOCK_WORDS}"), F.expr(f"(start + size - 1) div {BLOCK_WORDS}"))
    spread = placed.where("size > 0").select("key", "rank", "start", "size", F.explode(blocks).alias("block"))
    # slots grow with the words, and Spark can't tell the size of what a Python function returns: never broadcast them
    met = spread.join(slots(goals, seed=seed).hint("merge"), ["rank", "block"])
    begin = F.col("block") * words
    first = F.greatest(F.col("start"), begin) - F.col("start")
    last = F.least(F.col("start") + F.col("size"), begin + F.col("words")) - F.col("start")
    return met.select("key", "rank", "start", "size", "pass", "shard", "slot", first.alias("first"), last.alias("last")).where("last > first")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, and shard and slot where its first words stand (null: none)."""
    placed, goals = place(docs, key, source, text)
    # the place where a document starts tells it apart, even where keys are null or repeated
    on = ["rank", "start"]
    took = draws(placed, goals, seed).groupBy(*on).agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min(F.col("shard") * SLOTS_PER_SHARD + F.col("slot")).alias("spot"))
    # a wordless document has no place of its own in the row of words, so it takes no part in the join
    none = F.lit(None).cast("long")
    full = placed.where("size > 0").join(took, on, "left").unionByName(placed.where("size = 0").withColumns({"taken": none, "spot": none}))
    shard, slot = F.expr(f"spot div {SLOTS_PER_SHARD}"), F.expr(f"spot % {SLOTS_PER_SHARD}")
    return full.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), shard.alias("shard"), slot.alias("slot"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents, a shard's together and in the order of its slots: for each pass, the words of a document that it takes, as one row.

    A document stands where its first words of the pass stand. One that a pass takes whole keeps its text as it is; otherwise its
    pieces, white space included, are joined, with a line feed where words between them were left out. Wordless documents have nothing to give.
    """
    row, taken, spot = (fresh_name(docs, n) for n in ("row", "taken", "spot"))
    keyed = docs.withColumn(row, F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64(*docs.columns).alias("h")))
    placed, goals = place(keyed, row)
    piece = F.struct("first", "last")
    took = draws(placed, goals).groupBy("key", "rank", "start", "size", "pass").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum(F.col("last") - F.col("first")).alias("n"), F.min(F.col("shard") * SLOTS_PER_SHARD + F.col("slot")).alias("at")
    )
    own = took.select(F.col("key").alias(row), F.struct("size", "n", "pieces").alias(taken), F.col("at").alias(spot))
    # rows alike in all columns share a key: the text is the same
    repeated = store(keyed.groupBy(row).agg(F.count("*").alias("n")).where("n > 1").select(row), "repeated-rows")
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        keyed = keyed.join(repeated, row, "left_anti").unionByName(keyed.join(repeated, row, "left_semi").dropDuplicates([row]))
    return _cut(keyed.join(own, row).repartition(F.expr(f"`{spot}` div {SLOTS_PER_SHARD}")).sortWithinPartitions(spot), docs, taken)


def _cut(mixed: DataFrame, docs: DataFrame, taken: str) -> DataFrame:
    """The columns of docs, text cut to the pieces taken."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                small, texts = batch.slice(at, 512), []
                for text, took in zip(small.column("text"), small.column(taken), strict=True):
                    text, took = text.as_py(), took.as_py()
                    if took["n"] < took["size"]:
                        words = _WORD_AND_SPACE.findall(text)
                        runs: list[list[int]] = []
                        for p in took["pieces"]:
                            if runs and runs[-1][1] == p["first"]:
                                runs[-1][1] = p["last"]
                            else:
                                runs.append([p["first"], p["last"]])
                        text = "\n".join("".join(words[a:b]).rstrip(SPACES) for a, b in runs)
                    texts.append(text)
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, small.column(c)) for c in names], names)

    return mixed.select(*names, taken).mapInArrow(run, docs.schema)
