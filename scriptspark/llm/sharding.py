"""Balanced label propagation: shards of even size that keep linked documents together.

Documents start spread evenly by a running total of their sizes over a pseudorandom order. In each
round the linked documents look at their neighbours' shards (a join and a grouped count) and ask to
move to the commonest one. Quotas admit what the opposite flow makes room for, plus what the target
may still take under its capacity; within a quota the order is pseudorandom. At the end documents without links
(linked ones only when there are no others), small ones first, are moved from shards above the mean
to shards below it, so that sizes end within a small document of even.

Only shard sums and flows between shards (shards squared) reach the driver. Null text counts as
empty; repeated rows are documents of their own and linked like any equal texts. Ties (equal counts of neighbours'
shards, equal sizes) are settled by hashes of row numbers. Texts of any length are measured whole. An empty table gives an
empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_of, join_hot, running_total, store

SHARDS, ROUNDS, SLACK = 16, 8, 0.2
#: The last moves go on, this often at most, until shards differ by this share of their mean.
EVEN_ROUNDS, EVEN_SHARE = 4, 0.002
#: Size classes (powers of two) by which the last moves are ordered.
CLASSES = 40


def equal_text_links(nodes: DataFrame, group: str = "digest") -> DataFrame:
    """(a, b): a star per group of equal texts, from the smallest id to each other one."""
    hubs = nodes.groupBy(group).agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select(group, "hub")
    return join_hot(nodes, hubs, group, "id").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _sums(labels: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["size"] for r in labels.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def start_even(nodes: DataFrame, shards: int, chunks: int) -> DataFrame:
    """nodes with `shard`: equal shares of the running total of sizes."""
    total = nodes.agg(F.sum("size")).first()[0] or 1
    placed = running_total(nodes, [], "size", ["id"], chunks, "start")
    middle = F.col("start") + F.expr("size div 2")
    return placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int")).drop("start")


def _quotas(flows: dict[tuple[int, int], int], sums: list[int], capacity: float) -> list[tuple[int, int, int]]:
    """(shard, wish, quota): the opposite flow is matched; beyond it, the target's room is shared in proportion."""
    matched = {(i, j): min(n, flows.get((j, i), 0)) for (i, j), n in flows.items()}
    more = [0] * len(sums)
    for (_, j), n in ((k, flows[k] - m) for k, m in matched.items()):
        more[j] += n
    share = [min(1.0, max(0.0, capacity - s) / m) if m else 0.0 for s, m in zip(sums, more, strict=True)]
    return [(i, j, int(matched[i, j] + share[j] * (n - matched[i, j]))) for (i, j), n in flows.items()]


def propagate(labels: DataFrame, links: DataFrame, others: list[int], shards: int, rounds: int = ROUNDS) -> DataFrame:
    """labels (id, size, shard) of the linked nodes after the rounds. others: sizes of what isn't linked, by shard."""
    spark = labels.sparkSession
    both = store(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    chunks = chunk_of(labels.count())
    for turn in range(rounds):
        sums = [a + b for a, b in zip(others, _sums(labels, shards), strict=True)]
        capacity = sum(sums) / shards * (1 + SLACK)
        # half of the nodes at a time, so that two neighbours don't swap shards for ever
        active = both.where(F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0)
        seen = active.join(labels.select(F.col("id").alias("b"), F.col("shard").alias("wish")), "b").groupBy("a", "wish").agg(F.count("*").alias("n"))
        mine = seen.join(labels.withColumnRenamed("id", "a"), "a").groupBy("a", "size", "shard")
        best = mine.agg(F.max(F.struct("n", F.xxhash64("a", "wish"), "wish")).alias("best"), F.max(F.when(F.col("wish") == F.col("shard"), F.col("n"))).alias("own"))
        movers = best.where(F.col("best.n") > F.coalesce("own", F.lit(0))).select(F.col("a").alias("id"), "size", "shard", F.col("best.wish").alias("wish"))
        movers = store(movers, "movers")
        flows = {(r["shard"], r["wish"]): r["size"] for r in movers.groupBy("shard", "wish").agg(F.sum("size").alias("size")).collect()}
        if not flows:
            break
        quotas = spark.createDataFrame(_quotas(flows, sums, capacity), "shard int, wish int, quota long")
        queued = running_total(movers, ["shard", "wish"], "size", ["id"], chunks, "before")
        moved = queued.join(F.broadcast(quotas), ["shard", "wish"]).where("before + size <= quota").select("id", "wish")
        labels = store(labels.join(moved, "id", "left").select("id", "size", F.coalesce("wish", "shard").alias("shard")), "labels")
    return labels


def even_out(labels: DataFrame, shards: int, chunks: int) -> DataFrame:
    """labels (id, size, shard, linked) with the surplus of large shards dealt to small ones."""
    spark = labels.sparkSession
    sums = _sums(labels, shards)
    mean = sum(sums) / shards
    surplus = [(i, max(0.0, s - mean)) for i, s in enumerate(sums)]
    per_class = max(1, chunks // 4)
    size_class = F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.col("size").cast("double")))).cast("int")
    spread = F.pmod(F.xxhash64("id", F.lit("spread")), F.lit(per_class))
    order = (F.col("linked").cast("int") * CLASSES + size_class) * per_class + spread
    above = labels.join(F.broadcast(spark.createDataFrame(surplus, "shard int, surplus double")), "shard").where("surplus > 0")
    queued = running_total(above, ["shard"], "size", ["id"], chunks, "before", order)
    pool = store(queued.where("before + size / 2 <= surplus").select("id", "size"), "surplus")
    gaps, at = [], 0.0
    for i, s in enumerate(sums):
        if s < mean:
            gaps.append((i, at, at + mean - s))
            at += mean - s
    if not gaps:
        return labels
    freed = pool.agg(F.sum("size")).first()[0] or 0
    scale = at / freed if freed else 1.0
    placed = running_total(pool, [], "size", ["id"], chunks, "before").withColumn("spot", (F.col("before") + F.col("size") / 2) * F.lit(scale))
    # as many gaps as shards at most: a chain of comparisons
    target = F.lit(gaps[-1][0])
    for i, _, stop in reversed(gaps[:-1]):
        target = F.when(F.col("spot") < stop, F.lit(i)).otherwise(target)
    moved = placed.select("id", target.cast("int").alias("moved"))
    return labels.join(moved, "id", "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for each document; slots of a shard run from 0 without gaps."""
    whole = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(F.col(key).alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.md5(whole.cast("binary"))).alias("digest"))
    nodes = store(facts.withColumn("id", F.monotonically_increasing_id()), "nodes")
    chunks = chunk_of(nodes.count())
    links = store(equal_text_links(nodes), "text-links")
    linked = store(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().withColumn("linked", F.lit(True)), "linked")
    first = start_even(nodes.select("id", "size"), shards, chunks).join(linked, "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    first = store(first, "first-labels")
    alone = first.where("not linked")
    together = propagate(store(first.where("linked").select("id", "size", "shard"), "labels"), links, _sums(alone, shards), shards)
    labels = store(alone.unionByName(together.withColumn("linked", F.lit(True))), "propagated")
    for _ in range(EVEN_ROUNDS):
        sums = _sums(labels, shards)
        if max(sums) - min(sums) <= EVEN_SHARE * sum(sums) / shards:
            break
        labels = store(even_out(labels, shards, chunks), "even")
    placed = store(nodes.drop("digest").join(labels.select("id", "shard"), "id").withColumn("one", F.lit(1).cast("long")), "placed")
    return running_total(placed, ["shard"], "one", ["id"], chunks, "slot").select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def op4_label_propagation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard_documents(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
