"""Prefix trie of conversations: nodes as intervals of sorted prefixes, found by range minima.

A conversation's turns become chained digests (128 bits: each stands for all turns up to it), SEGMENT of them to a row
with what stands before it, so that no row grows with a conversation. Rows are sorted by Spark; equal prefixes
then lie side by side. Blocks of BLOCK rows take the common prefixes (LCP) of neighbours, the rows next to the block
included, and a sparse table of their minima. A candidate is a prefix of a row that its
left neighbour doesn't share. By the table each candidate finds its left and its right extent by binary search, on its own;
the extent is the interval of its members. Counts, the least member, leaves and shared bytes of an interval
are range minima and differences of running sums; a candidate's parent is the one at the left extent of the prefix shorter by one.

Intervals that reach a block's edge, and prefixes of conversations that go on in a later segment, are partial: their counts
are added up by digest. The conversations that end at a node are hashed in order of their ids; where they fill several
blocks, each block gives one joined piece, and the pieces are hashed in order, one after the other (SHA-256 allows no other way).

Null role or text is empty. Turns of one conversation that share a number go by role and text. Rows without conv_id belong to
no conversation. Repeated rows are turns of their own. Texts of any length count whole. An empty table gives an empty
result (no root). Other columns play no part. Remainders of negative ids go towards zero, as SQL's do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_hot, store

#: Turns of a row, and rows of a block.
SEGMENT, BLOCK = 64, 20_000
#: The rebuild: every FAMILY-th conversation lends under HEADS turns to the FAMILY - 1 after it.
FAMILY, HEADS = 5, 9

EMPTY = hashlib.sha256(b"").hexdigest()


# Turns ---------------------------------------------------------------------


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, size), stored: each turn's place in its conversation, two hashes of it, bytes of its text.

    Spark sorts by ranges, so a conversation of any length may span tasks; places are counted within each task, and
    of each task the first and last conversation, one row, tell how far the places of the next are off.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    hashed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role").alias("b"), F.octet_length("text").alias("size"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            new = np.r_[c[0] != last, c[1:] != c[:-1]]
            at = np.arange(len(c))
            begin = np.maximum.accumulate(np.where(new, at, 0))
            pos = at - begin + np.where(np.cumsum(new) == 0, n, 0)
            last, n = c[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos), pa.array(np.full(len(c), part, np.int32))], [*batch.schema.names, "pos", "part"])

    found = store(hashed.mapInArrow(count, "conv_id long, a long, b long, size int, pos long, part int"), "turns")
    ends = found.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last")).orderBy("part").collect()
    shifts, last, n = [], None, 0
    for e in ends:
        shift = n if e["first"] == last else 0
        if shift:
            shifts.append((e["part"], e["first"], shift))
        last, n = e["last"]["conv_id"], e["last"]["pos"] + 1 + (shift if e["last"]["conv_id"] == e["first"] else 0)
    if shifts:
        moved = F.broadcast(found.sparkSession.createDataFrame(shifts, "part int, conv_id long, shift long"))
        found = found.join(moved, ["part", "conv_id"], "left").withColumn("pos", F.col("pos") + F.coalesce("shift", F.lit(0)))
    return found.select("conv_id", "pos", "a", "b", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns (conv_id, pos, a, b, size) of rebuilt conversations, all conv_ids); turns as numbered() gives them.

    Conversation c is the first h turns of c - c % FAMILY, then its own after its first h; h = crc32(c in decimals) % HEADS.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    lender = F.col("conv_id") % FAMILY == 0
    ids = turns.where("pos = 0").select("conv_id")
    heads = turns.where(lender & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    borrowers = ids.where(~lender).select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h")).where("h > 0")
    lent = heads.join(borrowers, "base").where("pos < h").select("conv_id", "pos", "a", "b", "size")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n"))
    short = borrowers.join(lengths, "base", "left").select("conv_id", (F.coalesce("n", F.lit(0)) - F.col("h")).alias("shift")).where("shift < 0")
    short = store(short, "short-heads")
    own = turns.where(lender | (F.col("pos") >= h))
    own = own.join(F.broadcast(short), "conv_id", "left") if short.count() <= 20_000 else join_hot(own, short, "conv_id", "pos", "left")
    own = own.select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "a", "b", "size")
    return own.unionByName(lent), ids


# Sorted rows ---------------------------------------------------------------


def segments(turns: DataFrame, ids: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, turns array<struct<pos, a, b, size>>, base_a, base_b, open): `segment` turns to a row; base: the digest before them, open: whether more follow."""
    salted = turns.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("a"), F.xxhash64(F.lit(1), "b", "pos", "a").alias("b"), "size")
    marked = salted.unionByName(ids.select("conv_id", F.lit(None).cast("long").alias("pos")), allowMissingColumns=True)
    seg = F.coalesce(F.floor(F.col("pos") / segment), F.lit(0)).cast("long")
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "a", "b", "size"))
    rows = store(marked.groupBy("conv_id", seg.alias("seg")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.bit_xor("a").alias("all_a"), F.bit_xor("b").alias("all_b")), "segments")
    going_on = rows.where("seg = 1").select("conv_id")
    order = Window.partitionBy("conv_id").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    narrow = rows.select("conv_id", "seg", "all_a", "all_b").join(going_on, "conv_id", "left_semi")
    chain = narrow.select("conv_id", "seg", *(F.coalesce(F.bit_xor(f"all_{x}").over(before), F.lit(0)).alias(f"base_{x}") for x in "ab"), F.lead("seg").over(order).isNotNull().alias("open"))
    chain = broadcast_if_small(store(chain, "segment-chain"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return rows.join(chain, ["conv_id", "seg"], "left").select("conv_id", "seg", "turns", zero("base_a", 0), zero("base_b", 0), zero("open", False))


_ROW = "key binary, conv_id long, seg long, open boolean, sizes array<int>"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of segments() with a binary key: segment, base and the chained digests, 8 bytes each."""
    for batch in batches:
        turns = batch.column("turns")
        flat, n = turns.flatten(), turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        at = 3 + 2 * (np.arange(len(of)) - first[of])
        words = np.zeros(int((3 + 2 * n).sum()), np.int64)
        begin = np.cumsum(3 + 2 * n) - (3 + 2 * n)
        words[begin] = batch.column("seg").to_numpy()
        for k, x in enumerate("ab"):
            base = batch.column(f"base_{x}").to_numpy()
            words[begin + 1 + k] = base
            run = np.r_[0, np.bitwise_xor.accumulate(flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64))] if len(of) else np.zeros(1, np.int64)
            words[begin[of] + at + k] = run[1:] ^ run[first][of] ^ base[of]
        offsets = np.r_[begin, len(words)] * 8
        key = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(words)]).cast(pa.binary())
        sizes = pa.ListArray.from_arrays(pa.array(np.r_[first, n.sum()], pa.int32()), flat.field("size").cast(pa.int32()))
        yield pa.RecordBatch.from_arrays([key, *(batch.column(c) for c in ("conv_id", "seg", "open")), sizes], ["key", "conv_id", "seg", "open", "sizes"])


def sorted_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of segments() sorted by key, stored: block, idx (from 0 in the task) and the columns of _keyed()."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            idx = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(task << 32 | idx // block), pa.array(idx)], [*batch.schema.names, "block", "idx"])

    # of equal keys those that end come first, so that the last row tells whether any goes on
    order = ["key", "open", "conv_id"]
    return store(rows.mapInArrow(_keyed, _ROW).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{_ROW}, block long, idx long"), "sorted")


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """rows with the key before and after each block, at idx -1 and at 2^62."""
    edges = store(rows.groupBy("block").agg(F.min_by("key", "idx").alias("first"), F.max_by("key", "idx").alias("last")), "edges")
    # one narrow row per block: their order takes no more than their numbers
    ranks = edges.select("block", F.row_number().over(Window.orderBy("block")).alias("rank"))
    near = edges.join(ranks, "block").select("rank", "first", "last")
    halo = lambda key, by, idx: near.select((F.col("rank") + by).alias("rank"), F.col(key).alias("key"), F.lit(idx).cast("long").alias("idx")).join(ranks, "rank").drop("rank")
    return rows.unionByName(halo("last", 1, -1), allowMissingColumns=True).unionByName(halo("first", -1, 2**62), allowMissingColumns=True)


# Intervals -----------------------------------------------------------------


class Minima:
    """Sparse table: the least of every 2**k values in a row."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << len(self.rows) - 1 <= len(x):
            last, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of x[a] .. x[b]."""
        k = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << level) + 1])
        return out

    def upto(self, a: np.ndarray, d: np.ndarray, stop: int) -> np.ndarray:
        """The first place from a on, stop at most, whose value is under d: binary search by halving steps."""
        at = a.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            far = at + step <= stop
            far[far] = row[at[far]] >= d[far]
            at += far * step
        return at

    def back(self, a: np.ndarray, d: np.ndarray, stop: int) -> np.ndarray:
        """The first place from a downwards, stop at least, whose value is under d."""
        at = a.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            far = at - step >= stop
            far[far] = row[at[far] - step + 1] >= d[far]
            at -= far * step
        return at


def common_prefixes(words: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many digests each row shares with the row before it; -1 where segment or base differ. words: all keys in a row."""
    out = np.full(len(begin), -1, np.int64)
    if len(begin) < 2:
        return out
    a, b = begin[:-1], begin[1:]
    same = (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])
    out[1:][same] = 0
    # a digest stands for all before it, so equal ones come first
    most = np.minimum(n[:-1], n[1:])
    at = np.flatnonzero(same & (most > 0))
    d = 0
    while len(at):
        x, y = a[at] + 3 + 2 * d, b[at] + 3 + 2 * d
        at = at[(words[x] == words[y]) & (words[x + 1] == words[y + 1])]
        d += 1
        out[at + 1] = d
        at = at[most[at] > d]
    return out


_NODE = "depth long, a long, b long, parent_a long, parent_b long, n long, conv_id long, children long, leaves long, saved long, ends string, block long, whole boolean, parent_conv long, tail_conv long, tail_seg long"


def _intervals(block: int, rows: pa.RecordBatch, segment: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one block, whole or partial; then what rows of later segments add to the conversation's earlier ones (tail_conv, tail_seg)."""
    idx = rows.column("idx").to_numpy()
    raw = rows.column("key").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 8
    words = np.frombuffer(raw.buffers()[2], np.int64, int(offsets[-1]))
    begin, n = offsets[:-1], (np.diff(offsets) - 3) // 2
    lcp = common_prefixes(words, begin, n)
    low, high = int(idx[0] < 0), len(idx) - int(idx[-1] >= 2**62)
    size = high - low
    # lcp[i]: row i with the row before; one more for the row after the last
    lcp = np.r_[lcp[low:high], lcp[high] if high < len(idx) else -1]
    begin, n, own = begin[low:high], n[low:high], rows.slice(low, size)
    conv, open_ = own.column("conv_id").to_numpy(), own.column("open").to_numpy(zero_copy_only=False)
    seg = words[begin]
    sizes = np.r_[0, np.cumsum(own.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64))]
    start = np.cumsum(n) - n
    table, least = Minima(lcp), Minima(conv)
    # candidates: what the left neighbour doesn't share; of the first row everything
    shallow = (seg > 0).astype(np.int64)
    lowest = np.maximum(lcp[:-1] + 1, shallow)
    lowest[0] = shallow[0]
    count = np.maximum(n - lowest + 1, 0)
    row = np.repeat(np.arange(size), count)
    offset = np.cumsum(count) - count
    d = np.arange(len(row)) - offset[row] + lowest[row]
    left = table.back(row, d, 0)
    right = table.upto(row + 1, d, size) - 1
    made = d > lcp[row]
    whole = made & ~((right == size - 1) & (lcp[size] >= d))
    bytes_to = lambda r, k: sizes[start[r] + k] - sizes[start[r]]
    shared = bytes_to(np.arange(size), np.maximum(lcp[:-1], 0))
    total = np.r_[0, np.cumsum(shared)]
    above = bytes_to(row, np.maximum(d - 1, 0))
    saved = total[right + 1] - total[left + 1] - (right - left) * above + np.maximum(shared[left] - above, 0)
    leaf = ~open_ & (lcp[1:] < n)
    leaves = np.r_[0, np.cumsum(leaf)]
    opens = np.r_[0, np.cumsum(open_)]
    whole &= opens[right + 1] == opens[left]
    first = least.least(left, right)
    digest = lambda r, k, x: words[begin[r] + 1 + 2 * np.maximum(k, 0) + x]
    # parents: the candidate at the left extent of the prefix one shorter
    inner = np.flatnonzero(d > shallow[row])
    up = table.back(row[inner], d[inner] - 1, 0)
    parent = offset[up] + d[inner] - 1 - lowest[up]
    children = np.bincount(parent[made[inner]], minlength=len(row)).astype(np.int64)
    parent_conv = np.full(len(row), 0)
    known = np.zeros(len(row), bool)
    parent_conv[inner], known[inner] = first[parent], whole[parent]
    # conversations that end here: equal rows in a row
    begins = np.r_[True, ~((lcp[1:-1] == n[1:]) & (n[:-1] == n[1:]) & ~open_[1:] & ~open_[:-1])]
    heads = np.flatnonzero(begins)
    ends: list[str | None] = [None] * len(row)
    for a, b in pairwise([*heads.tolist(), size]):
        if not open_[a]:
            k = int(offset[a] + n[a] - lowest[a])
            ids = ",".join(map(str, conv[a:b].tolist()))
            ends[k] = hashlib.sha256(ids.encode()).hexdigest() if whole[k] else ids
    is_whole = whole.tolist()
    ends = [EMPTY if e is None and w else e for e, w in zip(ends, is_whole, strict=True)]
    depth = seg[row] * segment + d
    columns = [
        depth, digest(row, d, 0), digest(row, d, 1), pa.array(digest(row, d - 1, 0), mask=depth == 0), pa.array(digest(row, d - 1, 1), mask=depth == 0), right - left + 1, first,
        children, leaves[right + 1] - leaves[left], saved, pa.array(ends, pa.string()), np.full(len(row), block), whole, pa.array(parent_conv, mask=~known),
    ]
    arrays = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
    names = [x.split()[0] for x in _NODE.split(", ")]
    yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64())], names)
    # children of the segment before
    out = np.flatnonzero(made & (seg[row] > 0) & (d == 1))
    late = np.flatnonzero(seg > 0)
    m = len(out) + len(late)
    pad = lambda x, y: pa.array(np.r_[x, y].astype(np.int64))
    none, zero = np.zeros(len(late), bool), np.zeros(len(late), np.int64)
    values = {
        "depth": pad(depth[out] - 1, zero), "a": pad(digest(row[out], d[out] - 1, 0), zero), "b": pad(digest(row[out], d[out] - 1, 1), zero), "n": pad(np.zeros(len(out)), zero),
        "children": pad(np.ones(len(out)), zero), "leaves": pad(np.zeros(len(out)), leaf[late]), "saved": pad(np.zeros(len(out)), shared[late]), "whole": pa.array(np.zeros(m, bool)),
        "tail_conv": pa.array(np.r_[np.zeros(len(out), np.int64), conv[late]], mask=np.r_[np.ones(len(out), bool), none]),
        "tail_seg": pa.array(np.r_[np.zeros(len(out), np.int64), seg[late]], mask=np.r_[np.ones(len(out), bool), none]),
    }
    kinds = {"ends": pa.string()}
    yield pa.RecordBatch.from_arrays([values.get(c, pa.nulls(m, kinds.get(c, pa.int64()))) for c in names], names)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each block's rows in one batch."""
    held: list[pa.RecordBatch] = []
    block = None
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]):
            if a == b:
                continue
            if blocks[a] != block and held:
                yield block, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            block = int(blocks[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield block, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tails(nodes: DataFrame, rows: DataFrame, segment: int) -> DataFrame:
    """What the later segments of conversations add to the nodes of each earlier one: depth, a, b, leaves, saved."""
    tails = nodes.where("tail_conv is not null").select(F.col("tail_conv").alias("conv_id"), F.col("tail_seg").alias("seg"), "leaves", "saved")
    # a row for each segment that has one after it
    shifted = tails.withColumn("seg", F.col("seg") - 1)
    after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    sums = shifted.select("conv_id", "seg", F.sum("leaves").over(after).alias("leaves"), F.sum("saved").over(after).alias("saved"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                keys = [np.frombuffer(k.as_py(), np.int64) for k in small.column("key")]
                n = np.array([(len(k) - 3) // 2 for k in keys])
                seg = np.array([k[0] for k in keys])
                # with the root, which stands in the base of segment 0
                pairs = np.concatenate([k[1 if k[0] == 0 else 3 :].reshape(-1, 2) for k in keys]) if keys else np.zeros((0, 2), np.int64)
                n = n + (seg == 0)
                of = np.repeat(np.arange(len(n)), n)
                depth = np.arange(len(of)) - (np.cumsum(n) - n)[of] + seg[of] * segment + (seg[of] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(depth), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(small.column(c).take(pa.array(of)) for c in ("leaves", "saved"))], ["depth", "a", "b", "leaves", "saved"])

    held = rows.where("open").select("key", "conv_id", "seg").join(sums, ["conv_id", "seg"])
    return held.select("key", "leaves", "saved").mapInArrow(each, "depth long, a long, b long, leaves long, saved long")


def _merged(nodes: DataFrame, rows: DataFrame, segment: int) -> DataFrame:
    """Partial nodes put together, stored: depth, a, b, parents, n, conv_id, children, leaves, saved, ends."""
    keys = ["depth", "a", "b"]
    parts = nodes.where("not whole and tail_conv is null")
    added = parts.unionByName(_tails(nodes, rows, segment), allowMissingColumns=True)
    sums = added.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("parent_a", "parent_b")), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.min("conv_id").alias("conv_id"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *k, piece in zip(*(batch.column(c).to_pylist() for c in (*keys, "ends")), strict=True):
                if k != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(f",{piece}".encode())
            yield _digests(out)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    def _digests(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.string())], [*keys, "ends"])

    pieces = parts.where("ends is not null").select(*keys, "block", "ends").repartition(*keys).sortWithinPartitions(*keys, "block")
    ended = pieces.select(*keys, "ends").mapInArrow(digest, "depth long, a long, b long, ends string")
    return store(sums.join(ended, keys, "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))), "merged-nodes")


def trie(turns: DataFrame, ids: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns (conv_id, pos from 0 without gaps, a, b, size): two hashes of each turn and the bytes that count as saved. ids: every conversation, once.
    """

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _by_block(batches):
            yield from _intervals(number, held, segment)

    rows = sorted_rows(segments(turns, ids, segment), block)
    blocks = _with_neighbours(rows).repartition("block").sortWithinPartitions("block", "idx")
    nodes = store(blocks.mapInArrow(nodes_of, _NODE), "nodes")
    merged = _merged(nodes, rows, segment)
    columns = ["conv_id", "depth", "parent_conv", "n", "children", "leaves", "saved", "ends"]
    settled = nodes.where("whole")
    parents = merged.select(F.struct(F.col("depth") + 1, "a", "b").alias("up"), F.col("conv_id").alias("found"))
    lost = settled.where("parent_conv is null").drop("parent_conv").unionByName(merged, allowMissingColumns=True).withColumn("up", F.struct(F.col("depth"), F.col("parent_a"), F.col("parent_b")))
    # one parent may have most nodes for children
    joined = lost.join(F.broadcast(parents), "up", "left") if merged.count() <= 20_000 else join_hot(lost, parents, "up", "conv_id", "left", 64)
    out = settled.where("parent_conv is not null").select(*columns).unionByName(joined.withColumnRenamed("found", "parent_conv").select(*columns))
    return out.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
