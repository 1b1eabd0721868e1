"""Best-fit-decreasing packing of token documents into fixed-length rows.

Every task packs its own documents, group by group (so memory is bounded and no group is ever
gathered): over-long documents are split losslessly, the pieces are sorted by length, and each goes
into the row with the least room that still holds it. A segment tree over room sizes finds that row:
leaf r tells whether a row with r tokens of room is open. A result row is one packed row of the id
matrix with the cumulative lengths of its segments and positions that start again at each segment.

Null text is an empty document: its end id alone. Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_ID, coder, default_path

CAPACITY, GROUP_TOKENS, PAD_ID = 2048, 1 << 22, 0


class RoomTree:
    """The open rows by their room; finds the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        if room:
            self.rows[room].append(row)
            self._add(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of at least n."""
        at = n + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up until something larger lies to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Rows of piece numbers; pieces are at most capacity long."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room, row = tree.take(lengths[i]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        tree.put(room - lengths[i], row)
    return rows


_SCHEMA = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"


def best_fit_pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per packed sequence.

    ids and positions are little-endian unsigned 16-bit (the vocabulary has 49,408 entries), padded to
    capacity with PAD_ID and 0; cu_seqlens has 0 and the end of each segment; segment i holds the
    tokens of doc_ids[i] from starts[i] on. sequence_id is the task's number and a count.
    """
    path = tokenizer or default_path()

    def pack(group: list[tuple[int | None, np.ndarray]], base: int) -> pa.RecordBatch:
        pieces = [(key, start, ids[start : start + capacity]) for key, ids in group for start in range(0, len(ids), capacity)]
        out = []
        for number, row in enumerate(best_fit([len(p[2]) for p in pieces], capacity)):
            own = [pieces[i] for i in row]
            ends = np.cumsum([0, *(len(p[2]) for p in own)])
            ids, positions = np.full(capacity, PAD_ID, "<u2"), np.zeros(capacity, "<u2")
            ids[: ends[-1]] = np.concatenate([p[2] for p in own])
            positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
            out.append((base + number, int(ends[-1]), ids.tobytes(), ends.tolist(), positions.tobytes(), [p[0] for p in own], [p[1] for p in own]))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base, group, held = coder(path), TaskContext.get().partitionId() << 40, [], 0
        if own.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit into 16 bits")
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(own.ids(x.as_py() or ""), np.uint32(END_ID)).astype("<u2")
                group.append((k, ids))
                held += len(ids)
                if held >= GROUP_TOKENS:
                    yield (made := pack(group, base))
                    base, group, held = base + made.num_rows, [], 0
        if group:
            yield pack(group, base)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _SCHEMA)


def op6_best_fit_decreasing(spark, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
