"""Sequential scans of ordered rows in chunks, so that a key of any length is spread over tasks.

Spark sorts rows by key and order into ranges; a range holds a chunk of each key that it meets. Chunks
that begin a key are scanned at once. Of the first chunk in a range, whose key may have begun
before, the scan's whole map is taken: which state each entry state would leave it in. The maps, one
for each range at most, are composed in order; then the chunks with an entry are scanned from it.

numbered_scan() does the same for wide rows with numbers to cut them by: maps come from narrow columns first, so that wide
rows are read once, batch by batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptspark.storage import store


class Automaton(Protocol):
    """A step from row to row with a state; an entry of None begins a key. columns: what it reads."""

    columns: list[str]

    def run(self, columns: list[np.ndarray], begins: np.ndarray, entry: Any) -> tuple[np.ndarray, Any]:
        """(a value for each row, the state after the last): begins has the first rows of keys, the first of all included."""

    def summary(self, columns: list[np.ndarray]) -> Any:
        """The map of one key's rows from entry state to exit state."""

    def through(self, summary: Any, entry: Any) -> Any:
        """The exit state of a map."""


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of keys; nulls are a key as well."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _batches(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from table.select(names).to_batches(max_chunksize=65_536)


def chunked_scan(rows: DataFrame, keys: list[str], order: list[str], out: T.StructField, automaton: Automaton) -> DataFrame:
    """rows with the column `out`: the automaton's value in the order of `order` within each of keys.

    A range of rows, as Spark sizes its partitions, is held in memory.
    """
    names = rows.columns
    numbers = lambda table: [table.column(c).to_numpy() for c in automaton.columns]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        begins, columns, n = _begins(table, keys), numbers(table), table.num_rows
        values, leaves = automaton.run(columns, begins, None)
        end = int(begins[1]) if len(begins) > 1 else n
        map_ = pickle.dumps(automaton.summary([c[:end] for c in columns]))
        at = np.arange(n)
        made = {
            out.name: pa.array(values), "__part": pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), "__row": pa.array(at), "__first": pa.array(at < end),
            "__map": pa.array([map_] + [None] * (n - 1), pa.binary()), "__exit": pa.array([pickle.dumps(leaves)] + [None] * (n - 1), pa.binary()),
        }
        for c, x in made.items():
            table = table.append_column(c, x)
        yield from _batches(table, [*names, *made])

    ddl = T.StructType([*rows.schema.fields, out, *T.StructType.fromDDL("__part int, __row long, __first boolean, __map binary, __exit binary").fields])
    done = store(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(scan, ddl), "scan")
    of = F.struct(*keys)
    ranges = done.groupBy("__part").agg(F.min(of).alias("low"), F.max(of).alias("high"), F.first("__map", True).alias("map"), F.first("__exit", True).alias("exit")).orderBy("__part").collect()
    entries: dict[int, Any] = {}
    last, state = None, None
    for r in ranges:
        leaves = pickle.loads(r["exit"])
        if last is not None and r["low"] == last:
            entries[r["__part"]] = state
            if r["high"] == r["low"]:
                leaves = automaton.through(pickle.loads(r["map"]), state)
        last, state = r["high"], leaves
    if not entries:
        return done.select(*names, out.name)
    goes_on = F.col("__first") & F.col("__part").isin(list(entries))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        parts = table.column("__part").to_numpy()
        for a, b in zip(starts := [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist()], [*starts[1:], len(parts)], strict=True):
            own = table.slice(a, b - a)
            values, _ = automaton.run(numbers(own), np.array([0]), entries[int(parts[a])])
            yield from _batches(own.append_column(out.name, pa.array(values)), [*names, out.name])

    redone = done.where(goes_on).select(*names, "__part", "__row").repartition("__part").sortWithinPartitions("__part", "__row")
    return done.where(~goes_on).select(*names, out.name).unionByName(redone.mapInArrow(again, T.StructType([*rows.schema.fields, out])))


#: Rows of a key that numbered_scan() puts in one chunk.
CHUNK_ROWS = 32_768


def numbered_scan(rows: DataFrame, keys: list[str], number: str, out: T.StructField, automaton: Automaton) -> DataFrame:
    """rows with the column `out`, as chunked_scan() gives it, for a stored table whose column `number` counts the rows of a key, from about 0.

    A chunk is CHUNK_ROWS numbers of a key. Keys of one chunk need no map. Of longer keys, at most one in CHUNK_ROWS rows, the automaton's
    columns give each chunk's map; the driver composes one for each chunk. Rows then pass through a task in batches, of which it holds one.
    """
    names, part = rows.columns, "__chunk"
    cut = rows.withColumn(part, F.floor(F.col(number) / CHUNK_ROWS).cast("long"))
    long_ = cut.where(F.col(part) > 0).select(F.struct(*keys).alias("__key")).distinct()
    entries = _entries(cut, long_, keys, part, number, automaton) if not long_.isEmpty() else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            columns, begins = [table.column(c).to_numpy() for c in automaton.columns], _begins(table, [*keys, part])
            firsts = list(zip(*(table.column(c).take(pa.array(begins)).to_pylist() for c in [*keys, part]), strict=True))
            goes_on = firsts[0] == last
            # one run from each chunk that goes on; keys that begin are left to the run before them
            heads = [i for i, of in enumerate(firsts) if i == 0 or of in entries]
            values = []
            for i, j in zip(heads, [*heads[1:], len(begins)], strict=True):
                a, b = begins[i], begins[j] if j < len(begins) else table.num_rows
                entry = state if i == 0 and goes_on else entries.get(firsts[i])
                got, state = automaton.run([c[a:b] for c in columns], begins[i:j] - a, entry)
                values.append(got)
            last = firsts[-1]
            yield from _batches(table.append_column(out.name, pa.array(np.concatenate(values))), [*names, out.name])

    ordered = cut.repartition(*keys, part).sortWithinPartitions(*keys, part, number)
    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields, out]))


def _entries(cut: DataFrame, long_: DataFrame, keys: list[str], part: str, number: str, automaton: Automaton) -> dict[tuple, Any]:
    """The state on entry of each chunk that goes on: by keys and chunk."""
    fields = [f for f in cut.schema.fields if f.name in (*keys, part)]
    narrow = cut.select(F.struct(*keys).alias("__key"), *dict.fromkeys([*keys, part, number, *automaton.columns]))
    narrow = narrow.join(F.broadcast(long_), "__key", "left_semi").drop("__key").repartition(*keys, part).sortWithinPartitions(*keys, part, number)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in fields]

        def made(held: list[pa.Table]) -> pa.RecordBatch:
            chunk = pa.concat_tables(held)
            columns = [chunk.column(c).to_numpy() for c in automaton.columns]
            _, leaves = automaton.run(columns, np.array([0]), None)
            row = chunk.select(names).slice(0, 1).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*row.columns, pa.array([pickle.dumps(automaton.summary(columns))]), pa.array([pickle.dumps(leaves)])], [*names, "map", "exit"])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            begins = _begins(table, names).tolist()
            for a, b in zip(begins, [*begins[1:], table.num_rows], strict=True):
                piece = table.slice(a, b - a)
                of = tuple(piece.column(c)[0].as_py() for c in names)
                if held and of != last:
                    yield made(held)
                    held = []
                held.append(piece)
                last = of
        if held:
            yield made(held)

    ddl = T.StructType([*fields, *T.StructType.fromDDL("map binary, exit binary").fields])
    entries: dict[tuple, Any] = {}
    last, state = None, None
    for r in narrow.mapInArrow(maps, ddl).orderBy(*keys, part).collect():
        key = tuple(r[k] for k in keys)
        if key == last:
            entries[*key, r[part]] = state
            state = automaton.through(pickle.loads(r["map"]), state)
        else:
            state = pickle.loads(r["exit"])
        last = key
    return entries
