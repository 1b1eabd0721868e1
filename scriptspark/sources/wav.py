"""WAV files as a Spark data source that reads byte ranges: headers alone, or blocks of samples over many tasks.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("what", "stats").load(path)

`path` is a file, a folder (with those below it) or a pattern, on any file system that pyarrow opens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STATS = "path string, sample_rate int, channels int, n_samples long, seconds double, error string"
BLOCKS = "path string, sample_rate int, channels int, first long, samples array<float>, error string"
#: Bytes of a file that one row of samples covers; files shorter than that share a task up to as many.
BLOCK_BYTES = 8 << 20
HEADERS_PER_TASK = 256
_PEEK = 512


def header(file: BinaryIO, length: int) -> tuple[int, int, int, int, int, int]:
    """(format, channels, rate, bits, start of the samples, their bytes); ValueError for what isn't RIFF PCM or float.

    Reads a few hundred bytes around each chunk's head, never the samples.
    """
    held, base = b"", 0

    def span(at: int, n: int) -> bytes:
        nonlocal held, base
        if not base <= at <= at + n <= base + len(held):
            file.seek(at)
            held, base = file.read(max(n, _PEEK)), at
        return held[at - base : at - base + n]

    if span(0, 12)[:4] != b"RIFF" or span(8, 4) != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= length:
        name, size = span(at, 4), struct.unpack("<I", span(at + 4, 4))[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", span(at + 8, 16))
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack("<H", span(at + 32, 2))[0]
            fmt = (kind, channels, rate, bits)
        elif name == b"data":
            if fmt is None:
                raise ValueError("samples before their format")
            if (fmt[0], fmt[3]) not in ((1, 16), (1, 32), (3, 32)):
                raise ValueError(f"format {fmt[0]} with {fmt[3]} bits isn't read")
            return (*fmt, at + 8, min(size, max(0, length - at - 8)))
        at += 8 + size + size % 2
    raise ValueError("no samples")


def to_floats(body: bytes, kind: int, bits: int) -> np.ndarray:
    """Samples in [-1, 1]; integers are divided by the largest of their own width."""
    if kind == 3:
        return np.frombuffer(body, "<f4")
    whole = np.frombuffer(body, "<i2" if bits == 16 else "<i4")
    return (whole / float(2 ** (bits - 1) - 1)).astype(np.float32)


def block(file: BinaryIO, found: tuple[int, int, int, int, int, int], start: int, stop: int) -> tuple[int, np.ndarray]:
    """(number of the first, samples): those whose first byte lies in bytes start..stop-1 of the file."""
    kind, _, _, bits, at, size = found
    width = bits // 8
    first, last = (min(max(0, -(-(x - at) // width)), size // width) for x in (start, stop))
    file.seek(at + first * width)
    return first, to_floats(file.read((last - first) * width), kind, bits)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that a path names, in order of their names."""
    system, where = opened(path)
    parts = PurePosixPath(where).parts
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    prefix = "file://" if isinstance(system, pafs.LocalFileSystem) else path.replace("s3a://", "s3://", 1).split(where)[0]
    if fixed is None:
        info = system.get_file_info(where)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(where, recursive=True))
    else:
        below = system.get_file_info(pafs.FileSelector(str(PurePosixPath(*parts[:fixed])), recursive=len(parts) > fixed + 1))
        infos = [i for i in below if len(PurePosixPath(i.path).parts) == len(parts) and PurePosixPath(i.path).match(where)]
    return sorted((prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File)


class WavSource(DataSource):
    """Options: path; what: `stats` (a row a file) or `samples` (a row a block); block_bytes."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return STATS if self.options.get("what", "samples") == "stats" else BLOCKS

    def reader(self, schema: Any) -> DataSourceReader:
        return WavReader(self.options["path"], self.options.get("what", "samples") == "stats", int(self.options.get("block_bytes", BLOCK_BYTES)))


class WavReader(DataSourceReader):
    """A damaged file gives one row with an error; a file without samples gives one row with none."""

    def __init__(self, path: str, stats: bool, block_bytes: int):
        self.path, self.is_stats, self.block_bytes = path, stats, max(8, block_bytes)

    def partitions(self) -> list[InputPartition]:
        """Lists of (path, length, start, stop)."""
        files = listed(self.path)
        if self.is_stats:
            whole = [(p, n, 0, n) for p, n in files]
            return [InputPartition(whole[i : i + HEADERS_PER_TASK]) for i in range(0, len(whole), HEADERS_PER_TASK)]
        tasks, room = [], 0
        for p, n in files:
            for start in range(0, max(1, n), self.block_bytes):
                stop = min(n, start + self.block_bytes)
                if stop - start > room:
                    tasks.append([])
                    room = self.block_bytes
                tasks[-1].append((p, n, start, stop))
                room -= max(1, stop - start)
        return [InputPartition(t) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[tuple | pa.RecordBatch]:
        for path, length, start, stop in partition.value:
            try:
                system, where = opened(path)
                with system.open_input_file(where) as file:
                    found = header(file, length)
                    rate, channels = found[2], found[1]
                    if self.is_stats:
                        n = found[5] // (found[3] // 8) // max(1, channels)
                        yield (path, rate, channels, n, n / rate if rate else None, None)
                        continue
                    first, samples = block(file, found, start, stop)
                    if start == 0 or len(samples):
                        yield _row(path, rate, channels, first, samples, None)
            except (ValueError, struct.error) as wrong:
                if start == 0:
                    yield (path, None, None, None, None, str(wrong)) if self.is_stats else _row(path, None, None, None, None, str(wrong))


def _row(path: str, rate: int | None, channels: int | None, first: int | None, samples: np.ndarray | None, error: str | None) -> pa.RecordBatch:
    values = pa.array([None], pa.list_(pa.float32())) if samples is None else pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float32()))
    columns = {"path": pa.array([path]), "sample_rate": pa.array([rate], pa.int32()), "channels": pa.array([channels], pa.int32()), "first": pa.array([first], pa.int64()), "samples": values, "error": pa.array([error], pa.string())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
