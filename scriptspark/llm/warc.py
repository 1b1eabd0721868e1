"""WARC archives with a two-level capture index.

Tasks write archives of single-record gzip members into the shared folder and return each record's
place. The captures, sorted by reversed-host key, go into index files of compressed blocks, each file
with a sparse directory (the first key of each block) at its end. A lookup binary-searches the list of
index files, then a file's directory, then the block, and the record is read by its byte range.

Null html is an empty payload and a null url an empty one. Rows alike in url and page_id are captures
of their own; where several rows of equal payloads share the largest page_id, each is a response. A null page_id
refers to nothing. Payloads of any length are stored whole. An empty table gives an empty result. Other columns play
no part, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, new_path, store

LEAST_REVISIT = 1000
BLOCK_LINES = 512
ARCHIVE_BYTES = 1 << 30
#: Revisits of so many bytes at most are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 4_000_000

_PLACE = "page_id long, surt string, archive string, at long, size long"
_url = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")


def surt(url: str | None) -> str:
    """The reversed-host key of a url: com,example,www)/path?query. Scheme, user, fragment and a leading www. go."""
    m = _url.match(url or "")
    if not m:
        return (url or "").partition("#")[0]
    host, port, path = m[1].lower().removeprefix("www."), m[2], m[3] or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + path


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# Archives ------------------------------------------------------------------


def captures(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, html (never null), digest, refers_to (null: a response) and its url.

    Revisits are settled on ids and digests alone, a common digest dealt over several tasks; pages then meet
    what they refer to by page_id and digest, so no payload moves to a task of its digest's own.
    """
    own = pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1("html"))
    large = own.where(F.octet_length("html") >= LEAST_REVISIT).where("page_id is not null").select("page_id", "digest", "url")
    large = store(large, "large-payloads")
    groups = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.min("page_id").alias("least")).where("least < kept.page_id")
    met = join_hot(large.select("page_id", "digest").distinct(), groups.select("digest", "kept"), "digest", "page_id").where("page_id < kept.page_id")
    refers = met.select("page_id", "digest", F.col("kept.page_id").alias("refers_to"), F.col("kept.url").alias("refers_url"))
    refers = store(refers, "revisits")
    size = refers.agg(F.sum(F.coalesce(F.octet_length("refers_url"), F.lit(0)) + 100)).first()[0] or 0
    return own.join(F.broadcast(refers) if size <= BROADCAST_BYTES else refers, ["page_id", "digest"], "left")


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str, date: str) -> bytes:
    """A gzip member. The block of a response is the HTTP message; lengths and digests of payloads are those of the html alone."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", f"Page-ID: {'' if page_id is None else page_id}",
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {refers_url}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(found: DataFrame, folder: str) -> DataFrame:
    """Write a record per row; returns each record's place. Evaluate it once: store() the result.

    A file's name carries the task attempt, so a task that runs again leaves the places of others alone. WARC-Date is the call's.
    """
    date = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    columns_read = ["page_id", "url", "html", "digest", "refers_to", "refers_url"]
    one_line = lambda x: re.sub(r"[\r\n]", " ", x or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        at, number = 0, 0
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to, refers_url in zip(*(batch.column(c) for c in columns_read), strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, number = f"{stem}-{number:04d}.warc.gz", 0, number + 1
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    link = url.as_py() or ""
                    raw = _record(page_id.as_py(), one_line(link), html.as_py().encode(), digest.as_py(), refers_to.as_py(), one_line(refers_url.as_py()), date)
                    out.write(raw)
                    rows.append((page_id.as_py(), surt(link), name, at, len(raw)))
                    at += len(raw)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "surt", "archive", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return found.select(columns_read).mapInArrow(run, _PLACE)


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of the record and payload of the HTTP message in one gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, body = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, body[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


# Index ---------------------------------------------------------------------


def write_index(places: DataFrame, folder: str, files: int) -> list[dict]:
    """Sort the captures into index files; returns the list of files, one entry each, in key order.

    The list has as many entries as there are files, whatever the number of captures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx"
        directory, lines, at = [], [], 0
        with fs.open_output_stream(path, compression=None) as out:

            def flush() -> None:
                nonlocal at, lines
                raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
                out.write(raw)
                directory.append((lines[0][0], lines[0][1], at, len(raw)))
                at += len(raw)
                lines = []

            for batch in batches:
                for surt_key, page_id, archive, start, size in zip(*(batch.column(c).to_pylist() for c in ("surt", "page_id", "archive", "at", "size")), strict=True):
                    lines.append((surt_key, -1 if page_id is None else page_id, archive, start, size, page_id is None))
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
            raw = zlib.compress(json.dumps(directory).encode())
            out.write(raw)
        if directory:
            yield pa.RecordBatch.from_pylist([{"file": path, "surt": directory[0][0], "page_id": directory[0][1], "at": at, "size": len(raw)}], pa.schema([("file", pa.string()), ("surt", pa.string()), ("page_id", pa.int64()), ("at", pa.int64()), ("size", pa.int64())]))

    key = [F.col("surt"), F.coalesce("page_id", F.lit(-1))]
    written = places.repartitionByRange(files, *key).sortWithinPartitions(*key).mapInArrow(run, "file string, surt string, page_id long, at long, size long")
    listed = [r.asDict() for r in store(written, "index-files").collect()]
    return sorted(listed, key=lambda r: (r["surt"].encode(), r["page_id"]))


class Index:
    """Lookups in written index files; keeps the last directory and block."""

    def __init__(self, folder: str, files: list[dict]):
        self.fs, _ = _open_fs(folder)
        self.files = files
        self.first = [(r["surt"].encode(), r["page_id"]) for r in files]
        self.held: tuple = (None, [], [])
        self.block: tuple = (None, [], [])

    def _range(self, path: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            return f.read_at(size, at)

    def _directory(self, number: int) -> tuple[list, list]:
        if self.held[0] != number:
            r = self.files[number]
            found = json.loads(zlib.decompress(self._range(r["file"], r["at"], r["size"])))
            self.held = (number, [(x[0].encode(), x[1]) for x in found], found)
        return self.held[1:]

    def _lines(self, number: int, entry: list) -> tuple[list, list]:
        spot = (number, entry[2])
        if self.block[0] != spot:
            found = [json.loads(x) for x in zlib.decompress(self._range(self.files[number]["file"], entry[2], entry[3])).split(b"\n")]
            self.block = (spot, [(x[0].encode(), x[1]) for x in found], found)
        return self.block[1:]

    def find(self, surt_key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(archive, at, size) of each capture with this key and id. A null id stands beside -1 in the order, told apart by its mark."""
        key, out = (surt_key.encode(), -1 if page_id is None else page_id), []
        number = max(0, bisect.bisect_left(self.first, key) - 1)
        while number < len(self.files) and self.first[number] <= key:
            first, entries = self._directory(number)
            block = max(0, bisect.bisect_left(first, key) - 1)
            while block < len(entries) and first[block] <= key:
                keys, lines = self._lines(number, entries[block])
                at = bisect.bisect_left(keys, key)
                while at < len(keys) and keys[at] == key:
                    if lines[at][5] == (page_id is None):
                        out.append(tuple(lines[at][2:5]))
                    at += 1
                block += 1
            number += 1
        return out


def lookup(keys: DataFrame, folder: str, files: list[dict], tasks: int) -> DataFrame:
    """(page_id, surt) to the places of its captures. Keys are sorted first, so a task reads each block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, files)
        for batch in batches:
            rows = [(p, s, *hit) for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.find(s, p)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "surt", "archive", "at", "size"])

    key = [F.col("surt"), F.coalesce("page_id", F.lit(-1))]
    return keys.distinct().repartitionByRange(tasks, *key).sortWithinPartitions(*key).select("page_id", "surt").mapInArrow(run, _PLACE)


def read_captures(places: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Range-read each place's record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has no payload of its own: its length and digest come from its headers; a response's are
    taken from the payload that was read. Places are sorted, so ranges of a file are read in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        name = file = None
        for batch in batches:
            rows = []
            for page_id, archive, at, size in zip(*(batch.column(c).to_pylist() for c in ("page_id", "archive", "at", "size")), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{base}/{archive}")
                headers, payload = read_record(file.read_at(size, at))
                if headers["WARC-Type"] == "response":
                    rows.append((page_id, headers["WARC-Target-URI"], len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                else:
                    rows.append((page_id, headers["WARC-Target-URI"], int(headers["Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(headers["Refers-To-Page-ID"])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = places.repartitionByRange(tasks, "archive", "at").sortWithinPartitions("archive", "at")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> tuple[DataFrame, str, str, list[dict], int]:
    """Write pages as archives and index: (places, archive folder, index folder, index files, tasks)."""
    spark = pages.sparkSession
    folder, index = new_path(spark, "warc"), new_path(spark, "cdx")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = store(write_archives(captures(pages), folder), "places")
    return places, folder, index, write_index(places, index, tasks), tasks


def op7_warc_index(spark, sf_dir: str) -> DataFrame:
    """Every page is looked up by its key in the index and its record is read by range."""
    places, folder, index, files, tasks = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = lookup(places.select("page_id", "surt"), index, files, tasks)
    return read_captures(found, folder, tasks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
