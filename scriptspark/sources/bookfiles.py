"""A file sink that streams ordered rows: each file is written row by row by one task, and appears whole or not at all.

    write_ordered(rows, path, file=F.col("name"), order=["n"], body=F.col("line"))

Tasks write below `_temporary` in names of their own, so an attempt that is lost or runs twice harms nothing; the driver moves
what the committed tasks name, and deletes the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from scriptspark.sources.wav import opened


@dataclass
class Written(WriterCommitMessage):
    """(where a task put a file, its name)"""

    files: list[tuple[str, str]]


class BookFiles(DataSource):
    """Rows (file, body), a file's rows together and in order. Options: path; head, sep and tail of each file."""

    @classmethod
    def name(cls) -> str:
        return "bookfiles"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return BookWriter(self.options["path"], *(self.options.get(k, "") for k in ("head", "sep", "tail")), overwrite)


class BookWriter(DataSourceWriter):
    def __init__(self, path: str, head: str, sep: str, tail: str, overwrite: bool):
        self.path, self.head, self.sep, self.tail, self.overwrite = path.rstrip("/"), head, sep, tail, overwrite
        self.job = uuid.uuid4().hex

    def _place(self) -> tuple[pafs.FileSystem, str, str]:
        system, top = opened(self.path)
        return system, top, f"{top}/_temporary/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, work = self._place()
        system.create_dir(work, recursive=True)
        written = []
        for name, rows in groupby(iterator, key=lambda r: r["file"]):
            if name is None:
                raise ValueError("a row without a file")
            at = f"{work}/{uuid.uuid4().hex}"
            with system.open_output_stream(at) as out:
                before = self.head
                for r in rows:
                    out.write((before + (r["body"] or "")).encode())
                    before = self.sep
                out.write(self.tail.encode())
            written.append((at, name))
        return Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top, work = self._place()
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one file came in several runs: sort them by file")
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
                if not old.path.rstrip("/").endswith("/_temporary"):
                    (system.delete_dir if old.type == pafs.FileType.Directory else system.delete_file)(old.path)
        for at, name in files:
            to = f"{top}/{name}"
            system.create_dir(to.rsplit("/", 1)[0], recursive=True)
            system.move(at, to)
        self._clean(system, top, work)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*self._place())

    @staticmethod
    def _clean(system: pafs.FileSystem, top: str, work: str) -> None:
        """Remove this job's folder, and _temporary once no other job's is left."""
        if system.get_file_info(work).type != pafs.FileType.NotFound:
            system.delete_dir(work)
        if not system.get_file_info(pafs.FileSelector(f"{top}/_temporary", allow_not_found=True)) and system.get_file_info(f"{top}/_temporary").type != pafs.FileType.NotFound:
            system.delete_dir(f"{top}/_temporary")


def write_ordered(rows: DataFrame, path: str, file: Column, order: list[str], body: Column, head: str = "", sep: str = "", tail: str = "") -> None:
    """Replace what `path` holds by one file for each value of `file`: head, the bodies in order with sep between them, tail.

    Spark sorts a file's rows and streams them to its task's file, so no row or array holds a file. A null body is empty; a null
    file ends the job.
    """
    rows.sparkSession.dataSource.register(BookFiles)
    named = rows.select(file.alias("file"), *order, body.alias("body")).repartition("file").sortWithinPartitions("file", *order)
    named.select("file", "body").write.format("bookfiles").options(path=path, head=head, sep=sep, tail=tail).mode("overwrite").save()
