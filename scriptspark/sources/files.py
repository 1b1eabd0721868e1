"""Books, scripts and audio files as tables, and back."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptspark.operators import timeline
from scriptspark.sources import wav
from scriptspark.sources.bookfiles import write_ordered

NEUTRAL = "Neutral, even narration."
SCRIPT = "array<struct<speaker:string,text:string,instruct:string>>"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, markdown): each file whole; its path is the id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book_id"), F.col("value").alias("markdown"))


def parse_script(books: DataFrame, text: str = "value") -> DataFrame:
    """(book_id, entry_idx, speaker, text, instruct) of JSON arrays. A missing direction is neutral; a missing speaker or text, or broken JSON, fails the query."""
    rows = books.select("book_id", F.posexplode(F.from_json(text, SCRIPT, {"mode": "FAILFAST"})).alias("entry_idx", "e"))
    needed = lambda name: F.coalesce(F.col(f"e.{name}"), F.raise_error(F.concat(F.lit(f"an entry without {name} in "), F.col("book_id").cast("string"))).cast("string"))
    return rows.select("book_id", F.col("entry_idx").cast("long").alias("entry_idx"), needed("speaker").alias("speaker"), needed("text").alias("text"), F.coalesce("e.instruct", F.lit(NEUTRAL)).alias("instruct"))


def read_script(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book_id"), "value")
    return parse_script(files)


def script_json(entries: DataFrame) -> DataFrame:
    """(book_id, script): each book's entries in order as one pretty JSON array."""
    ordered = entries.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("entry_idx", "speaker", "text", "instruct"))).alias("e"))
    bare = F.transform("e", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"), x["instruct"].alias("instruct")))
    return ordered.select("book_id", F.to_json(bare, {"pretty": "true"}).alias("script"))


def _in_folder(name: str) -> Column:
    return F.concat(F.lit("book_id="), F.url_encode(F.col("book_id").cast("string")), F.lit(f"/{name}"))


def write_script(entries: DataFrame, path: str) -> None:
    """One JSON array per book, script_json()'s text, in a folder of its own. Entries are streamed in order: no row holds a book."""
    body = F.to_json(F.struct("speaker", "text", "instruct"), {"pretty": "true"})
    write_ordered(entries, path, _in_folder("script.txt"), ["entry_idx"], body, "[ ", ", ", " ]")


def write_metadata(marks: DataFrame, titles: DataFrame, path: str) -> None:
    """Each book's chapter metadata document in a folder of its own, streamed chapter by chapter."""
    write_ordered(timeline.metadata_rows(marks, titles), path, _in_folder("metadata.txt"), ["part"], F.col("body"))


def write_cue(marks: DataFrame, titles: DataFrame, path: str) -> None:
    """Each book's cue sheet in a folder of its own, streamed track by track."""
    write_ordered(timeline.cue_rows(marks, titles), path, _in_folder("book.cue"), ["part"], F.col("body"))


# Audio files ---------------------------------------------------------------


def wav_samples(raw: bytes) -> tuple[np.ndarray, int, int]:
    """(samples in [-1, 1], rate, channels); integers are divided by the largest of their own width."""
    found = wav.header(io.BytesIO(raw), len(raw))
    return wav.block(io.BytesIO(raw), found, 0, len(raw))[1], found[2], found[1]


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, channels, samples, error): a damaged file gives a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    samples, rate, channels = wav_samples(bytes(content))
                    rows.append((p, rate, channels, samples, None))
                except (ValueError, struct.error) as wrong:
                    rows.append((p, None, None, None, str(wrong)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "samples", "error"]).astype({"sample_rate": "Int32", "channels": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sample_rate int, channels int, samples array<float>, error string")


def _wav(spark: SparkSession, path: str, what: str, **options: str) -> DataFrame:
    spark.dataSource.register(wav.WavSource)
    return spark.read.format("wav").options(what=what, **options).load(path)


def read_wav_blocks(spark: SparkSession, path: str, block_bytes: int = wav.BLOCK_BYTES) -> DataFrame:
    """(path, sample_rate, channels, first, samples, error): a row for each range of `block_bytes` of a file, so a long file is
    read by many tasks; `first` is the number of the row's first sample. Samples of all channels stand in turn."""
    return _wav(spark, path, "samples", block_bytes=str(block_bytes))


def wav_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, channels, n_samples, seconds, error) from headers alone: samples are never read."""
    return _wav(spark, path, "stats")
