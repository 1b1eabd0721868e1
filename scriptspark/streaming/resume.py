"""Incremental work as streams: new chunks are handled once, smoothing goes on across batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from scriptspark.operators.signal import Compressor, smooth_gains
from scriptspark.operators.timeline import pending


def committed(spark: SparkSession, outputs_path: str) -> list[str]:
    """Names of the batches whose outputs count: those that the manifest below _done holds whole."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{outputs_path}/_done")
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{outputs_path}/_done/batch=*/_SUCCESS"))
    return sorted(str(f.getPath().getParent().getName()).removeprefix("batch=") for f in found or [])


def outputs(spark: SparkSession, outputs_path: str) -> DataFrame | None:
    """The outputs of committed batches; None before the first."""
    done = committed(spark, outputs_path)
    return spark.read.parquet(*(f"{outputs_path}/batch={name}" for name in done)) if done else None


def _commit(keys: DataFrame, path: str) -> None:
    """A batch's line in the manifest: the keys it gave. It counts from the moment its _SUCCESS stands."""
    keys.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)


def resume(spark: SparkSession, chunks_path: str, schema: str, outputs_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run `work` on chunk files that came since the last run and add its outputs; read them with outputs().

    A batch writes a folder of its own, named after the checkpoint and its number, then its keys (book_id, chunk_idx) into the
    manifest. Ended between the two, it runs again and replaces its folder; ended after them, before the checkpoint knows, it
    is left alone. Chunks whose keys the manifest has, of any batch and any checkpoint, are left out: of the keys, only those
    within the batch's range of books are read, and of the outputs none.
    """

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        name = f"{json.loads(session.read.text(f'{checkpoint}/metadata').first()[0])['id']}-{number}"
        done = committed(session, outputs_path)
        if name in done:
            return
        todo = batch
        if done:
            low, high = batch.agg(F.min("book_id"), F.max("book_id")).first()
            known = session.read.parquet(*(f"{outputs_path}/_done/batch={d}" for d in done)).where(F.col("book_id").between(low, high))
            todo = pending(batch, known)
        path = f"{outputs_path}/batch={name}"
        work(todo).write.mode("overwrite").parquet(path)
        _commit(session.read.parquet(path).select("book_id", "chunk_idx"), f"{outputs_path}/_done/batch={name}")

    stream = spark.readStream.schema(schema).parquet(chunks_path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def smooth_stream(series: DataFrame, rate: int, settings: Compressor = Compressor()) -> DataFrame:
    """(book_id, pos, gain) of a stream (book_id, pos, target): the state is one gain and the last position.

    Points are put in order within a micro-batch; a point at or before the last position is late and left out.
    """
    attack, release = settings.coefficient(settings.attack_ms, rate), settings.coefficient(settings.release_ms, rate)

    def scan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gain, last = state.get if state.exists else (0.0, -1)
        points = pd.concat(list(frames)).sort_values("pos")
        points = points[points["pos"] > last]
        if len(points):
            gains = smooth_gains(points["target"].to_numpy(float), attack, release, gain)
            state.update((float(gains[-1]), int(points["pos"].iloc[-1])))
            yield pd.DataFrame({"book_id": key[0], "pos": points["pos"].to_numpy(np.int64), "gain": gains})

    return series.groupBy("book_id").applyInPandasWithState(scan, "book_id long, pos long, gain double", "gain double, last long", "append", GroupStateTimeout.NoTimeout)


class LateSmoother(StatefulProcessor):
    """Smooths a book's points in the order of (at, pos), each once the watermark is past it. State: the gain, and the points that wait."""

    def __init__(self, attack: float, release: float):
        self.attack, self.release = attack, release

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gain = handle.getValueState("gain", "gain double")
        self.waiting = handle.getListState("waiting", "at long, pos long, target double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [p for frame in rows for p in zip(frame["at"].tolist(), frame["pos"].tolist(), frame["target"].tolist(), strict=True)]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(p[0] for p in came))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(p) for p in self.waiting.get())
        ready, rest = [p for p in held if p[0] <= past], [p for p in held if p[0] > past]
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        gains = smooth_gains(np.array([p[2] for p in ready]), self.attack, self.release, self.gain.get()[0] if self.gain.exists() else 0.0)
        self.gain.update((float(gains[-1]),))
        yield pd.DataFrame({"book_id": key[0], "pos": [p[1] for p in ready], "gain": gains})

    def close(self) -> None:
        pass


def smooth_late_stream(series: DataFrame, rate: int, wait: str, settings: Compressor = Compressor(), at: str = "at") -> DataFrame:
    """(book_id, pos, gain) of a stream (book_id, pos, target, at): points that come late by up to `wait` take their place in order.

    A point waits until the watermark, `wait` behind the newest time `at` seen, is past its own time; then it is smoothed and given
    out. Only points older than the watermark when they come are left out. `at` must not fall as pos rises. A book's state is one
    gain and the points of about `wait`. The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    attack, release = settings.coefficient(settings.attack_ms, rate), settings.coefficient(settings.release_ms, rate)
    known = series.withWatermark(at, wait).select("book_id", "pos", F.col("target").cast("double").alias("target"), F.unix_millis(at).alias("at"), F.col(at).alias("event"))
    return known.groupBy("book_id").transformWithStateInPandas(LateSmoother(attack, release), "book_id long, pos long, gain double", "Append", "EventTime")
