"""Tables between the steps of one operator: written to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, in local mode only, a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _roots:
        _roots[key] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _roots[key]


def store(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table: computed once, and it outlives the executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what store() has written. Call it once results that rest on it are written."""
    while _paths:
        _delete(spark, _paths.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored_so_far() -> int:
    """A mark for drop_since()."""
    return len(_paths)


def drop_since(spark: SparkSession, mark: int, keep: list[DataFrame]) -> None:
    """Delete the tables stored since the mark, but for those that `keep` reads: a step's results are stored by then."""
    needed = {path.rpartition("/")[0].rpartition("/")[2] for df in keep for path in df.inputFiles()}
    for path in [x for x in _paths[mark:] if x.rpartition("/")[2] not in needed]:
        _paths.remove(path)
        _delete(spark, path)
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Ask the driver for a garbage collection: with it go the shuffle files of finished steps that nothing refers to.

    Listeners hold the step that has just ended for a moment more: call it once a further one has run.
    """
    spark._jvm.java.lang.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its source has fewer partitions than that; costly work per row follows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
