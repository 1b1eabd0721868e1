"""Shared pieces: tables in the shared folder, checked broadcasts, split running totals, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that ends a word: [\x20\x09-\x0D]. bytes.split() cuts at exactly these.
SPACES = " \t\n\r\x0b\x0c"

#: From here on own_keys() names what has no key of its own.
ODD_FROM = 2**62

_roots: dict[str, str] = {}
ROWS_PER_FILE = 20_000
#: Owner and path of each stored table.
_paths: list[tuple[str | None, str]] = []
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is the session's spark.checkpoint.dir. Only where that is unset (tests in local mode) a temporary
    folder is made, and a session that isn't local is refused.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _roots:
        _roots[key] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(_roots[key])
    return _roots[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; release() of its owner removes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append((_owner.get(), path))
    return path


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables stored inside belong to the owner, so that release() of others leaves them alone."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Remove the tables that were stored for the owner (None: outside of owned()). Call it once their results are written."""
    for found in [x for x in _paths if x[0] == owner]:
        _paths.remove(found)
        _delete(spark, found[1])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove(stored: DataFrame) -> None:
    """Delete the files of a table from store() that nothing reads any more."""
    for path in {x.rpartition("/")[0] for x in stored.inputFiles()}:
        _delete(stored.sparkSession, path)


def stored_so_far() -> int:
    """A mark for drop_since()."""
    return len(_paths)


def tidy(spark: SparkSession) -> None:
    """Ask the driver for a garbage collection: with it go the shuffle files of finished steps that nothing refers to."""
    spark._jvm.java.lang.System.gc()


def drop_since(spark: SparkSession, mark: int, keep: list[DataFrame]) -> None:
    """Delete the tables that were stored since the mark, but for those that `keep` reads: a step's results are stored by then."""
    needed = {path.rpartition("/")[0].rpartition("/")[2] for df in keep for path in df.inputFiles()}
    for found in [x for x in _paths[mark:] if x[1].rpartition("/")[2] not in needed]:
        _paths.remove(found)
        _delete(spark, found[1])
    tidy(spark)


def broadcast_if_small(df: DataFrame, most: int = 20_000, merge: bool = False) -> DataFrame:
    """df with a broadcast hint if a count finds at most so many rows; beyond it Spark decides by the size of the files.

    Call it on stored tables of narrow rows (under 200 bytes), so that the hint stays below 4 MB. merge: beyond it the join is
    sorted and merged whatever the files' size, as keys that press well in files are millions of rows before Spark finds them large.
    """
    return F.broadcast(df) if df.count() <= most else df.hint("merge") if merge else df


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, or name with low lines before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_keys(docs: DataFrame, key: str, text: str, name: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(docs with a long column `name` of its own for each text, the odd keys, what `name` of odd rows stands for).

    The key itself serves (a whole number under ODD_FROM) where it stands on one row. Odd keys, null or on several rows, give way to
    ODD_FROM and more: a 62-bit hash of key and text, so rows alike in both share one. Without odd keys the last two are None.
    """
    odd = store(docs.groupBy(F.col(key).alias("odd")).agg(F.count("*").alias("n")).where(f"n > 1 or odd is null or odd >= {ODD_FROM}").select("odd"), "odd-keys")
    if odd.isEmpty():
        return docs.withColumn(name, F.col(key).cast("long")), None, None
    mark = fresh_name(docs, "odd")
    odd = broadcast_if_small(odd.withColumnRenamed("odd", mark).withColumn(f"{mark}_row", F.lit(True)))
    met = docs.join(odd, F.col(key).eqNullSafe(F.col(mark)), "left")
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.col(key).isNull(), F.col(text)).bitwiseAND(F.lit(ODD_FROM - 1)) + F.lit(ODD_FROM)
    keyed = met.withColumn(name, F.when(F.col(f"{mark}_row"), hashed).otherwise(F.col(key).cast("long")))
    back = store(keyed.where(F.col(f"{mark}_row")).select(name, key).distinct(), "odd-rows")
    return keyed.drop(mark, f"{mark}_row"), odd, back


def one_row_each(keyed: DataFrame, name: str, odd: DataFrame | None) -> DataFrame:
    """keyed with one row for each value of `name`; only those of odd keys can have more."""
    if odd is None:
        return keyed
    return keyed.where(F.col(name) < ODD_FROM).unionByName(keyed.where(F.col(name) >= ODD_FROM).dropDuplicates([name]))


def chunk_of(n_rows: int, rows_per_chunk: int = 1500, most: int = 65_536) -> int:
    """Into how many chunks a running total is split, so that a task never holds a whole hot key."""
    return max(1, min(most, n_rows // rows_per_chunk))


def running_total(df: DataFrame, keys: list[str], value: str, order: list[str], chunks: int, out: str, chunk: Column | None = None) -> DataFrame:
    """Column `out`: the sum of `value` over the rows before this one with the same keys.

    Rows go by a chunk number first (a hash of the order columns and of `out`, so that totals taken one
    after the other are cut in different ways, unless `chunk` is given), then by `order`. Sums inside a chunk and sums of chunks are taken apart, so a hot key is spread over
    `chunks` tasks. `df` should be a stored table: it is read twice. No key may be null.
    """
    part = f"__{out}_chunk"
    df = df.withColumn(part, (F.pmod(F.xxhash64(*order, F.lit(out)), F.lit(chunks)) if chunk is None else chunk).cast("int"))
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(part)
    before = sums.select(*keys, part, (F.sum("__sum").over(w) - F.col("__sum")).alias("__before"))
    inner = Window.partitionBy(*keys, part).orderBy(*order)
    own = df.withColumn("__own", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    joined = own.join(before, [*keys, part])
    return joined.withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before", part)


def join_hot(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner", pieces: int = 16) -> DataFrame:
    """rows joined with few (one narrow row a key): each key's rows are dealt by a hash of `spread` over several tasks."""
    part = f"__{key}_part"
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(pieces)).cast("int"))
    copies = few.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return dealt.join(copies, [key, part], how).drop(part)


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each node of the undirected edges can reach.

    Alternates the large-star and small-star steps until the edges stand still; every round is a stored
    table, of as many files as its rows ask for, and replaces the one before (ROWS_PER_FILE at most go to one task). Nodes without an edge to another node don't
    appear. Edges to oneself are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = store(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = _fingerprint(e)
    while mark[0]:
        # so few rows are one task's work: nothing is shuffled then
        e = e.coalesce(1) if mark[0] <= ROWS_PER_FILE else e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        before, e = e, store(small.coalesce(1 + mark[0] // ROWS_PER_FILE), name)
        last, mark = mark, _fingerprint(e)
        _remove(before)
        if last == mark:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
