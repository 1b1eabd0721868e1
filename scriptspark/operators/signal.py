"""Signal operators on segments (arrays of samples) and on exploded series (book_id, pos, x)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptspark.operators.scan import chunked_scan
from scriptspark.storage import store

FULL_SCALE = 32767
FLOOR_DB = -120.0


@dataclass(frozen=True)
class Compressor:
    threshold_db: float = -18.0
    ratio: float = 4.0
    makeup_db: float = 6.0
    attack_ms: float = 10.0
    release_ms: float = 100.0
    limit_db: float = -1.0
    rms_window_ms: float = 50.0

    def window(self, rate: int) -> int:
        return max(1, int(self.rms_window_ms * 0.001 * rate))

    def coefficient(self, ms: float, rate: int) -> float:
        return 1.0 - math.exp(-1.0 / (ms * 0.001 * rate))


# On arrays -----------------------------------------------------------------


#: Points of a block of a series.
BLOCK = 1 << 16


def quantise(samples: Column) -> Column:
    """Samples in [-1, 1] to integers, cut towards zero; what lies outside is clamped."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * FULL_SCALE).cast("int"))


def downmix(samples: Column, channels: int) -> Column:
    """The mean of each whole frame; samples of an unfinished frame are dropped."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    grid = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(grid, lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels)


def resample_linear(samples: Column, rate_from: int, rate_to: int) -> Column:
    """Linear interpolation on the output grid; exactly n * to div from samples."""
    if rate_from == rate_to:
        return F.transform(samples, lambda x: x.cast("double"))
    n = F.floor(F.size(samples).cast("long") * rate_to / rate_from).cast("int")
    grid = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        spot = i.cast("double") * rate_from / rate_to
        low = F.floor(spot).cast("int")
        high = F.least(low + 1, F.size(samples) - 1)
        a, b = F.get(samples, low).cast("double"), F.get(samples, high).cast("double")
        return a + (b - a) * (spot - low)

    return F.transform(grid, at)


def fades(segments: DataFrame, fade_ms: int = 20, idx: str = "seg_idx") -> DataFrame:
    """segments with faded: ramps at inner joins, on whole numbers; the first has no fade-in, the last no fade-out."""
    order = Window.partitionBy("book_id").orderBy(idx)
    flagged = segments.withColumns({"__first": F.lag(idx).over(order).isNull(), "__last": F.lead(idx).over(order).isNull(), "__q": quantise(F.col("samples"))})
    size = F.size("__q")
    n = F.least(F.floor(F.col("sample_rate") * fade_ms / 1000).cast("int"), size)

    def ramp(x: Column, j: Column) -> Column:
        up = F.when(~F.col("__first") & (j < n), j.cast("double") / n).otherwise(1.0)
        # rounded half away from zero after each ramp
        risen = F.round(x * up)
        down = F.when(~F.col("__last") & (j >= size - n), 1.0 - (j - (size - n)).cast("double") / n).otherwise(1.0)
        return F.round(risen * down).cast("int")

    return flagged.withColumn("faded", F.transform("__q", ramp)).drop("__first", "__last", "__q")


def assemble(line: DataFrame, idx: str = "seg_idx", samples: str = "faded") -> DataFrame:
    """(book_id, samples): one array per book, silence included. For small books; large ones stay rows ordered by start_sample."""
    parts = line.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(idx, samples, "gap"))).alias("parts"))
    return parts.select("book_id", F.flatten(F.transform("parts", lambda p: F.concat(p[samples], F.array_repeat(F.lit(0), p["gap"].cast("int"))))).alias("samples"))


def assemble_blocks(line: DataFrame, idx: str = "seg_idx", samples: str = "faded", block: int = BLOCK) -> DataFrame:
    """(book_id, block_no, start_sample, samples): each book's samples, silence included, in blocks of `block`, the last shorter.

    Segments, with the silence after each, tile the book; each is cut where blocks end, and a block joins its pieces. Only
    lengths are summed along a book, so no task holds its samples. A null array is empty; a book without samples has no block.
    """
    whole = F.concat(F.coalesce(samples, F.array().cast("array<int>")), F.array_repeat(F.lit(0), F.coalesce("gap", F.lit(0)).cast("int")))
    tiles = line.select("book_id", F.col(idx).alias("seg"), whole.alias("x"))
    lengths = line.select("book_id", F.col(idx).alias("seg"), (F.coalesce(F.size(samples), F.lit(0)) + F.coalesce("gap", F.lit(0))).cast("long").alias("n")).where("n > 0")
    begun = lengths.withColumn("start", F.sum("n").over(Window.partitionBy("book_id").orderBy("seg")) - F.col("n"))
    numbers = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}"))
    cut = tiles.join(begun, ["book_id", "seg"]).select("book_id", "x", "start", "n", F.explode(numbers).alias("block_no"))
    first = F.greatest(F.col("start"), F.col("block_no") * block)
    last = F.least(F.col("start") + F.col("n"), (F.col("block_no") + 1) * block)
    piece = F.struct(first.alias("at"), F.slice("x", (first - F.col("start") + 1).cast("int"), (last - first).cast("int")).alias("x"))
    joined = cut.select("book_id", "block_no", piece.alias("piece")).groupBy("book_id", "block_no").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return joined.select("book_id", "block_no", (F.col("block_no") * block).alias("start_sample"), F.flatten("pieces.x").alias("samples"))


# On series -----------------------------------------------------------------


def sliding_rms(series: DataFrame, n: int, keys: tuple[str, ...] = ("book_id",), x: str = "x", block: int = BLOCK) -> DataFrame:
    """series with rms over the next n points (this one first), divided by n; by prefix sums, so n doesn't matter to the cost.

    pos counts a key's points from 0 without gaps. A series is cut in blocks, each of which borrows the n - 1 points after it, so no
    task holds a key, and sums start anew in each, so long series lose no digits.
    """
    block = max(block, n)
    own = series.withColumns({"__block": F.floor(F.col("pos") / block), "__lent": F.lit(False)})
    lent = own.where((F.col("pos") % block < n - 1) & (F.col("__block") > 0)).select(*keys, "pos", x, (F.col("__block") - 1).alias("__block"), F.lit(True).alias("__lent"))
    held = Window.partitionBy(*keys, "__block")
    order = held.orderBy("pos")
    summed = own.unionByName(lent, allowMissingColumns=True).withColumn("__c", F.sum(F.col(x) * F.col(x)).over(order))
    span = F.coalesce(F.lead("__c", n - 1).over(order), F.max("__c").over(held)) - F.coalesce(F.lag("__c", 1).over(order), F.lit(0.0))
    return summed.withColumn("rms", F.sqrt(F.greatest(span, F.lit(0.0)) / n)).where("not __lent").drop("__c", "__block", "__lent")


def to_dbfs(rms: Column) -> Column:
    return F.when(rms > 1e-9, 20 * F.log10(rms)).otherwise(FLOOR_DB)


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def gain_target(level_db: Column, settings: Compressor = Compressor()) -> Column:
    over = level_db - settings.threshold_db
    return F.when(over > 0, -over * (1 - 1 / settings.ratio)).otherwise(0.0)


def smooth_gains(targets: np.ndarray, attack: float, release: float, start: float = 0.0) -> np.ndarray:
    """One pole: towards lower gain with the attack's coefficient, else with the release's."""
    out, g = np.empty(len(targets)), start
    for i, t in enumerate(targets.tolist()):
        g += (attack if t < g else release) * (t - g)
        out[i] = g
    return out


class Gain:
    """One pole as an automaton: the state is the gain, which stays between the least and the greatest target and 0.

    A step takes the entry gain through two lines that cross at the target, so what a chunk does to its entry is a rising
    line of straight pieces. It is kept as corner points; each target inside its range adds one, and the range
    shrinks with every step until all entries leave at one gain.
    """

    columns = ["__target"]

    def __init__(self, attack: float, release: float, low: float, high: float):
        self.attack, self.release, self.low, self.high = attack, release, low, high

    def run(self, columns: list[np.ndarray], begins: np.ndarray, entry: float | None) -> tuple[np.ndarray, float]:
        t = columns[0]
        out, ends = np.empty(len(t)), np.r_[begins[1:], len(t)]
        order = np.argsort(begins - ends, kind="stable")
        start, size = begins[order], (ends - begins)[order]
        gain = np.zeros(len(order))
        gain[order == 0] = entry or 0.0
        step, live = 0, len(order)
        while live >= SIDE_BY_SIDE:  # many keys: one step of all at once
            at = start[:live] + step
            goal = t[at]
            gain[:live] += np.where(goal < gain[:live], self.attack, self.release) * (goal - gain[:live])
            out[at] = gain[:live]
            step += 1
            live = int(np.searchsorted(-size, -step, side="left"))
        for k in range(live):
            out[start[k] + step : start[k] + size[k]] = smooth_gains(t[start[k] + step : start[k] + size[k]], self.attack, self.release, float(gain[k]))
        return out, float(out[-1])

    def summary(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = columns[0]
        x = y = np.array([self.low, self.high])
        for i, goal in enumerate(t.tolist()):
            if y[-1] - y[0] <= EVEN * max(1.0, abs(y[0])):
                gain = smooth_gains(t[i:], self.attack, self.release, float(y[0]))[-1]
                return np.array([self.low, self.high]), np.array([gain, gain])
            if y[0] < goal < y[-1]:
                k = int(np.searchsorted(y, goal))
                if y[k] != goal:
                    corner = x[k - 1] + (x[k] - x[k - 1]) * (goal - y[k - 1]) / (y[k] - y[k - 1])
                    x, y = np.insert(x, k, corner), np.insert(y, k, goal)
            y = y + np.where(goal < y, self.attack, self.release) * (goal - y)
        return x, y

    def through(self, summary: tuple[np.ndarray, np.ndarray], entry: float) -> float:
        return float(np.interp(entry, *summary))


#: From so many keys on a task takes them side by side; gains that differ by less, relative to their size, are one.
SIDE_BY_SIDE, EVEN = 16, 1e-13


def attack_release(series: DataFrame, rate: int, settings: Compressor = Compressor(), keys: tuple[str, ...] = ("book_id",), target: str = "target") -> DataFrame:
    """series with gain: a scan in order of pos within each key, spread over tasks in chunks (see scan). A null target counts as 0."""
    attack, release = settings.coefficient(settings.attack_ms, rate), settings.coefficient(settings.release_ms, rate)
    held = store(series.withColumn("__target", F.coalesce(F.col(target).cast("double"), F.lit(0.0))), "targets")
    low, high = held.agg(F.min("__target"), F.max("__target")).first()
    gain = Gain(attack, release, min(low or 0.0, 0.0), max(high or 0.0, 0.0))
    return chunked_scan(held, list(keys), ["pos"], T.StructField("gain", T.DoubleType()), gain).drop("__target")


def limiter(x: Column, gain_db: Column, settings: Compressor = Compressor()) -> Column:
    """x under gain and make-up gain, clamped to the limit, as an integer sample cut towards zero."""
    limit = 10 ** (settings.limit_db / 20)
    loud = x * db_to_linear(gain_db) * (10 ** (settings.makeup_db / 20))
    return (F.greatest(F.lit(-limit), F.least(F.lit(limit), loud)) * FULL_SCALE).cast("int")


def compress(series: DataFrame, rate: int, settings: Compressor = Compressor(), keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """series (keys, pos, x) with rms, gain and sample: level, target, smoothing, make-up and limit.

    Key by book and segment for the first pass, by book alone for an optional second one over the joined series.
    """
    levels = sliding_rms(series, settings.window(rate), keys)
    targets = levels.withColumn("target", gain_target(to_dbfs(F.col("rms")), settings))
    return attack_release(targets, rate, settings, keys).withColumn("sample", limiter(F.col("x"), F.col("gain"), settings))


def explode_samples(segments: DataFrame, idx: str = "seg_idx") -> DataFrame:
    """(book_id, seg_idx, pos, x) with x in [-1, 1]: quantised samples scaled back."""
    return segments.select("book_id", idx, F.posexplode(quantise(F.col("samples"))).alias("pos", "s")).select("book_id", idx, F.col("pos").cast("long").alias("pos"), (F.col("s") / float(FULL_SCALE)).alias("x"))
