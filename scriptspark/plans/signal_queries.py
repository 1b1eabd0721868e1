"""Queries of the signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptspark.operators import signal as A
from scriptspark.operators import timeline as T
from scriptspark.plans import fixtures as X
from scriptspark.plans.fixtures import with_duck

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SERIES_RATE = 100  # points a second of the value series
C = A.Compressor()
_Q = "cast(trunc(greatest(-1, least(1, cast(x as double))) * 32767) as int)"
FLAT = ", fl as (select book_id, seg_idx, unnest(samples) as x, cast(generate_subscripts(samples, 1) - 1 as bigint) as pos from fx_segments)"


def flat(df, column, name):
    return df.select("book_id", "seg_idx", F.posexplode(column).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


@query(with_duck(FLAT + f" select book_id, seg_idx, pos, {_Q} as q from fl", "fx_segments"))
def quantise(spark, sf_dir):
    return flat(X.segments(spark, sf_dir), A.quantise(F.col("samples")), "q")


@query(with_duck(FLAT + " select book_id, seg_idx, pos // 3 as pos, round(sum(cast(x as double)) / 3, 6) as x from fl where pos < 63 group by all", "fx_segments"))
def downmix(spark, sf_dir):
    return flat(X.segments(spark, sf_dir), A.downmix(F.col("samples"), 3), "x").withColumn("x", F.round("x", 6))


@query(with_duck(""", g as (select book_id, seg_idx, samples, unnest(range(0, 88)) as pos from fx_segments), h as (select *, pos * 32.0::double / 44 as spot from g)
 select book_id, seg_idx, pos, round(cast(samples[cast(floor(spot) as int) + 1] as double) + (cast(samples[least(cast(floor(spot) as int) + 2, 64)] as double) - cast(samples[cast(floor(spot) as int) + 1] as double)) * (spot - floor(spot)), 6) as x from h""", "fx_segments"))
def resample_linear(spark, sf_dir):
    return flat(X.segments(spark, sf_dir), A.resample_linear(F.col("samples"), 32, 44), "x").withColumn("x", F.round("x", 6))


@query(with_duck(FLAT + f""", q as (select book_id, seg_idx, pos, {_Q} as q, max(seg_idx) over (partition by book_id) as top, min(seg_idx) over (partition by book_id) as low from fl),
 u as (select *, round(q * case when seg_idx > low and pos < 6 then pos / 6.0::double else 1.0::double end) as r from q)
 select book_id, seg_idx, pos, cast(round(r * case when seg_idx < top and pos >= 58 then 1.0::double - (pos - 58) / 6.0::double else 1.0::double end) as int) as q from u""", "fx_segments"))
def fades(spark, sf_dir):
    faded = A.fades(X.segments(spark, sf_dir), 100)
    return flat(faded, F.col("faded"), "q")


@query(with_duck(""", g as (select book_id, len(samples) + case when lead(speaker) over w is null then 0 when lead(speaker) over w = speaker then 250 * 64 // 1000 else 500 * 64 // 1000 end as n from fx_segments window w as (partition by book_id order by seg_idx))
 select book_id, cast(sum(n) as bigint) as n_samples from g group by book_id""", "fx_segments"))
def assembled_length(spark, sf_dir):
    line = T.segment_gaps(X.segments(spark, sf_dir)).withColumn("faded", A.quantise(F.col("samples")))
    return A.assemble_blocks(line, block=50).groupBy("book_id").agg(F.sum(F.size("samples")).cast("long").alias("n_samples"))


RMS = ", rm as (select book_id, pos, x, sqrt(sum(x * x) over (partition by book_id order by pos rows between current row and 9 following) / 10) as rms from fx_series)"
LEVEL = RMS + ", lv as (select *, case when rms > 1e-9 then 20 * log10(rms) else -120.0 end as db from rm)"
TARGET = LEVEL + f", tg as (select *, case when db - ({C.threshold_db}) > 0 then -(db - ({C.threshold_db})) * (1 - 1 / {C.ratio}::double) else 0.0::double end as target from lv)"


def levels(spark, sf_dir):
    return A.sliding_rms(X.series(spark, sf_dir), 10).withColumn("db", A.to_dbfs(F.col("rms")))


@query(with_duck(RMS + " select book_id, pos, round(rms, 6) as rms from rm", "fx_series"))
def sliding_rms(spark, sf_dir):
    return A.sliding_rms(X.series(spark, sf_dir), 10).select("book_id", "pos", F.round("rms", 6).alias("rms"))


@query(with_duck(LEVEL + " select book_id, pos, round(db, 4) as db from lv", "fx_series"))
def dbfs(spark, sf_dir):
    return levels(spark, sf_dir).select("book_id", "pos", F.round("db", 4).alias("db"))


@query(with_duck(TARGET + " select book_id, pos, round(target, 4) as target from tg", "fx_series"))
def gain_target(spark, sf_dir):
    return levels(spark, sf_dir).select("book_id", "pos", F.round(A.gain_target(F.col("db")), 4).alias("target"))


def _smooth(rate: int, keys: str) -> str:
    names = [k.strip() for k in keys.split(",")]
    on, own = " and ".join(f"n.{k} = p.{k}" for k in names), ", ".join(f"n.{k}" for k in names)
    up, down = repr(C.coefficient(C.attack_ms, rate)), repr(C.coefficient(C.release_ms, rate))
    return f""", sm as (select {keys}, pos, case when target < 0 then {up}::double else {down}::double end * target as gain from tg where pos = 0
 union all select {own}, n.pos, p.gain + case when n.target < p.gain then {up}::double else {down}::double end * (n.target - p.gain) from sm p join tg n on {on} and n.pos = p.pos + 1)"""


@query(with_duck(TARGET + _smooth(SERIES_RATE, "book_id") + " select book_id, pos, round(gain, 4) as gain from sm", "fx_series", recursive=True))
def attack_release(spark, sf_dir):
    targets = levels(spark, sf_dir).withColumn("target", A.gain_target(F.col("db")))
    return A.attack_release(targets, SERIES_RATE).select("book_id", "pos", F.round("gain", 4).alias("gain"))


_LIMIT, _MAKEUP = repr(10 ** (C.limit_db / 20)), repr(10 ** (C.makeup_db / 20))
_SAMPLE = "cast(trunc(greatest(-" + _LIMIT + "::double, least(" + _LIMIT + "::double, x * pow(10.0::double, {0} / 20) * " + _MAKEUP + "::double)) * 32767) as int)"


@query(with_duck(TARGET + f" select book_id, pos, {_SAMPLE.format('target')} as sample from tg", "fx_series"))
def limiter(spark, sf_dir):
    targets = levels(spark, sf_dir).withColumn("target", A.gain_target(F.col("db")))
    return targets.select("book_id", "pos", A.limiter(F.col("x"), F.col("target")).alias("sample"))


@query(with_duck(FLAT + f""", sx as (select book_id, seg_idx, pos, {_Q} / 32767.0::double as x from fl),
 rm as (select *, sqrt(sum(x * x) over (partition by book_id, seg_idx order by pos rows between current row and {C.window(64) - 1} following) / {C.window(64)}) as rms from sx),
 lv as (select *, case when rms > 1e-9 then 20 * log10(rms) else -120.0 end as db from rm),
 tg as (select *, case when db - ({C.threshold_db}) > 0 then -(db - ({C.threshold_db})) * (1 - 1 / {C.ratio}::double) else 0.0::double end as target from lv)"""
                 + _smooth(64, "book_id, seg_idx") + f" select book_id, seg_idx, pos, round(gain, 4) as gain, {_SAMPLE.format('gain')} as sample from sm join sx using (book_id, seg_idx, pos)", "fx_segments", recursive=True))
def compress(spark, sf_dir):
    series = A.explode_samples(X.segments(spark, sf_dir))
    return A.compress(series, 64, keys=("book_id", "seg_idx")).select("book_id", "seg_idx", "pos", F.round("gain", 4).alias("gain"), "sample")
