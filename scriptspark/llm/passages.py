"""Substring dedup by paragraphs.

Paragraphs are lines of LEAST_WORDS or more, and blocks of shorter lines without a blank line between them that
reach PASSAGE_WORDS together (wrapped text). They are banded by MinHash over five-word shingles; colliding
paragraphs are joined, verified by exact Jaccard and clustered by components, and all but the first of
a cluster are removed. A pair at similarity 0.8 shares none of the nine bands of three with probability 0.0016.

Passages inside paragraphs: every run of PASSAGE_WORDS that an earlier document has word for word is removed as
well, wherever it starts. Each text is marked by anchors, windows of ANCHOR_WORDS whose hash is the least of its
neighbours', so that two texts that share a passage share an anchor of it. An anchor's context is the widest
run that passages around it can cover. Where an earlier document has the same context, all of it is
removed; of anchors that several contexts share, one occurrence of each context is read again and all windows of
PASSAGE_WORDS around it are compared.

Nothing is removed without a copy: paragraphs are decided first, and an occurrence of a passage that a removed paragraph
overlaps neither keeps the passage nor goes on its account; the first other document keeps it. A passage's keeper has a smaller
key, so each word of it stays there or, where a still earlier document has that part of it in a passage, there.

Equal paragraphs are one node. In a bucket every paragraph is held against a leader (in buckets of over SMALL_BUCKET
against a few more, turn by turn); when the components of these links are known, only pairs that stand in different components
are left, and all of these are decided. Smaller buckets take them directly; paragraphs of larger ones meet
by the rarest of what sets them apart from their bucket's usual shingles (prefix filter), which similar ones share early in both
orders; those that differ too little to share any are joined through the one that differs least. So no component is lost.

Null and wordless text has nothing to remove. Ties: the first occurrence is that with the smallest key. Rows alike
in key and text count as one document; null keys, and keys that several texts share, are told apart by the
text (common.own_keys). Passages that repeat only within one document are left alone. An empty table gives
an empty result. Texts of any length are read whole. A table's other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, components, drop_since, fresh_name, join_hot, one_row_each, own_keys, store, stored_so_far, tidy
from .wordhash import Words, grouped, least_places, lists, mixed, signed, words_of

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 9, 3
#: Shorter lines (headings, stock phrases, license lines) stand in many documents of their own right.
LEAST_WORDS = 20
PASSAGE_WORDS = 50
ANCHOR_WORDS = 16
#: How far a passage can reach beyond an anchor that it holds.
REACH = PASSAGE_WORDS - ANCHOR_WORDS
SMALL_BUCKET = 24
#: In larger buckets: leaders of each turn, and turns at most.
LEADERS, LEADER_TURNS = 6, 1

_rng = np.random.default_rng(42)
_SCALE = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
_FOLD = _rng.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

_word = re.compile(rf"[^{SPACES}]+")


def _ranges(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers at[i]..at[i]+size[i]-1 in a row, where each range starts among them)."""
    starts = np.cumsum(size) - size
    return np.repeat(at - starts, size) + np.arange(int(size.sum())), starts


def shingles(w: Words, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the five-word runs in each run of words, in a row; where each run's start). A shorter run is one shingle."""
    places, starts = _ranges(at, np.maximum(size - SHINGLE + 1, 1))
    return w.runs(places, np.repeat(np.minimum(size, SHINGLE), np.maximum(size - SHINGLE + 1, 1))), starts


def band_keys(w: Words, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(runs, BANDS): the band keys of each run of words."""
    if not len(at):
        return np.zeros((0, BANDS), np.uint64)
    x, starts = shingles(w, at, size)
    low = np.stack([np.minimum.reduceat(x * scale + shift, starts) for scale, shift in zip(_SCALE, _SHIFT, strict=True)], axis=1)
    keys = ((low.reshape(-1, BANDS, ROWS) >> np.uint64(16)) * _FOLD).sum(axis=2, dtype=np.uint64)
    return mixed(keys + np.arange(BANDS, dtype=np.uint64))


def anchors(w: Words) -> np.ndarray:
    """Places of the anchors: every PASSAGE_WORDS words of one text hold the least window of ANCHOR_WORDS in them."""
    n = len(w.h) - PASSAGE_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x, _ = w.windows(ANCHOR_WORDS)
    return np.unique(least_places(x, REACH + 1)[w.text[:n] == w.text[PASSAGE_WORDS - 1 :]])


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of words) of each paragraph, in order."""
    if not len(w.h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, w.line[1:] != w.line[:-1]])
    size, line, text = np.diff(np.r_[at, len(w.h)]), w.line[at], w.text[at]
    short = size < PASSAGE_WORDS
    goes_on = short[1:] & short[:-1] & (text[1:] == text[:-1]) & (line[1:] == line[:-1] + 1)
    head = np.flatnonzero(np.r_[True, ~goes_on])
    block, n_lines = np.add.reduceat(size, head), np.diff(np.r_[head, len(at)])
    wrapped, alone = (n_lines > 1) & (block >= PASSAGE_WORDS), size >= LEAST_WORDS
    at, size = np.r_[at[alone], at[head][wrapped]], np.r_[size[alone], block[wrapped]]
    order = np.argsort(at, kind="stable")
    return at[order], size[order]


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One stored row per document, from one reading of its text: what anchors() and the rest take from it.

    anchors: array<struct<h, context, at, words>>, at: the anchor's first word, words: those of its context.
    paragraphs: array<struct<h, at, words, bands>>. Places count the document's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in grouped(batch.column(1)):
                w = words_of(texts)
                every = np.arange(w.texts + 1)
                spot = anchors(w)
                begin, end = w.first[w.text[spot]], w.first[w.text[spot] + 1]
                low, high = np.maximum(begin, spot - REACH), np.minimum(end, spot + PASSAGE_WORDS)
                marks = pa.StructArray.from_arrays([signed(w.runs(spot, ANCHOR_WORDS)), signed(w.runs(low, high - low)), pa.array((spot - begin).astype(np.int32)), pa.array((high - low).astype(np.int32))], ["h", "context", "at", "words"])
                at, size = paragraphs(w)
                bands = lists(np.arange(len(at) + 1) * BANDS, signed(band_keys(w, at, size).reshape(-1)))
                held = pa.StructArray.from_arrays([signed(w.runs(at, size)), pa.array((at - w.first[w.text[at]]).astype(np.int32)), pa.array(size.astype(np.int32)), bands], ["h", "at", "words", "bands"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), lists(np.searchsorted(w.text[spot], every), marks), lists(np.searchsorted(w.text[at], every), held)], ["key", "anchors", "paragraphs"])

    ddl = "key long, anchors array<struct<h: long, context: long, at: int, words: int>>, paragraphs array<struct<h: long, at: int, words: int, bands: array<long>>>"
    return store(docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, ddl), "scanned")


def _held_before(df: DataFrame, by: str) -> DataFrame:
    """(by, keeper): what several documents have, and the first of them.

    Stored before a join with df itself, it leaves the join two plain shuffles, of which Spark splits a hot key's over tasks.
    """
    return df.groupBy(by).agg(F.min("key").alias("keeper"), F.max("key").alias("last")).where("keeper < last").select(by, "keeper")


def shared_anchors(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors (key, h, context, at, words) that several documents have, stored; (key, at) of those to read again).

    Read again is one occurrence of each context, where several contexts share the anchor.
    """
    several = store(_held_before(marks, "h").select("h"), "several")
    met = store(marks.join(several, "h"), "shared-anchors")
    first = met.groupBy("context", "h").agg(F.min(F.struct("key", "at")).alias("first")).select("first.key", "h", "first.at")
    return met, first.join(_held_before(first, "h").select("h"), "h").select("key", "at")


def untouched_windows(again: DataFrame, gone: DataFrame) -> DataFrame:
    """(key, h, at): the windows of read_again() that no run of gone (key, at, words) overlaps; they move as arrays, a row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows")
            text, flat = _texts(windows), windows.flatten()
            at = (text << 32) + flat.field("at").to_numpy(zero_copy_only=False)
            free = pa.array(np.flatnonzero(_free(batch.column("gone"), at, at + PASSAGE_WORDS)))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text)).take(free), flat.field("h").take(free), flat.field("at").take(free)], ["key", "h", "at"])

    held = again.select("key", "windows").where("size(windows) > 0")
    return held.join(_runs(gone), "key", "left").mapInArrow(run, "key long, h long, at int")


def _runs(gone: DataFrame) -> DataFrame:
    return gone.groupBy("key").agg(F.collect_list(F.struct("at", "words")).alias("gone"))


def _texts(arrays: pa.ListArray) -> np.ndarray:
    """The row of each element of a column of arrays."""
    return np.repeat(np.arange(len(arrays)), arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _free(runs: pa.ListArray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether no run of a text overlaps begin .. end; places are counted from row << 32."""
    lost = runs.flatten()
    first = (_texts(runs) << 32) + lost.field("at").to_numpy(zero_copy_only=False)
    order = np.argsort(first)
    # the farthest end so far: ends in earlier texts lie below all places of a later one
    far = np.r_[-1, np.maximum.accumulate((first + lost.field("words").to_numpy(zero_copy_only=False))[order])]
    return far[np.searchsorted(first[order], end)] <= begin


def cut_contexts(places: DataFrame, gone: DataFrame) -> DataFrame:
    """places (key, context, h, at, words, spot) with whole: that no run of gone overlaps; and free: else, its windows that none does, as steps from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, flat, runs = _texts(batch.column("held")), batch.column("held").flatten(), batch.column("gone")
            at, words = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "words"))
            begin = (text << 32) + at
            whole = _free(runs, begin, begin + words)
            steps = np.where(whole, 0, words - PASSAGE_WORDS + 1)
            window, starts = _ranges(begin, steps)
            free = _free(runs, window, window + PASSAGE_WORDS)
            cuts = np.r_[0, np.cumsum(free)][np.r_[starts, len(window)]]
            step = pa.array((window - np.repeat(begin, steps))[free].astype(np.int32))
            columns = [batch.column("key").take(pa.array(text)), *(flat.field(c) for c in ("context", "h", "at", "words", "spot")), pa.array(whole), lists(cuts, step)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "context", "h", "at", "words", "spot", "whole", "free"]
    held = places.groupBy("key").agg(F.collect_list(F.struct("context", "h", "at", "words", "spot")).alias("held"))
    return held.join(_runs(gone), "key").mapInArrow(run, "key long, context long, h long, at int, words int, spot int, whole boolean, free array<int>")


def passages_of(met: DataFrame, edges: DataFrame, again: DataFrame, gone: DataFrame) -> DataFrame:
    """(key, at, words, keeper): runs that an earlier document has, where that document's words aren't in gone (key, at, words).

    met, edges: shared_anchors(); again: read_again() of the edges. An occurrence of a context that gone
    overlaps neither goes nor keeps: the first that it leaves alone keeps. Where that isn't the occurrence that was read, its
    windows are those read, moved. Of occurrences that gone overlaps in part, the windows that it leaves alone are compared with
    one another and with the first.
    """
    ours, size = ["context", "h"], F.lit(PASSAGE_WORDS).alias("words")
    place = met.select("key", *ours, F.greatest(F.lit(0), F.col("at") - REACH).alias("at"), "words", F.col("at").alias("spot"))
    texts = broadcast_if_small(store(gone.select("key").distinct().withColumn("cut", F.lit(True)), "cut-texts"), 200_000, merge=True)
    marked = place.join(texts, "key", "left")
    uncut = marked.where("cut is null").drop("cut").withColumns({"whole": F.lit(True), "free": F.array().cast("array<int>")})
    seen = store(uncut.unionByName(cut_contexts(marked.where("cut").drop("cut"), gone)), "context-places")
    whole, hit = seen.where("whole").drop("whole", "free"), seen.where("not whole").drop("whole")
    keeps = store(whole.groupBy(*ours).agg(F.min(F.struct("key", "spot", "at")).alias("first"), F.max("key").alias("last")), "context-keepers")
    spans = whole.join(keeps.where("first.key < last").select(*ours, F.col("first.key").alias("keeper")), ours).where("key <> keeper").select("key", "at", "words", "keeper")
    # edges and keepers grow with the anchors, windows and steps come by an explode: Spark would broadcast them by the size of their files
    moved = hit.join(edges.withColumnRenamed("at", "spot").hint("merge"), ["key", "spot"]).join(keeps.select(*ours, "first").hint("merge"), ours)
    moved = store(moved.select("key", "spot", "first"), "moved-contexts")
    steps = moved.select("key", "first", F.col("spot").alias("from"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("spot") - REACH), F.col("spot"))).alias("at"))
    windows = again.select("key", "windows").join(broadcast_if_small(moved.select("key").distinct(), merge=True), "key", "left_semi").select("key", F.inline("windows"))
    shifted = windows.join(steps.hint("merge"), ["key", "at"]).select(F.col("first.key").alias("key"), "h", (F.col("at") - F.col("from") + F.col("first.spot")).alias("at"))
    # of contexts hit in part: a window is named by its place in the context
    parts = hit.select("key", *ours, "at", F.explode("free").alias("step"))
    firsts = parts.select(*ours, "step").distinct().join(keeps.select(*ours, "first").hint("merge"), ours).select("first.key", *ours, "first.at", "step")
    named = parts.unionByName(firsts).select("key", F.xxhash64(*ours, "step").alias("h"), (F.col("at") + F.col("step")).alias("at"))
    held = untouched_windows(again, gone).unionByName(shifted).unionByName(named)
    hits = held.join(_held_before(held, "h"), "h").where("key <> keeper").select("key", "at", size, "keeper")
    return merged(spans.unionByName(hits))


def read_again(docs: DataFrame, key: str, text: str, spots: DataFrame) -> DataFrame:
    """The texts that hold spots (key, h, at, words), stored: windows array<struct<h, at>>, sets array<struct<h, set>>.

    A spot without h is an anchor: all windows of PASSAGE_WORDS around it are given. Any other is a paragraph: its
    distinct shingles are given.
    """
    wanted = spots.groupBy("key").agg(F.collect_list(F.when(F.col("h").isNull(), F.col("at"))).alias("anchors"), F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", "at", "words"))).alias("paragraphs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in grouped(batch.column(1)):
                w = words_of(texts)
                every = np.arange(w.texts + 1)
                near, held = batch.column(2).slice(row, len(texts)), batch.column(3).slice(row, len(texts))
                spot = near.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], near.value_lengths().to_numpy(zero_copy_only=False))
                start = np.unique((spot[:, None] - np.arange(REACH + 1)).clip(0))
                start = start[start + PASSAGE_WORDS <= len(w.h)]
                start = start[w.text[start] == w.text[start + PASSAGE_WORDS - 1]]
                windows = pa.StructArray.from_arrays([signed(w.runs(start, PASSAGE_WORDS)), pa.array((start - w.first[w.text[start]]).astype(np.int32))], ["h", "at"])
                own = held.flatten()
                h, at, size = own.field("h"), own.field("at").to_numpy(zero_copy_only=False).astype(np.int64), own.field("words").to_numpy(zero_copy_only=False).astype(np.int64)
                counts = held.value_lengths().to_numpy(zero_copy_only=False)
                x, starts = shingles(w, at + np.repeat(w.first[:-1], counts), size)
                sets = [np.unique(part) for part in np.split(x, starts[1:])] if len(starts) else []
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                made = pa.StructArray.from_arrays([h, lists(np.cumsum([0, *map(len, sets)]), signed(flat))], ["h", "set"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), lists(np.searchsorted(w.text[start], every), windows), lists(np.cumsum([0, *counts]), made)], ["key", "windows", "sets"])

    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key")
    return store(texts.mapInArrow(run, "key long, windows array<struct<h: long, at: int>>, sets array<struct<h: long, set: array<long>>>"), "read-again")


def merged(spans: DataFrame) -> DataFrame:
    """(key, at, words, keeper): spans of one document and keeper that overlap or touch, put together."""
    own = Window.partitionBy("key", "keeper").orderBy("at", "stop")
    ends = spans.select("key", "keeper", "at", (F.col("at") + F.col("words")).alias("stop"))
    before = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begun = ends.withColumn("begins", F.coalesce(F.col("at") > before, F.lit(True)).cast("int"))
    island = begun.withColumn("island", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy("key", "keeper", "island").agg(F.min("at").alias("at"), F.max("stop").alias("stop"))
    return runs.select("key", "at", (F.col("stop") - F.col("at")).alias("words"), "keeper")


# Similar paragraphs --------------------------------------------------------


def in_buckets(units: DataFrame) -> DataFrame:
    """(h, band, leader), stored: the paragraphs that share a band with another, and one of them.

    The leader is the least under an order of the band's own (hashes turned by a mask), so a paragraph meets others in each bucket.
    """
    keyed = units.select("h", F.explode("bands").alias("band"))
    turned = F.col("h").bitwiseXOR(F.xxhash64("band"))
    crowded = keyed.groupBy("band").agg(F.min(turned).alias("low"), F.max(turned).alias("high")).where("low < high")
    leaders = crowded.select("band", F.col("low").bitwiseXOR(F.xxhash64("band")).alias("leader"))
    # nine rows a paragraph, of which Spark knows by the size before the explode only
    return store(keyed.join(leaders.hint("merge"), "band").distinct(), "buckets")


def set_spots(units: DataFrame, met: DataFrame) -> DataFrame:
    """(key, h, at, words): one occurrence of each paragraph that stands in a bucket."""
    near = units.select("key", "h", "at", "words").join(met.select("h").distinct(), "h", "left_semi")
    return near.groupBy("h").agg(F.min(F.struct("key", "at", "words")).alias("first")).select("first.key", "h", "first.at", "first.words")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= SIMILAR * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(h, component): paragraphs that near-duplicates link. sets (h, set) is stored."""
    pairs = store(met.where("h <> leader").select(F.least("h", "leader").alias("a"), F.greatest("h", "leader").alias("b")).distinct(), "leader-pairs")
    links = store(_verified(pairs, sets), "leader-links")
    found, open_ = _open_buckets(met, links)
    # In large buckets more leaders link most of a family, so that few pairs are left across components.
    for turn in range(LEADER_TURNS):
        more = store(_leader_pairs(open_.where(F.col("n") > SMALL_BUCKET), turn).join(pairs.hint("merge"), ["a", "b"], "left_anti"), "more-pairs")
        new = store(_verified(more, sets), "more-links")
        if new.isEmpty():
            break
        pairs, links = pairs.unionByName(more), links.unionByName(new)
        found, open_ = _open_buckets(met, links)
    if open_.isEmpty():
        return found
    rest = _small_buckets(open_, sets).unionByName(_large_buckets(open_, sets)).distinct()
    rest = store(_verified(rest.join(pairs.hint("merge"), ["a", "b"], "left_anti"), sets), "rest-links")
    return found if rest.isEmpty() else store(components(links.unionByName(rest), "a", "b"), "all-components").withColumnRenamed("node", "h")


def _open_buckets(met: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((h, component); (h, band, component, n) of the buckets with several components, both stored)."""
    found = store(components(links, "a", "b"), "leader-components").withColumnRenamed("node", "h")
    placed = store(met.select("h", "band").join(found, "h", "left").withColumn("component", F.coalesce("component", "h")), "placed")
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("band", "n")
    return found, store(placed.join(split, "band"), "open-buckets")


def _leader_pairs(open_: DataFrame, turn: int) -> DataFrame:
    """(a, b): each paragraph with LEADERS of its bucket, taken by orders of this turn's own, that stand in another component."""
    order = lambda i: F.struct(F.col("h").bitwiseXOR(F.xxhash64("band", F.lit(turn), F.lit(i))), "h", "component")
    leaders = open_.groupBy("band").agg(F.array(*(F.min(order(i)) for i in range(LEADERS))).alias("leaders"))
    met = open_.join(leaders, "band").select("h", "component", F.explode("leaders").alias("leader")).where("component <> leader.component")
    return met.select(F.least("h", "leader.h").alias("a"), F.greatest("h", "leader.h").alias("b")).distinct()


def _small_buckets(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs across components, in buckets of at most SMALL_BUCKET: under that many for each paragraph."""
    small = open_.where(F.col("n") <= SMALL_BUCKET).join(sets.select("h", F.size("set").alias("size")), "h")
    other = small.select("band", F.col("h").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("component_b"))
    fits = "component < component_b and 5 * size >= 4 * size_b and 5 * size_b >= 4 * size"
    apart = small.withColumnRenamed("h", "a").join(other, "band").where(fits)
    return apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _large_buckets(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components that are candidates in larger buckets: with links and components so far they connect all that is similar.

    Paragraphs meet within groups, the buckets whose largest component is the same. Each is taken as its difference from
    what is usual in its group (the shingles that over half have): shingles of its own, and usual ones that it lacks. Copies
    of one text differ from it in few places, so what all of them have brings nobody together. Of sizes x and y, two sets have similarity 0.8
    if (x + y) / 9 shingles at most are in one alone; their differences are apart by just as many.
    """
    large = open_.where(F.col("n") > SMALL_BUCKET)
    shares = large.groupBy("band", "component").agg(F.count("*").alias("share"))
    groups = shares.groupBy("band").agg(F.max_by("component", F.struct("share", "component")).alias("group"))
    members = store(large.select("h", "band", "component").join(groups, "band").select("group", "h", "component").distinct(), "group-members")
    differ = store(_differences(members, sets), "differences")
    # Pairs whose differences are small enough together need share nothing of them: each is similar to the member with the least.
    near = differ.select("group", "h", "component", (9 * F.col("d") - F.col("size")).alias("excess"))
    least = near.groupBy("group").agg(F.min(F.struct("excess", "h", "component")).alias("least"))
    usual = join_hot(near, least, "group", "h").where("excess + least.excess <= 0 and component <> least.component").select("h", F.col("least.h").alias("b"))
    # Of a pair's first common element: all before it, those of one component first, are in one alone.
    taken = F.greatest(F.lit(0), F.expr("size div 4 - alone + 1").cast("int"))
    ranked = differ.select("group", "h", "component", "size", "d", "alone", F.posexplode(F.slice("ranked", F.lit(1), taken)).alias("pos", "token"))
    rank = F.col("alone") + F.col("pos")
    prefix = ranked.select("group", "h", "component", "size", rank.alias("rank"), (F.col("d") - rank).alias("rest"), "token")
    apart = _meeting(store(prefix, "prefixes")).select("h", "b").unionByName(usual)
    return apart.select(F.least("h", "b").alias("a"), F.greatest("h", "b").alias("b")).distinct()


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (group, h, component) with size, d: how many shingles differ from the usual ones, alone: how many of these a single
    component has, ranked: the others, rare ones first, then the usual ones that are lacking (with all bits turned), the least often lacking first."""
    tokens = store(members.join(sets, "h").select("group", "h", "component", F.explode("set").alias("token")), "large-tokens")
    sizes = members.groupBy("group").agg(F.count("*").alias("members"))
    spread = tokens.groupBy("group", "token").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    spread = store(join_hot(spread, sizes, "group", "token"), "spread")
    often = spread.where("2 * n > members").groupBy("group").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))).alias("usual"))
    rare = spread.where("low < high and 2 * n <= members").select("group", "token", "n")
    own = tokens.join(rare, ["group", "token"]).groupBy("group", "h").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
    none = F.array().cast("array<long>")
    with_own = members.join(sets, "h").join(own.select("group", "h", F.col("own.token").alias("own")), ["group", "h"], "left")
    met = join_hot(with_own, often.select("group", F.col("usual.token").alias("usual")), "group", "h", "left")
    met = met.withColumns({"own": F.coalesce("own", none), "usual": F.coalesce("usual", none)}).withColumn("lacking", F.array_except("usual", "set"))
    d = F.size("set") - F.size("usual") + 2 * F.size("lacking")
    ranked = F.concat("own", F.transform("lacking", F.bitwise_not))
    return met.select("group", "h", "component", F.size("set").alias("size"), d.alias("d"), (d - F.size(ranked)).alias("alone"), ranked.alias("ranked"))


def _meeting(prefix: DataFrame) -> DataFrame:
    """Pairs of a group across components by a common element of their differences.

    rank: how many elements come before it, rest: how many from it on. Those before the first that two have in common are in one
    alone, and so are at least as many as one has more after it: together (size + size_b) / 9 at most. So either rank is
    an eighth of its size at most (the sizes differ by a quarter at most), and both are a fourth at most.
    """
    other = prefix.select("group", "token", F.col("h").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("component", "size", "rank", "rest")))
    fits = "component <> component_b and 9 * (rank + rank_b + abs(rest - rest_b)) <= size + size_b"
    return prefix.where("8 * rank <= size").join(other, ["group", "token"]).where(fits)


def near_copies(units: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key): of the whole texts in units (key, h, words, bands), those that similarity 0.8 links to one with a smaller key."""
    units = units.withColumn("at", F.lit(0))
    met = in_buckets(units)
    sets = store(read_again(docs, key, text, set_spots(units, met)).select(F.inline("sets")), "copy-sets")
    # equal texts are one node even where no other text is near
    members = store(units.select("key", "h").join(similar(met, sets), "h", "left").withColumn("component", F.coalesce("component", "h")), "copy-members")
    return members.join(_held_before(members, "component"), "component").where("key <> keeper").select("key").distinct()


# Removal -------------------------------------------------------------------


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, words, keeper, kind): runs of words to take out, start words before them; they may overlap.

    key is a whole number, unique and never null (see common.own_keys).
    """
    mark = stored_so_far()
    seen = scanned(docs, key, text)
    units = store(seen.select("key", F.inline("paragraphs")), "paragraph-units")
    anchored, edges = shared_anchors(seen.select("key", F.inline("anchors")))
    edges = store(edges, "edges")
    # of the anchors, the most of what is stored, only those that several documents have are read again
    drop_since(docs.sparkSession, mark, [units, anchored, edges])
    met = in_buckets(units)
    tidy(docs.sparkSession)
    anchors_again = edges.select("key", F.lit(None).cast("long").alias("h"), "at", F.lit(None).cast("int").alias("words"))
    again = read_again(docs, key, text, anchors_again.unionByName(set_spots(units, met)))
    tidy(docs.sparkSession)
    classes = similar(met, store(again.select(F.inline("sets")), "shingle-sets"))
    members = store(units.select("key", "h", "at", "words").join(classes, "h", "left").withColumn("component", F.coalesce("component", "h")), "members")
    near = members.join(store(_held_before(members, "component"), "first-members"), "component").where("key <> keeper").select("key", "at", "words", "keeper")
    near = store(near, "near-paragraphs")
    drop_since(docs.sparkSession, mark, [near, again, anchored, edges])
    passages = passages_of(anchored, edges, again, near).withColumn("kind", F.lit("passage"))
    near = near.withColumn("kind", F.lit("paragraph"))
    found = passages.unionByName(near)
    return found.select(F.col("key").alias(key), F.col("at").alias("start"), "words", F.col("keeper").alias("keeper"), "kind")


def op5_paragraph_minhash(spark, sf_dir: str) -> DataFrame:
    """One row per removed run: keeper_doc_id is a document that holds it (paragraph: one like it) and keeps it."""
    docs, _, back = own_keys(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "key")
    found = removals(docs, "key").withColumnsRenamed({"key": "doc_id", "keeper": "keeper_doc_id"})
    if back is not None:
        for name in ("doc_id", "keeper_doc_id"):
            ids = back.select(F.col("key").alias(name), F.col("doc_id").alias("id"), F.lit(True).alias("odd"))
            found = found.join(ids, name, "left").withColumn(name, F.when(F.col("odd"), F.col("id")).otherwise(F.col(name))).drop("id", "odd")
    return found.select("doc_id", "start", "words", "keeper_doc_id", "kind")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the runs of words (first, how many). What stays is joined by a line feed or a space, as it stood apart."""
    places = [m.span() for m in _word.finditer(text)]
    gone = np.zeros(len(places), bool)
    for at, n in spans:
        gone[at : at + n] = True
    edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
    out, last = [], 0
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        begin, end = places[a][0] if a else 0, places[b - 1][1] if b < len(places) else len(text)
        if out:
            out.append("\n" if "\n" in text[last : places[last_word][0]] or "\n" in text[places[a - 1][1] : begin] else " ")
        out.append(text[begin:end])
        last, last_word = end, min(b, len(places) - 1)
    return "".join(out)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the removed runs; a document of which no word is left goes."""
    names = docs.columns
    row, held = fresh_name(docs, "row"), fresh_name(docs, "spans")
    keyed, odd, _ = own_keys(docs, "doc_id", "text", row)
    spans = removals(keyed, row).groupBy(row).agg(F.collect_set(F.struct("start", "words")).alias(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                small = batch.slice(at, 1024)
                texts, kept = [], []
                for i, (text, found) in enumerate(zip(small.column("text"), small.column(held), strict=True)):
                    text = text.as_py()
                    if found.is_valid:
                        text = cut(text, [(s["start"], s["words"]) for s in found.as_py()])
                        if not text.strip(SPACES):
                            continue
                    texts.append(text)
                    kept.append(i)
                rows = small.take(pa.array(kept, pa.int64()))
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in names], names)

    return keyed.join(spans, row, "left").select(*names, held).mapInArrow(run, docs.schema)
