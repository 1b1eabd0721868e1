"""Splitting and packing: sentences with guards, greedy packs under a byte cap, speaker runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptspark.functions import strings as S
from scriptspark.operators.scan import chunked_scan
from scriptspark.storage import store

CHUNK_BYTES, SEGMENT_BYTES = 3000, 500

# Abbreviations before which a full stop doesn't end a sentence.
ABBREVIATIONS = "Dr Fr Mr Mrs Ms St Prof Rev Lt Col Gen Sgt Cpl vs etc viz cf al op".split()
LEAST_WORDS = 5


def sentences_guarded(text: Column, strict_abbrev: bool = True) -> Column:
    """Array of sentences: cuts at . ! ? that no abbreviation, lower-case word or short sentence forbids.

    Pieces end at each candidate; what makes one a cut is local to it, except for the words since the
    last accepted cut, which a fold over the pieces of this one text carries. Texts without rare white space, nearly
    all, are read with short patterns.
    """
    return F.when(S.has_rare_space(text), _guarded(text, strict_abbrev, S.SPACE)).otherwise(_guarded(text, strict_abbrev, r"\s"))


def _guarded(text: Column, strict_abbrev: bool, space: str) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).*?[.!?](?:{space}+|\z)|.+\z"), F.lit(0))

    def read(piece: Column) -> Column:
        return F.struct(piece.alias("text"), F.split(S.trim_space(piece), f"{space}+").alias("tokens"))

    def split(piece: Column) -> Column:
        last = F.element_at(piece["tokens"], -1)
        words = F.when(last == "", 0).otherwise(F.size(piece["tokens"]))
        return F.struct(piece["text"].alias("text"), words.alias("words"), last.alias("last"), F.substring(last, 1, F.char_length(last) - 1).alias("w"))

    def cuts(piece: Column, after: Column) -> Column:
        w = piece["w"]
        short = (F.octet_length(w) == 1) & w.rlike(r"^\p{L}$") | (F.octet_length(w) == 2) & w.rlike(r"^\p{L}+$")
        abbreviated = F.contains(w, F.lit(".")) | F.lower(w).isin([a.lower() for a in ABBREVIATIONS])
        if strict_abbrev:
            abbreviated = abbreviated | short
        follows = after.isNull() | after.rlike(r"^[\p{Lu}0-9\"'“‘]")
        return F.substring(piece["last"], -1, 1).isin(".", "!", "?") & ~abbreviated & follows

    def mark(all_: Column) -> Column:
        return F.transform(all_, lambda p, i: F.struct(p["text"].alias("text"), p["words"].alias("words"), cuts(p, F.get(all_, i + 1)["text"]).alias("cut")))

    # inside a one-element array the pieces are a bound variable: each is split once, not once for every use
    marked = F.get(F.transform(F.array(F.transform(F.transform(pieces, read), split)), mark), F.lit(0))
    start = F.struct(F.lit("").alias("cur"), F.lit(0).alias("words"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        cur, words = F.concat(acc["cur"], p["text"]), acc["words"] + p["words"]
        ends = p["cut"] & (words >= LEAST_WORDS)
        return F.struct(F.when(ends, "").otherwise(cur).alias("cur"), F.when(ends, 0).otherwise(words).alias("words"), F.when(ends, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"))

    done = F.aggregate(marked, start, step, lambda a: F.concat(a["done"], F.array(a["cur"])))
    return F.filter(F.transform(done, S.trim_space), lambda x: x != "")


class Packer:
    """Greedy packs as an automaton: the state is (bytes in the open pack, its number).

    A pack that begins at unit p ends where running sums pass a bound, so each unit has one successor. For any fill on entry,
    the first cut in a chunk is found in the sums alone, and what follows it depends on that cut only: the map of a chunk is the
    sums up to the farthest first cut, and for each cut the exit. Paths that meet are followed once.
    """

    columns = ["len", "slack", "glue", "force"]

    def __init__(self, most: int):
        self.most = most

    def _read(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, slack, glue = (np.nan_to_num(c.astype(float)).astype(np.int64) for c in columns[:3])
        upto = np.cumsum(size + glue)
        reach = upto - glue + slack
        if (np.diff(reach) < 0).any():
            raise ValueError("slack must not fall by more than a unit's length and glue")
        return size, upto, reach, columns[3].astype(bool)

    def _successors(self, size: np.ndarray, upto: np.ndarray, reach: np.ndarray, forced: np.ndarray) -> np.ndarray:
        """Where the pack that begins at each unit ends; forced: units that begin a pack anyway."""
        n = len(size)
        stop = np.r_[np.flatnonzero(forced), n]
        own = np.arange(n)
        nxt = np.maximum(np.searchsorted(reach, self.most + upto - size, side="right"), own + 1)
        return np.minimum(nxt, stop[np.searchsorted(stop, own, side="right")])

    def run(self, columns: list[np.ndarray], begins: np.ndarray, entry: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int]]:
        size, upto, reach, force = self._read(columns)
        n = len(size)
        forced = force.copy()
        forced[begins] = True
        nxt = self._successors(size, upto, reach, forced).tolist()
        first = 0 if entry is None else self._first_cut(entry[0], reach, force)
        starts, at = [], first
        while at < n:
            starts.append(at)
            at = nxt[at]
        new = np.zeros(n, np.int64)
        new[starts] = 1
        packs = np.cumsum(new) - 1 + (0 if entry is None else entry[1] + 1)
        base = np.zeros(n, np.int64)
        if len(begins) > 1:  # every key counts from 0
            base[begins[1:]] = np.diff(packs[begins])
            packs = packs - np.cumsum(base)
        fill = entry[0] + int(upto[-1]) if not starts else int(upto[-1] - upto[starts[-1]] + size[starts[-1]])
        return packs.astype(np.int32), (fill, int(packs[-1]))

    def _first_cut(self, fill: int, reach: np.ndarray, force: np.ndarray) -> int:
        at = int(np.searchsorted(reach, self.most - fill, side="right"))
        return min(at, int(force.argmax())) if force.any() else at

    def summary(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(sums up to each possible first cut, fill and packs after the chunk for each, sum of all)."""
        size, upto, reach, force = self._read(columns)
        n, far = len(size), self._first_cut(0, reach, force)
        nxt = self._successors(size, upto, reach, force).tolist()
        known: dict[int, tuple[int, int]] = {}
        for p in range(min(far, n - 1), -1, -1):
            path, at = [], p
            while at not in known and nxt[at] < n:
                path.append(at)
                at = nxt[at]
            fill, packs = known.setdefault(at, (int(upto[-1] - upto[at] + size[at]), 1))
            for at in reversed(path):
                packs += 1
                known[at] = fill, packs
        cuts = [known[p] for p in range(min(far, n - 1) + 1)]
        return reach[: far + 1], np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts]), int(upto[-1]) if far >= n else -1

    def through(self, summary: tuple, entry: tuple[int, int]) -> tuple[int, int]:
        reach, fills, packs, whole = summary
        at = min(int(np.searchsorted(reach, self.most - entry[0], side="right")), len(reach) if whole >= 0 else len(reach) - 1)
        if at == len(reach):
            return entry[0] + whole, entry[1]
        return int(fills[at]), entry[1] + int(packs[at])


def with_pack(units: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """units (keys, order, len, slack, glue, force) with column pack: greedy, a unit joins while pack + unit + slack <= most.

    `glue` bytes join two units, `force` begins a pack, a null length counts as 0; keys and order together name a unit.
    The units are stored, so that what makes them is computed once; the scan reads their lengths alone and a key of any
    size is spread over tasks (see scan). Texts are joined to their packs afterwards.
    """
    held = store(units.withColumn("__unit", F.monotonically_increasing_id()), "units")
    lengths = held.select("__unit", *keys, *order, *Packer.columns)
    packed = chunked_scan(lengths, keys, [*order, "__unit"], T.StructField("pack", T.IntegerType()), Packer(most))
    # a row each for every unit: its columns press well in files, so that by their size Spark would broadcast millions of them
    return held.join(packed.select("__unit", "pack").hint("merge"), "__unit").drop("__unit")


def _paragraph_units(paragraphs: DataFrame, keys: list[str], most: int, sentences, para_slack: int, para_glue: int) -> DataFrame:
    """Paragraphs, or the sentences of those over the cap: keys, para_idx, sent, text, len, slack, glue, force."""
    over = F.octet_length("text") > most
    parts = F.when(over, sentences(F.col("text"))).otherwise(F.array("text"))
    return paragraphs.select(*keys, "para_idx", over.alias("over"), F.posexplode(parts).alias("sent", "text")).select(
        *keys, "para_idx", "sent", "text", F.octet_length("text").alias("len"), F.when(F.col("over"), 1).otherwise(para_slack).alias("slack"),
        F.when(F.col("over"), 1).otherwise(para_glue).alias("glue"), (F.col("over") & (F.col("sent") == 0)).alias("force"),
    )


def pack_text_chunks(paragraphs: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """(book_id, chunk_idx, text): paragraphs joined by blank lines; over-long ones by sentences."""
    units = _paragraph_units(paragraphs.where(S.trim_space(F.col("text")) != ""), ["book_id"], most, S.sentences_simple, 2, 2)
    packed = with_pack(units, ["book_id"], ["para_idx", "sent"], most)
    glue = F.when(F.col("glue") == 2, "\n\n").otherwise(" ")
    part = F.struct("para_idx", "sent", glue.alias("glue"), "text")
    parts = packed.groupBy("book_id", F.col("pack").cast("long").alias("chunk_idx")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p, i: F.when(i == 0, p["text"]).otherwise(F.concat(p["glue"], p["text"]))), "")
    return parts.select("book_id", "chunk_idx", joined.alias("text"))


def _segment_units(paragraphs: DataFrame, keys: list[str], most: int) -> DataFrame:
    lines = paragraphs.withColumn("text", S.soft_wrap_join(F.col("text"))).where("text <> ''")
    return _paragraph_units(lines, keys, most, sentences_guarded, 2, 1)


def pack_segments(paragraphs: DataFrame, keys: list[str], most: int = SEGMENT_BYTES) -> DataFrame:
    """(keys, seg_idx, text): paragraphs joined by spaces under the cap; over-long ones by guarded sentences."""
    units = _segment_units(paragraphs, keys, most)
    packed = with_pack(units, keys, ["para_idx", "sent"], most)
    parts = packed.groupBy(*keys, F.col("pack").cast("long").alias("seg_idx")).agg(F.array_sort(F.collect_list(F.struct("para_idx", "sent", "text"))).alias("parts"))
    return parts.select(*keys, "seg_idx", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


# Directions of headings.
HEADING_INSTRUCT = {"TITLE": "Slow, atmospheric.", "CHAPTER": "Measured, clear chapter announcement.", "SECTION": "Neutral, even narration."}


def heading_instruct(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in HEADING_INSTRUCT.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def single_speaker(paragraphs: DataFrame, voice: str, style: str, most: int = SEGMENT_BYTES) -> DataFrame:
    """Entries (book_id, entry_idx, speaker, text, instruct): headings, and the text between them packed under one voice.

    A heading counts as longer than a pack may be, so nothing joins it: a book's packs are its entries, and no text is moved to number them.
    """
    heading = F.col("kind") != "BODY"
    lone = {"sent": F.lit(0), "text": S.trim_space(F.col("text")), "len": F.lit(most + 1), "slack": F.lit(2), "glue": F.lit(1), "force": F.lit(False)}
    heads = paragraphs.where(heading).withColumns(lone).select("book_id", "para_idx", "kind", *lone)
    units = heads.unionByName(_segment_units(paragraphs.where(~heading), ["book_id"], most).withColumn("kind", F.lit("BODY")))
    packed = with_pack(units, ["book_id"], ["para_idx", "sent"], most).select("book_id", "para_idx", "sent", "kind", "text", "pack")
    parts = packed.groupBy("book_id", F.col("pack").cast("long").alias("entry_idx")).agg(F.min("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("para_idx", "sent", "text"))).alias("parts"))
    spoken = F.col("kind") == "BODY"
    speaker, instruct = F.when(spoken, voice).otherwise(F.col("kind")), F.when(spoken, style).otherwise(heading_instruct(F.col("kind")))
    return parts.select("book_id", "entry_idx", speaker.alias("speaker"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"), instruct.alias("instruct"))


def speaker_runs(entries: DataFrame) -> DataFrame:
    """entries with run: a new one where speaker or direction changes or a heading-like text is next to it."""
    order = Window.partitionBy("book_id").orderBy("entry_idx")
    head = S.heading_like(F.col("text"))
    before = F.lag(F.struct("speaker", "instruct", head.alias("head"))).over(order)
    starts = before.isNull() | (before["speaker"] != F.col("speaker")) | (before["instruct"] != F.col("instruct")) | before["head"] | head
    return entries.withColumn("starts", starts.cast("long")).withColumn("run", F.sum("starts").over(order) - 1).drop("starts")


def group_by_speaker(entries: DataFrame, most: int = SEGMENT_BYTES) -> DataFrame:
    """Chunks (book_id, chunk_idx, speaker, text, instruct, n_entries): runs of one voice under the cap."""
    units = speaker_runs(entries).withColumns({"len": F.octet_length("text"), "slack": F.lit(1), "glue": F.lit(1), "force": F.lit(False)})
    packed = with_pack(units, ["book_id", "run"], ["entry_idx"], most)
    parts = packed.groupBy("book_id", "run", "pack").agg(F.min("speaker").alias("speaker"), F.min("instruct").alias("instruct"), F.array_sort(F.collect_list(F.struct("entry_idx", "text"))).alias("parts"))
    chunk = F.row_number().over(Window.partitionBy("book_id").orderBy("run", "pack")) - 1
    return parts.select("book_id", chunk.cast("long").alias("chunk_idx"), "speaker", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"), "instruct", F.size("parts").cast("long").alias("n_entries"))
