"""Names, genders and speakers of quoted speech, over text chunks (book_id, chunk_idx, text).

A chunk's roster is the prefix of the book's roster of names first met by then. Words meet it by an equality join, and what a
turn needs of it (its size, its first names) is carried along the chunks, an as-of join. Who speaks without attribution alternates between the first two names of
the roster; a window over the paragraphs since the last known speaker gives the turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptspark.functions import strings as S
from scriptspark.operators.packing import heading_instruct

# Words that are no names.
STOP_WORDS = "HE SHE THEY IT WE YOU SAID ASKED NARRATOR TITLE CHAPTER SECTION".split()
NEUTRAL = "Neutral, even narration."

# Patterns that name a speaker, and pronouns beside them.
_FORWARD_NAME = rf'(?:"[^"]*,"\s+)?([A-Z][a-z]{{1,19}})\s+(?:{S.FORWARD_VERBS})'
_INVERTED_NAME = rf"(?i)\b(?:{S.SAID})\s+([A-Za-z][a-z]{{1,19}})\b"
_ACTION_NAME = rf"\b([A-Z][a-z]{{1,19}})\s+(?:{S.ACTION_VERBS})"
_QUOTED_NAME = r'^"([A-Z][a-z]{1,19})\.?"$'
_NAME_PRONOUN = r'(?i)"([A-Z][a-z]{1,19}),?"\s*(?:he|she)\s+(?:said|asked|replied)'
_PRONOUN_OF_NAME = r'(?i)"[A-Z][a-z]{1,19},?"\s*(he|she)\s+(?:said|asked|replied)'
_NAMED = rf"(?i)\b([A-Z][a-z]{{1,19}})\s+(?:{S.SAID})"
_HE, _SHE = rf"(?i)\bhe\s+(?:{S.SAID})", rf"(?i)\bshe\s+(?:{S.SAID})"


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def chunk_texts(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that know their chunk to text chunks."""
    parts = paragraphs.groupBy("book_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text"))).alias("parts"))
    return parts.select("book_id", "chunk_idx", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))


def clean_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text", S.strip_emphasis(F.col("text")))


def names_of(text: Column) -> Column:
    """Sorted distinct names that a clean chunk's attributions give, in upper case."""
    capital = lambda x: x.rlike("^[A-Z]")
    quoted = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(F.trim(x), _QUOTED_NAME, 1))
    found = F.concat(extract_all(text, _FORWARD_NAME), F.filter(extract_all(text, _INVERTED_NAME), capital), extract_all(text, _ACTION_NAME), F.filter(quoted, lambda x: x != ""))
    return F.array_sort(F.array_except(F.array_distinct(F.transform(found, F.upper)), F.array(*map(F.lit, STOP_WORDS))))


def extract_names(clean: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, name)."""
    return clean.select("book_id", "chunk_idx", F.explode(names_of(F.col("text"))).alias("name"))


def roster(names: DataFrame) -> DataFrame:
    """(book_id, name, first_chunk, rank): in the order of chunks, then of names."""
    first = names.groupBy("book_id", "name").agg(F.min("chunk_idx").alias("first_chunk"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("first_chunk", "name")) - 1
    return first.withColumn("rank", rank.cast("long"))


def paragraphs_of(clean: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, para, text): trimmed paragraphs of clean chunks."""
    return clean.select("book_id", "chunk_idx", F.posexplode(F.split("text", "\n\n")).alias("para", "text")).withColumns({"text": F.trim("text"), "para": F.col("para").cast("long")}).where("text <> ''")


def gender_evidence(paras: DataFrame, names: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, para, rule, pos, name, gender) for names of the roster as of the chunk."""
    text = F.col("text")
    direct = F.arrays_zip(extract_all(text, _NAME_PRONOUN).alias("n"), extract_all(text, _PRONOUN_OF_NAME).alias("p"))
    he, she = text.rlike(_HE), text.rlike(_SHE)
    only = F.when(he & ~she, "M").when(she & ~he, "F")
    key = ["book_id", "chunk_idx", "para"]
    one = paras.select(*key, F.lit(1).alias("rule"), F.posexplode(direct).alias("pos", "x")).select(*key, "rule", "pos", F.upper("x.n").alias("name"), F.when(F.lower("x.p") == "he", "M").otherwise("F").alias("gender"))
    two = paras.select(*key, F.lit(2).alias("rule"), only.alias("gender"), F.posexplode(extract_all(text, _NAMED)).alias("pos", "x"))
    three = paras.select(*key, F.lit(3).alias("rule"), only.alias("gender"), F.posexplode(extract_all(text, _INVERTED_NAME)).alias("pos", "x")).where(F.col("x").rlike("^[A-Z]"))
    rest = two.unionByName(three).where("gender is not null").select(*key, "rule", "pos", F.upper("x").alias("name"), "gender")
    known = names.select("book_id", "name", "first_chunk")
    return one.unionByName(rest).join(known, ["book_id", "name"]).where("first_chunk <= chunk_idx").select(*key, "rule", "pos", "name", "gender")


def gender_first(evidence: DataFrame) -> DataFrame:
    """(book_id, name, gender, from_chunk): the earliest evidence wins."""
    at = F.struct("chunk_idx", "para", "rule", "pos")
    return evidence.groupBy("book_id", "name").agg(F.min_by("gender", at).alias("gender"), F.min("chunk_idx").alias("from_chunk"))


def gender_by_elimination(names: DataFrame, first: DataFrame) -> DataFrame:
    """(book_id, name, gender, from_chunk, eliminated).

    At the first chunk at whose end one name is unresolved and all others share one gender, that name
    gets the other. From then on both genders are present, so it happens once in a book at most: running counts
    over the chunks at which something changes find it without a fold.
    """
    changes = names.select("book_id", F.col("first_chunk").alias("chunk_idx"), F.lit(1).alias("names"), F.lit(0).alias("m"), F.lit(0).alias("f"))
    changes = changes.unionByName(first.select("book_id", F.col("from_chunk").alias("chunk_idx"), F.lit(0).alias("names"), (F.col("gender") == "M").cast("int").alias("m"), (F.col("gender") == "F").cast("int").alias("f")))
    w = Window.partitionBy("book_id").orderBy("chunk_idx")
    state = changes.groupBy("book_id", "chunk_idx").agg(*(F.sum(c).alias(c) for c in ("names", "m", "f")))
    state = state.select("book_id", "chunk_idx", *(F.sum(c).over(w).alias(c) for c in ("names", "m", "f")))
    hit = state.where("names - m - f = 1 and ((m > 0 and f = 0) or (f > 0 and m = 0))")
    hit = hit.groupBy("book_id").agg(F.min(F.struct("chunk_idx", "m")).alias("hit")).select("book_id", F.col("hit.chunk_idx").alias("at"), F.when(F.col("hit.m") > 0, "F").otherwise("M").alias("other"))
    full = names.join(first, ["book_id", "name"], "left").join(hit, "book_id", "left")
    out = (F.col("first_chunk") <= F.col("at")) & (F.col("from_chunk").isNull() | (F.col("from_chunk") > F.col("at")))
    out = F.coalesce(out, F.lit(False))
    final = full.select("book_id", "name", F.when(out, F.col("other")).otherwise(F.col("gender")).alias("gender"), F.when(out, F.col("at")).otherwise(F.col("from_chunk")).alias("from_chunk"), out.alias("eliminated"))
    return final.where("gender is not null")


def cast_of(names: DataFrame, genders: DataFrame) -> DataFrame:
    """(book_id, name, rank, first_chunk, gender, from_chunk): the roster, with each name's gender and the chunk that tells it."""
    return names.join(genders.select("book_id", "name", "gender", "from_chunk"), ["book_id", "name"], "left")


def quote_spans(paras: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, para, pos, is_speech, text): pieces between ASCII double quotes, trimmed."""
    spans = paras.select("book_id", "chunk_idx", "para", F.posexplode(F.split("text", '"')).alias("pos", "text"))
    return spans.select("book_id", "chunk_idx", "para", F.col("pos").cast("long").alias("pos"), (F.col("pos") % 2 == 1).alias("is_speech"), F.trim("text").alias("text"))


def structural_entries(paras: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, para, speaker, text, instruct) of paragraphs without quotes."""
    plain = paras.where(~F.contains("text", F.lit('"')))
    kind = F.regexp_extract("text", "^@@(TITLE|CHAPTER|SECTION): ", 1)
    instruct = F.coalesce(heading_instruct(kind), F.lit(NEUTRAL))
    return plain.select("book_id", "chunk_idx", "para", F.when(kind == "", "NARRATOR").otherwise(kind).alias("speaker"), F.trim(F.regexp_replace("text", "^@@(TITLE|CHAPTER|SECTION): ", "")).alias("text"), instruct.alias("instruct"))


def attribution_cues(paras: DataFrame, cast: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, para, cue, is_known) of quoted paragraphs, with the roster as of the chunk (see as_of_chunk).

    cue (type, name) is that of the first span that has one; is_known: whether an inverted cue's name is in the roster. Words that
    may be a beat's name meet the roster by an equality join, so no row carries a roster.
    """
    key = ["book_id", "chunk_idx", "para"]
    spans = F.filter(F.transform(F.split("text", '"'), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t"))), lambda s: s["i"] % 2 == 0)

    def verb(s: Column) -> Column:
        forward, inverted = F.regexp_extract(s["t"], S.FORWARD, 1), F.regexp_extract(s["t"], S.INVERTED, 1)
        kind = F.when(forward != "", "forward").when(inverted.rlike("^[A-Z]"), "inverted")
        return F.struct(s["i"].alias("i"), kind.alias("type"), F.upper(F.when(forward != "", forward).otherwise(inverted)).alias("name"))

    quoted = paras.where(F.contains("text", F.lit('"'))).select(*key, spans.alias("spans"))
    quoted = quoted.withColumn("verb", F.get(F.filter(F.transform("spans", verb), lambda c: c["type"].isNotNull()), F.lit(0)))
    words = lambda s: F.transform(F.split(s["t"], r"\s+"), lambda w: F.upper(F.regexp_replace(w, r"[^\p{L}]+$", "")))
    before = F.filter("spans", lambda s: F.col("verb").isNull() | (s["i"] < F.col("verb.i")))
    quoted = quoted.withColumn("beats", F.array_distinct(F.filter(F.flatten(F.transform(before, words)), lambda w: w != "")))
    asked = F.when(F.col("verb.type") == "inverted", F.concat("beats", F.array("verb.name"))).otherwise(F.col("beats"))
    asked = quoted.select(*key, "verb", F.size("beats").alias("beats"), F.posexplode_outer(asked).alias("pos", "word"))
    names = cast.select(F.col("book_id").alias("of"), "name", "first_chunk")
    met = asked.join(names, (F.col("book_id") == F.col("of")) & (F.col("word") == F.col("name")) & (F.col("first_chunk") <= F.col("chunk_idx")), "left")
    met = met.where("name is not null or coalesce(pos, 0) = 0")
    found = met.groupBy(*key).agg(F.first("verb").alias("verb"), F.first("beats").alias("beats"), F.min(F.when(F.col("name").isNotNull(), F.struct("pos", "name"))).alias("hit"))
    named = F.struct(F.lit("beat").alias("type"), F.col("hit.name").alias("name"))
    cue = F.when(F.col("hit.pos") < F.col("beats"), named).when(F.col("verb").isNotNull(), F.struct("verb.type", "verb.name"))
    return as_of_chunk(found.select(*key, cue.alias("cue"), F.coalesce(F.col("hit.pos") >= F.col("beats"), F.lit(False)).alias("is_known")), cast)


def as_of_chunk(rows: DataFrame, cast: DataFrame) -> DataFrame:
    """rows (book_id, chunk_idx, ...) with names (how many), first, second (the roster's first two), he and she (its first of each gender).

    An as-of join: a row for each change of the cast goes before the rows of its chunk, and a running state is carried over both.
    """
    entered = cast.select("book_id", F.col("first_chunk").alias("chunk_idx"), F.struct("rank", "name").alias("__enters"))
    told = cast.where("gender is not null").select("book_id", F.greatest("first_chunk", "from_chunk").alias("chunk_idx"), F.struct("rank", "name").alias("__told"), F.col("gender").alias("__gender"))
    both = rows.withColumn("__row", F.lit(1)).unionByName(entered.unionByName(told, allowMissingColumns=True), allowMissingColumns=True)
    order = Window.partitionBy("book_id").orderBy("chunk_idx", F.coalesce("__row", F.lit(0)))
    least = lambda when, of: F.min(F.when(when, F.col(of))).over(order)["name"]
    state = {
        "names": F.count("__enters").over(order), "first": F.min("__enters").over(order)["name"], "second": least(F.col("__enters.rank") == 1, "__enters"),
        "he": least(F.col("__gender") == "M", "__told"), "she": least(F.col("__gender") == "F", "__told"),
    }
    return both.withColumns(state).where("__row = 1").select(*rows.columns, *state)


def resolve_cues(cues: DataFrame) -> DataFrame:
    """Adds anchor: the speaker that the cue alone settles, or null where the turn decides."""
    name, kind, empty = F.col("cue.name"), F.col("cue.type"), F.col("names") == 0
    forward = F.when(name == "HE", F.when(empty, "HE").otherwise(F.col("he"))).when(name == "SHE", F.when(empty, "SHE").otherwise(F.col("she"))).when(~name.isin("THEY", "IT"), name)
    anchor = F.when(kind == "forward", forward).when(kind == "inverted", F.when(F.col("is_known"), name)).when(kind == "beat", name)
    return cues.withColumn("anchor", anchor)


def speakers(paras: DataFrame, cast: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, para, cue_type, anchor, speaker) of quoted paragraphs.

    Turns count from the last paragraph with a settled speaker, or from the last one without quotes, or from the chunk's start.
    """
    settled = resolve_cues(attribution_cues(paras, cast)).select("book_id", "chunk_idx", "para", "names", "first", "second", F.col("cue.type").alias("cue_type"), "anchor", F.lit(True).alias("quoted"))
    plain = paras.where(~F.contains("text", F.lit('"'))).select("book_id", "chunk_idx", "para", F.lit(False).alias("quoted"))
    rows = settled.unionByName(plain, allowMissingColumns=True)
    order = Window.partitionBy("book_id", "chunk_idx").orderBy("para")
    # a cue to the narrator settles its own paragraph and leaves the turn as it was
    marks = ~F.col("quoted") | (F.col("anchor").isNotNull() & (F.col("anchor") != "NARRATOR"))
    rows = rows.withColumn("group", F.sum(marks.cast("long")).over(order))
    inside = Window.partitionBy("book_id", "chunk_idx", "group").orderBy("para")
    open_ = F.col("quoted") & F.col("anchor").isNull()
    rows = rows.withColumn("last", F.first(F.when(marks, F.col("anchor"))).over(inside)).withColumn("turn", F.sum(open_.cast("long")).over(inside))
    shift = F.coalesce((F.col("last") == F.col("first")).cast("long"), F.lit(0))
    later = F.when((F.col("turn") - 1 + shift) % 2 == 0, F.col("first")).otherwise(F.col("second"))
    turn = F.when(F.col("names") == 0, "UNKNOWN").when(F.col("names") == 1, F.col("first")).otherwise(later)
    return rows.where("quoted").select("book_id", "chunk_idx", "para", "cue_type", "anchor", F.coalesce("anchor", turn).alias("speaker"))


def dialogue_entries(paras: DataFrame, spoken: DataFrame) -> DataFrame:
    """(book_id, chunk_idx, para, part, speaker, text, instruct) of quoted paragraphs: speech runs and narration between them."""
    spans = quote_spans(paras.where(F.contains("text", F.lit('"'))))
    clean = spans.withColumn("text", F.when(F.col("is_speech"), F.col("text")).otherwise(S.strip_attribution(F.col("text")))).where("text <> ''")
    order = Window.partitionBy("book_id", "chunk_idx", "para").orderBy("pos")
    starts = ~F.col("is_speech") | ~F.coalesce(F.lag("is_speech").over(order), F.lit(False))
    parts = clean.withColumn("starts", starts.cast("long")).withColumn("part", F.sum("starts").over(order) - 1)
    joined = parts.groupBy("book_id", "chunk_idx", "para", "part", "is_speech").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("spans"))
    text = F.when(F.col("is_speech"), S.join_speech(F.transform("spans", lambda s: s["text"]))).otherwise(F.col("spans")[0]["text"])
    full = joined.join(spoken.select("book_id", "chunk_idx", "para", "speaker"), ["book_id", "chunk_idx", "para"])
    return full.select("book_id", "chunk_idx", "para", "part", F.when(F.col("is_speech"), F.col("speaker")).otherwise("NARRATOR").alias("speaker"), text.alias("text"), F.lit(NEUTRAL).alias("instruct"))


def dedupe_entries(entries: DataFrame, keys: tuple[str, ...] = ("book_id", "speaker", "text"), order: str = "entry_idx") -> DataFrame:
    """The first entry of each speaker and text in a book."""
    return entries.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def annotate(chunks: DataFrame, dedupe: bool = True) -> DataFrame:
    """Text chunks to entries (book_id, entry_idx, chunk_idx, speaker, text, instruct)."""
    clean = clean_chunks(chunks)
    paras, names = paragraphs_of(clean), roster(extract_names(clean))
    genders = gender_by_elimination(names, gender_first(gender_evidence(paras, names)))
    spoken = speakers(paras, cast_of(names, genders))
    both = structural_entries(paras).withColumn("part", F.lit(0).cast("long")).unionByName(dialogue_entries(paras, spoken))
    entry = F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_idx", "para", "part")) - 1
    entries = both.withColumn("entry_idx", entry.cast("long"))
    kept = dedupe_entries(entries) if dedupe else entries
    return kept.select("book_id", "entry_idx", "chunk_idx", "speaker", "text", "instruct")


def entry_report(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Per book: chunks, entries and whether the book came out empty, which a run should report as a failure."""
    made = entries.groupBy("book_id").agg(F.count("*").alias("entries"))
    given = chunks.groupBy("book_id").agg(F.countDistinct("chunk_idx").alias("chunks"))
    n = F.coalesce("entries", F.lit(0))
    return given.join(made, "book_id", "left").select("book_id", "chunks", n.alias("entries"), (n == 0).alias("is_empty"))


def apply_directions(entries: DataFrame, directions: DataFrame) -> DataFrame:
    """entries with the direction of their key (speaker and first 60 characters), if there is one; the last direction of a key wins.

    directions: book_id, chunk_idx, entry_idx, speaker, text, direction (null: none).
    """
    key = lambda: F.concat("speaker", F.lit("|"), F.substring("text", 1, 60))
    last = directions.where("direction is not null").groupBy("book_id", "chunk_idx", key().alias("key")).agg(F.max_by("direction", "entry_idx").alias("direction"))
    joined = entries.withColumn("key", key()).join(last, ["book_id", "chunk_idx", "key"], "left")
    return joined.withColumn("instruct", F.coalesce("direction", "instruct")).drop("key", "direction")
