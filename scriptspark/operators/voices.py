"""Which voice speaks each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptspark.functions import strings as S

STRUCTURAL = ["TITLE", "CHAPTER", "SECTION"]

# The voice palette.
NARRATOR_VOICE = ("male baritone, warm chest resonance, smooth slightly gravelly timbre", "measured, calm, authoritative")
PALETTE = [
    ("F", 0, "female mezzo-soprano, warm mid-range, smooth clear timbre, slight husky edge", "composed, direct, quietly emotional"),
    ("F", 1, "female contralto, deep rich chest voice, resonant and velvety timbre", "calm, deliberate, low and measured"),
    ("F", 2, "female soprano-adjacent, bright clear tone, light airy quality, precise articulation", "crisp, energetic, articulate"),
    ("F", 3, "female mezzo, slightly breathy timbre, warm and intimate, conversational register", "soft, thoughtful, understated"),
    ("M", 0, "male tenor, light bright tone, clear articulation, youthful quality", "earnest, expressive, forward"),
    ("M", 1, "male baritone, mid-low register, slightly rough textured timbre, grounded", "steady, dry, understated"),
    ("M", 2, "male bass-baritone, deep resonant chest voice, dark velvety timbre", "slow, deliberate, commanding"),
    ("M", 3, "male tenor-baritone, smooth warm mid-register, clean clear timbre", "conversational, relaxed, natural"),
]


def narrator_of(chunks: DataFrame) -> DataFrame:
    """(book_id, narrator): the first speaker who isn't a heading, else NARRATOR."""
    body = F.when(~F.col("speaker").isin(STRUCTURAL), F.col("chunk_idx"))
    return chunks.groupBy("book_id").agg(F.coalesce(F.min_by("speaker", body), F.lit("NARRATOR")).alias("narrator"))


def remap_structural(chunks: DataFrame) -> DataFrame:
    """chunks with voice_speaker: headings use the narrator's voice."""
    joined = chunks.join(narrator_of(chunks), "book_id")
    return joined.withColumn("voice_speaker", F.when(F.col("speaker").isin(STRUCTURAL), F.col("narrator")).otherwise(F.col("speaker"))).drop("narrator")


def speaker_styles(chunks: DataFrame) -> DataFrame:
    """(book_id, speaker, style, speaker_order): each voice with its first direction that isn't empty, sorted by name."""
    body = F.when(~F.col("speaker").isin(STRUCTURAL) & (F.col("instruct") != ""), F.col("chunk_idx"))
    styles = remap_structural(chunks).groupBy("book_id", "voice_speaker").agg(F.coalesce(F.min_by("instruct", body), F.lit("")).alias("style"))
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("voice_speaker")) - 1
    return styles.select("book_id", F.col("voice_speaker").alias("speaker"), "style", order.cast("long").alias("speaker_order"))


def voice_profile(speakers: DataFrame) -> DataFrame:
    """speakers (…, speaker, style, speaker_order) with voice, voice_style and voice_instruction.

    The palette has eight rows; the index is taken from the name's hash and the speaker's place. A
    literal description is its own voice, with its own style.
    """
    spark = speakers.sparkSession
    palette = spark.createDataFrame(PALETTE, "gender string, slot int, palette_voice string, palette_style string")
    name = F.col("speaker")
    slot = ((F.col("speaker_order") + S.hash31(name, 4)) % 4).cast("int")
    known = speakers.withColumns({"gender": S.name_gender(name), "slot": slot}).join(F.broadcast(palette), ["gender", "slot"])
    fixed, literal = name.isin("NARRATOR", "UNKNOWN"), S.literal_voice(name)
    voiced = known.withColumns({
        "voice": F.when(literal, name).when(fixed, NARRATOR_VOICE[0]).otherwise(F.col("palette_voice")),
        "voice_style": F.when(literal, F.col("style")).when(fixed, NARRATOR_VOICE[1]).otherwise(F.col("palette_style")),
    })
    return voiced.drop("gender", "slot", "palette_voice", "palette_style").withColumn("voice_instruction", S.voice_instruction(F.col("voice"), F.col("voice_style")))
