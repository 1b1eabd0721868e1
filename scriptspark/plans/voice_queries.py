"""Queries of the voice and direction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptspark.functions import strings as S
from scriptspark.operators import dialogue as D
from scriptspark.operators import voices as V
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


def chunks(spark, sf_dir):
    """Script lines taken as chunks; every third has no direction."""
    return X.script(spark, sf_dir).select("book_id", F.col("entry_idx").alias("chunk_idx"), "speaker", "text", F.when(F.col("entry_idx") % 3 == 0, "").otherwise(F.concat(F.lit("style "), F.col("entry_idx") % 5)).alias("instruct"))


CHUNKS = ", ck as (select book_id, cast(entry_idx as bigint) as chunk_idx, speaker, text, case when entry_idx % 3 = 0 then '' else concat('style ', entry_idx % 5) end as instruct from fx_script)"
NARRATOR = CHUNKS + ", nr as (select book_id, coalesce(arg_min(speaker, chunk_idx) filter (where speaker not in ('TITLE','CHAPTER','SECTION')), 'NARRATOR') as narrator from ck group by book_id)"
VOICES = NARRATOR + ", vs as (select ck.*, case when speaker in ('TITLE','CHAPTER','SECTION') then narrator else speaker end as voice_speaker from ck join nr using (book_id))"
STYLES = VOICES + """, sy as (select book_id, voice_speaker as speaker, coalesce(arg_min(instruct, chunk_idx) filter (where speaker not in ('TITLE','CHAPTER','SECTION') and instruct <> ''), '') as style,
 row_number() over (partition by book_id order by voice_speaker) - 1 as speaker_order from vs group by book_id, voice_speaker)"""


@query(with_duck(NARRATOR + " select * from nr", "fx_script"))
def narrator(spark, sf_dir):
    return V.narrator_of(chunks(spark, sf_dir))


@query(with_duck(VOICES + " select book_id, chunk_idx, speaker, voice_speaker from vs", "fx_script"))
def voice_speaker(spark, sf_dir):
    return V.remap_structural(chunks(spark, sf_dir)).select("book_id", "chunk_idx", "speaker", "voice_speaker")


@query(with_duck(STYLES + " select * from sy", "fx_script"))
def speaker_styles(spark, sf_dir):
    return V.speaker_styles(chunks(spark, sf_dir))


def names(spark, sf_dir):
    """Names of many forms: customers, suppliers' nations, words of documents."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", r"\s+")).alias("speaker"))
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("speaker"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("speaker"))
    fixed = nations.select(F.explode(F.array(*map(F.lit, [*(n.upper() for n in S.FEMALE_NAMES), "NARRATOR", "UNKNOWN", *S.NAMED_SPEAKERS, "female alto, warm", "A very long name of a speaker, longer than a slug"]))).alias("speaker"))
    return words.unionByName(people).unionByName(nations).unionByName(fixed).where("speaker <> ''").distinct()


_FIXED = ", ".join(f"('{n}')" for n in [*(n.upper() for n in S.FEMALE_NAMES), "NARRATOR", "UNKNOWN", *S.NAMED_SPEAKERS, "female alto, warm", "A very long name of a speaker, longer than a slug"])
NAMES = rf"with recursive nm as (select distinct speaker from (select unnest(string_split_regex(text, '\s+')) as speaker from documents union all select c_name from customer union all select n_name from nation union all select * from (values {_FIXED}) v(speaker)) where speaker <> '')"
_FEMALE = ", ".join(f"'{n}'" for n in S.FEMALE_NAMES)
_GENDER = f"case when regexp_replace(lower(speaker), '_+$', '') in ({_FEMALE}) or regexp_matches(regexp_replace(lower(speaker), '_+$', ''), '(a|ine|elle|ette)$') then 'F' else 'M' end"
_BYTES = "list_transform(range(0, strlen(speaker)), lambda i: cast(concat('0x', substring(hex(encode(speaker)), cast(2 * i + 1 as bigint), 2)) as bigint))"


def _hash31(modulus: int) -> str:
    # a hugeint holds 2^64 * 31; the last step takes the palette's remainder
    return f"cast(list_reduce(list_concat([cast(0 as hugeint)], list_transform({_BYTES}, lambda b: cast(b as hugeint))), lambda a, b: (a * 31 + b) % 18446744073709551616) % {modulus} as int)"


@query(NAMES + f" select speaker, {_GENDER} as gender from nm")
def name_gender(spark, sf_dir):
    return names(spark, sf_dir).select("speaker", S.name_gender(F.col("speaker")).alias("gender"))


_SPEAKERS = ", ".join(f"'{n}'" for n in S.NAMED_SPEAKERS)


@query(NAMES + f" select speaker, case when lower(speaker) in ({_SPEAKERS}) then lower(speaker) else list_extract([{_SPEAKERS}], {_hash31(9)} + 1) end as named from nm")
def named_speaker(spark, sf_dir):
    return names(spark, sf_dir).select("speaker", S.named_speaker(F.col("speaker")).alias("named"))


@query(NAMES + r" select speaker, regexp_matches(speaker, '[,\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') as literal from nm")
def literal_voice(spark, sf_dir):
    return names(spark, sf_dir).select("speaker", S.literal_voice(F.col("speaker")).alias("literal"))


@query(NAMES + r" select speaker, case when strlen(regexp_replace(lower(speaker), '[^\p{L}\p{N}]', '_', 'g')) <= 32 then regexp_replace(lower(speaker), '[^\p{L}\p{N}]', '_', 'g') else concat(substring(regexp_replace(lower(speaker), '[^\p{L}\p{N}]', '_', 'g'), 1, 32), '_', substring(md5(speaker), 1, 16)) end as slug from nm")
def speaker_slug(spark, sf_dir):
    return names(spark, sf_dir).select("speaker", S.speaker_slug(F.col("speaker")).alias("slug"))


_PALETTE = ", ".join(f"('{g}', {i}, '{v}', '{s}')" for g, i, v, s in V.PALETTE)


@query(NAMES + f""", od as (select speaker, length(speaker) % 7 as speaker_order from nm), sl as (select speaker, {_GENDER} as gender, cast((speaker_order + {_hash31(4)}) % 4 as int) as slot from od),
 vo as (select speaker, case when regexp_matches(speaker, '[,\\s]') then speaker when speaker in ('NARRATOR','UNKNOWN') then '{V.NARRATOR_VOICE[0]}' else p.voice end as voice,
 case when regexp_matches(speaker, '[,\\s]') then 'own' when speaker in ('NARRATOR','UNKNOWN') then '{V.NARRATOR_VOICE[1]}' else p.style end as voice_style from sl join (values {_PALETTE}) p(gender, slot, voice, style) using (gender, slot))
 select speaker, voice, voice_style, concat(voice, ', ', voice_style) as voice_instruction from vo""")
def voice_profile(spark, sf_dir):
    order = (F.length("speaker") % 7).cast("long")
    return V.voice_profile(names(spark, sf_dir).withColumns({"style": F.lit("own"), "speaker_order": order})).select("speaker", "voice", "voice_style", "voice_instruction")


# Directions ----------------------------------------------------------------


def answers(spark, sf_dir):
    """Script lines with a model's raw answer: some labelled, some quoted, some echoes, some too short."""
    k = F.col("entry_idx") % 6
    text = F.col("text")
    raw = (
        F.when(k == 0, F.concat(F.lit("[NARRATOR]: Slow and "), F.substring(text, 1, 5), F.lit(". More.")))
        .when(k == 1, F.concat(F.lit('  "('), F.lit("Flat surprise! Then calm.")))
        .when(k == 2, F.concat(F.lit("echo "), text))
        .when(k == 3, F.lit("ok"))
        .when(k == 4, F.concat(F.lit("Pacing: "), F.repeat(F.substring(text, 1, 9), 12)))
        .otherwise(F.lit("Steady, dry"))
    )
    return X.script(spark, sf_dir).withColumn("raw", raw)


ANSWERS = """, an as (select *, case entry_idx % 6 when 0 then concat('[NARRATOR]: Slow and ', substring(text, 1, 5), '. More.') when 1 then '  "(Flat surprise! Then calm.' when 2 then concat('echo ', text)
 when 3 then 'ok' when 4 then concat('Pacing: ', repeat(substring(text, 1, 9), 12)) else 'Steady, dry' end as raw from fx_script),
d1 as (select *, regexp_replace(regexp_replace(trim(regexp_replace(trim(raw), '(?i)^(?:\\[[^\\]]*\\]|[A-Z][A-Za-z ]{0,20}):\\s*', '')), '^[\\[\\]()"''`\\s]+(\\S)', '\\1'), '^[\\[("''`]+', '') as bare from an),
d2 as (select *, trim(substring(regexp_extract(bare, '^[^.!?]*[.!?]?'), 1, 80)) as fst from d1),
dr as (select *, case when not contains(trim(raw), substring(text, 1, 30)) and strlen(fst) >= 4 then fst end as direction from d2)"""


@query(with_duck("select book_id, cast(entry_idx as bigint) as entry_idx, concat('[', speaker, '] ', substring(text, 1, 80)) as prompt from fx_script", "fx_script"))
def direction_prompt(spark, sf_dir):
    return X.script(spark, sf_dir).select("book_id", "entry_idx", S.direction_prompt(F.col("speaker"), F.col("text")).alias("prompt"))


@query(with_duck(ANSWERS + " select book_id, cast(entry_idx as bigint) as entry_idx, direction from dr", "fx_script"))
def clean_direction(spark, sf_dir):
    return answers(spark, sf_dir).select("book_id", "entry_idx", S.clean_direction(F.col("raw"), F.col("text")).alias("direction"))


@query(with_duck(ANSWERS + """, ls as (select book_id, entry_idx // 10 as chunk_idx, concat(speaker, '|', substring(text, 1, 60)) as key, arg_max(direction, entry_idx) as direction from dr where direction is not null group by all)
 select e.book_id, cast(e.entry_idx as bigint) as entry_idx, e.speaker, e.text, coalesce(ls.direction, e.instruct) as instruct from fx_script e left join ls on ls.book_id = e.book_id and ls.chunk_idx = e.entry_idx // 10 and ls.key = concat(e.speaker, '|', substring(e.text, 1, 60))""", "fx_script"))
def apply_directions(spark, sf_dir):
    entries = answers(spark, sf_dir).withColumn("chunk_idx", F.expr("entry_idx div 10"))
    given = entries.withColumn("direction", S.clean_direction(F.col("raw"), F.col("text")))
    return D.apply_directions(entries, given).select("book_id", "entry_idx", "speaker", "text", "instruct")
