"""Queries of the name, gender and dialogue operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptspark.functions import strings as S
from scriptspark.operators import dialogue as D
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


# Spark ---------------------------------------------------------------------


def clean(spark, sf_dir):
    return D.clean_chunks(D.chunk_texts(X.scenes(spark, sf_dir)))


def prepared(spark, sf_dir):
    """(paragraphs, roster, genders)."""
    c = clean(spark, sf_dir)
    paras, names = D.paragraphs_of(c), D.roster(D.extract_names(c))
    return paras, names, D.gender_by_elimination(names, D.gender_first(D.gender_evidence(paras, names)))


def spoken(spark, sf_dir):
    paras, names, genders = prepared(spark, sf_dir)
    return paras, D.speakers(paras, D.cast_of(names, genders))


# DuckDB --------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in D.STOP_WORDS)
CLEAN = r""", ck as (select book_id, chunk_idx, string_agg(text, chr(10) || chr(10) order by para_idx) as text from fx_scene group by book_id, chunk_idx),
cl as (select book_id, chunk_idx, regexp_replace(regexp_replace(text, '\*{1,3}([^*]+)\*{1,3}', '\1', 'g'), '_{1,2}([^_]+)_{1,2}', '\1', 'g') as text from ck)"""
NAMES = CLEAN + f""", n0 as (select book_id, chunk_idx, unnest(list_concat(regexp_extract_all(text, '{D._FORWARD_NAME}', 1), list_filter(regexp_extract_all(text, '{D._INVERTED_NAME}', 1), lambda x: regexp_matches(x, '^[A-Z]')),
 regexp_extract_all(text, '{D._ACTION_NAME}', 1), list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(trim(x), '{D._QUOTED_NAME}', 1)), lambda x: x <> ''))) as n from cl),
nm as (select distinct book_id, chunk_idx, upper(n) as name from n0 where upper(n) not in ({_STOP}))"""
ROSTER = NAMES + """, r0 as (select book_id, name, min(chunk_idx) as first_chunk from nm group by book_id, name),
ro as (select *, row_number() over (partition by book_id order by first_chunk, name) - 1 as rank from r0)"""
PARAS = """, p0 as (select book_id, chunk_idx, cast(generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 as bigint) as para, trim(unnest(string_split(text, chr(10) || chr(10)))) as text from cl),
pa as (select * from p0 where text <> '')"""
EVIDENCE = ROSTER + PARAS + f""", e1 as (select book_id, chunk_idx, para, 1 as rule, generate_subscripts(regexp_extract_all(text, '{D._NAME_PRONOUN}', 1), 1) - 1 as pos, upper(unnest(regexp_extract_all(text, '{D._NAME_PRONOUN}', 1))) as name, unnest(regexp_extract_all(text, '{D._PRONOUN_OF_NAME}', 1)) as p from pa),
hs as (select *, case when regexp_matches(text, '{D._HE}') and not regexp_matches(text, '{D._SHE}') then 'M' when regexp_matches(text, '{D._SHE}') and not regexp_matches(text, '{D._HE}') then 'F' end as g from pa),
e2 as (select book_id, chunk_idx, para, 2 as rule, generate_subscripts(regexp_extract_all(text, '{D._NAMED}', 1), 1) - 1 as pos, unnest(regexp_extract_all(text, '{D._NAMED}', 1)) as n, g from hs),
e3 as (select book_id, chunk_idx, para, 3 as rule, generate_subscripts(regexp_extract_all(text, '{D._INVERTED_NAME}', 1), 1) - 1 as pos, unnest(regexp_extract_all(text, '{D._INVERTED_NAME}', 1)) as n, g from hs),
e4 as (select book_id, chunk_idx, para, rule, pos, name, case when lower(p) = 'he' then 'M' else 'F' end as gender from e1 union all select book_id, chunk_idx, para, rule, pos, upper(n), g from e2 where g is not null
 union all select book_id, chunk_idx, para, rule, pos, upper(n), g from e3 where g is not null and regexp_matches(n, '^[A-Z]')),
ev as (select e4.book_id, chunk_idx, para, rule, cast(pos as int) as pos, name, gender from e4 join ro using (book_id, name) where first_chunk <= chunk_idx),
gf as (select book_id, name, arg_min(gender, struct_pack(a := chunk_idx, b := para, c := rule, d := pos)) as gender, min(chunk_idx) as from_chunk from ev group by book_id, name)"""
GENDERS = EVIDENCE + """, c0 as (select book_id, first_chunk as chunk_idx, 1 as n, 0 as m, 0 as f from ro union all select book_id, from_chunk, 0, cast(gender = 'M' as int), cast(gender = 'F' as int) from gf),
c1 as (select distinct book_id, chunk_idx, sum(n) over w as n, sum(m) over w as m, sum(f) over w as f from c0 window w as (partition by book_id order by chunk_idx range between unbounded preceding and current row)),
ht as (select book_id, min(chunk_idx) as at_chunk, arg_min(case when m > 0 then 'F' else 'M' end, chunk_idx) as other from c1 where n - m - f = 1 and ((m > 0 and f = 0) or (f > 0 and m = 0)) group by book_id),
g0 as (select ro.book_id, ro.name, rank, first_chunk, gender as own, from_chunk as since, at_chunk, other, coalesce(first_chunk <= at_chunk and (from_chunk is null or from_chunk > at_chunk), false) as eliminated from ro left join gf using (book_id, name) left join ht using (book_id)),
gd as (select book_id, name, rank, first_chunk, case when eliminated then other else own end as gender, case when eliminated then at_chunk else since end as from_chunk, eliminated from g0)"""
CUES = GENDERS + rf""", ca as (select book_id, list(struct_pack(name := name, first_chunk := first_chunk, gender := gender, from_chunk := from_chunk) order by rank) as cst from gd group by book_id),
q0 as (select book_id, chunk_idx, para, text, list_filter(coalesce(cst, []), lambda x: x.first_chunk <= chunk_idx) as cst from pa left join ca using (book_id) where contains(text, '"')),
q1 as (select *, list_transform(cst, lambda x: x.name) as roster from q0),
s0 as (select book_id, chunk_idx, para, generate_subscripts(string_split(text, '"'), 1) - 1 as pos, trim(unnest(string_split(text, '"'))) as t, roster from q1),
s1 as (select *, regexp_extract(t, '{S.FORWARD}', 1) as fw, regexp_extract(t, '{S.INVERTED}', 1) as iv, list_filter(list_transform(string_split_regex(t, '\s+'), lambda w: upper(regexp_replace(w, '[^\p{{L}}]+$', ''))), lambda w: list_contains(roster, w))[1] as bt from s0 where pos % 2 = 0),
s2 as (select *, case when fw <> '' then 'forward' when regexp_matches(iv, '^[A-Z]') then 'inverted' when bt is not null then 'beat' end as type from s1),
s3 as (select book_id, chunk_idx, para, arg_min(type, pos) as cue_type, arg_min(case type when 'forward' then upper(fw) when 'inverted' then upper(iv) else bt end, pos) as cue_name from s2 where type is not null group by all),
cu as (select q1.*, cue_type, cue_name from q1 left join s3 using (book_id, chunk_idx, para)),
an as (select *, case cue_type when 'forward' then case cue_name when 'HE' then case when len(roster) = 0 then 'HE' else list_filter(cst, lambda x: x.gender = 'M' and x.from_chunk <= chunk_idx)[1].name end
  when 'SHE' then case when len(roster) = 0 then 'SHE' else list_filter(cst, lambda x: x.gender = 'F' and x.from_chunk <= chunk_idx)[1].name end when 'THEY' then null when 'IT' then null else cue_name end
  when 'inverted' then case when list_contains(roster, cue_name) then cue_name end when 'beat' then cue_name end as anchor from cu)"""
SPEAKERS = CUES + """, w0 as (select book_id, chunk_idx, para, roster, cue_type, anchor, true as quoted from an union all select book_id, chunk_idx, para, null, null, null, false from pa where not contains(text, '"')),
w1 as (select *, (not quoted) or (anchor is not null and anchor <> 'NARRATOR') as marks from w0),
w2 as (select *, sum(cast(marks as int)) over (partition by book_id, chunk_idx order by para) as grp from w1),
w3 as (select *, first_value(case when marks then anchor end) over w as last, sum(cast(quoted and anchor is null as int)) over w as turn from w2 window w as (partition by book_id, chunk_idx, grp order by para)),
sp as (select book_id, chunk_idx, para, cue_type, anchor, coalesce(anchor, case when len(roster) = 0 then 'UNKNOWN' when len(roster) = 1 then roster[1] else roster[cast((turn - 1 + coalesce(cast(last = roster[1] as int), 0)) % 2 as int) + 1] end) as speaker from w3 where quoted)"""
_OPEN_F, _OPEN_I = (p.replace(r"(?i)\b", r"(?i)^", 1) for p in (S.FORWARD, S.INVERTED))


def _strip(x: str) -> str:
    cut = lambda p: rf"trim(regexp_replace({x}, '{p}[^.]*(?:\.|\z)\s*', ''))"
    return f"case when regexp_matches({x}, '{_OPEN_F}') then {cut(_OPEN_F)} when regexp_matches({x}, '{_OPEN_I}') then {cut(_OPEN_I)} else {x} end"


_BARE = "trim(regexp_replace(trim(x), ',+$', ''))"
ENTRIES = SPEAKERS + f""", d0 as (select book_id, chunk_idx, para, pos, pos % 2 = 1 as is_speech, case when pos % 2 = 1 then t else {_strip('t')} end as t from s0),
d1 as (select *, case when not is_speech or not coalesce(lag(is_speech) over w, false) then 1 else 0 end as starts from d0 where t <> '' window w as (partition by book_id, chunk_idx, para order by pos)),
d2 as (select *, sum(starts) over (partition by book_id, chunk_idx, para order by pos) - 1 as part from d1),
d3 as (select book_id, chunk_idx, para, part, is_speech, list(t order by pos) as ts from d2 group by all),
d4 as (select book_id, chunk_idx, para, cast(part as bigint) as part, case when is_speech then speaker else 'NARRATOR' end as speaker,
 case when is_speech then trim(array_to_string(list_transform(ts, lambda x, i: case when i = len(ts) then {_BARE} when ends_with(trim(x), ',') then {_BARE} || '. ' else trim(x) || ' ' end), '')) else ts[1] end as text, 'Neutral, even narration.' as instruct from d3 join sp using (book_id, chunk_idx, para)),
st as (select book_id, chunk_idx, para, case when regexp_matches(text, '^@@(TITLE|CHAPTER|SECTION): ') then regexp_extract(text, '^@@(TITLE|CHAPTER|SECTION): ', 1) else 'NARRATOR' end as speaker, trim(regexp_replace(text, '^@@(TITLE|CHAPTER|SECTION): ', '')) as text,
 case regexp_extract(text, '^@@(TITLE|CHAPTER|SECTION): ', 1) when 'TITLE' then 'Slow, atmospheric.' when 'CHAPTER' then 'Measured, clear chapter announcement.' else 'Neutral, even narration.' end as instruct from pa where not contains(text, '"'))"""
_FX = ("fx_prose", "fx_scene")


@query(with_duck(r""" select book_id, para_idx, regexp_replace(regexp_replace(concat('**', text, '** _x_'), '\*{1,3}([^*]+)\*{1,3}', '\1', 'g'), '_{1,2}([^_]+)_{1,2}', '\1', 'g') as text from fx_prose""", *_FX))
def strip_emphasis(spark, sf_dir):
    return X.prose(spark, sf_dir).select("book_id", "para_idx", S.strip_emphasis(F.concat(F.lit("**"), "text", F.lit("** _x_"))).alias("text"))


@query(with_duck(NAMES + " select * from nm", *_FX))
def extract_names(spark, sf_dir):
    return D.extract_names(clean(spark, sf_dir))


@query(with_duck(ROSTER + " select * from ro", *_FX))
def roster(spark, sf_dir):
    return D.roster(D.extract_names(clean(spark, sf_dir)))


@query(with_duck(EVIDENCE + " select * from ev", *_FX))
def gender_evidence(spark, sf_dir):
    paras, names, _ = prepared(spark, sf_dir)
    return D.gender_evidence(paras, names)


@query(with_duck(EVIDENCE + " select * from gf", *_FX))
def gender_first(spark, sf_dir):
    paras, names, _ = prepared(spark, sf_dir)
    return D.gender_first(D.gender_evidence(paras, names))


@query(with_duck(GENDERS + " select book_id, name, gender, from_chunk, eliminated from gd where gender is not null", *_FX))
def gender_final(spark, sf_dir):
    return prepared(spark, sf_dir)[2]


@query(with_duck(CLEAN + PARAS + """ select book_id, chunk_idx, para, cast(generate_subscripts(string_split(text, '"'), 1) - 1 as bigint) as pos, (generate_subscripts(string_split(text, '"'), 1) - 1) % 2 = 1 as is_speech, trim(unnest(string_split(text, '"'))) as text from pa""", *_FX))
def quote_spans(spark, sf_dir):
    return D.quote_spans(D.paragraphs_of(clean(spark, sf_dir)))


@query(with_duck(ENTRIES + " select * from st", *_FX))
def structural_entries(spark, sf_dir):
    return D.structural_entries(D.paragraphs_of(clean(spark, sf_dir)))


@query(with_duck(CUES + " select book_id, chunk_idx, para, cue_type, cue_name from cu", *_FX))
def attribution_cue(spark, sf_dir):
    paras, names, genders = prepared(spark, sf_dir)
    return D.attribution_cues(paras, D.cast_of(names, genders)).select("book_id", "chunk_idx", "para", F.col("cue.type").alias("cue_type"), F.col("cue.name").alias("cue_name"))


@query(with_duck(CUES + " select book_id, chunk_idx, para, cue_name, anchor from an where cue_name in ('HE','SHE','THEY','IT')", *_FX))
def resolve_pronoun(spark, sf_dir):
    paras, names, genders = prepared(spark, sf_dir)
    settled = D.resolve_cues(D.attribution_cues(paras, D.cast_of(names, genders)))
    return settled.where(F.col("cue.name").isin("HE", "SHE", "THEY", "IT")).select("book_id", "chunk_idx", "para", F.col("cue.name").alias("cue_name"), "anchor")


@query(with_duck(SPEAKERS + " select book_id, chunk_idx, para, speaker from sp where anchor is null", *_FX))
def alternate_speaker(spark, sf_dir):
    return spoken(spark, sf_dir)[1].where("anchor is null").select("book_id", "chunk_idx", "para", "speaker")


@query(with_duck(SPEAKERS + " select * from sp", *_FX))
def speakers(spark, sf_dir):
    return spoken(spark, sf_dir)[1]


@query(with_duck(ENTRIES + f" select book_id, chunk_idx, para, cast(pos as bigint) as pos, {_strip('t')} as text from s0 where pos % 2 = 0", *_FX))
def strip_attribution(spark, sf_dir):
    spans = D.quote_spans(D.paragraphs_of(clean(spark, sf_dir)).where(F.contains("text", F.lit('"'))))
    return spans.where("not is_speech").select("book_id", "chunk_idx", "para", "pos", S.strip_attribution(F.col("text")).alias("text"))


@query(with_duck(f""", t0 as (select conv_id, list(concat(text, case when turn % 2 = 0 then ',' else '.' end) order by turn) as ts from conversations group by conv_id)
 select conv_id, trim(array_to_string(list_transform(ts, lambda x, i: case when i = len(ts) then {_BARE} when ends_with(trim(x), ',') then {_BARE} || '. ' else trim(x) || ' ' end), '')) as speech from t0""", *_FX))
def join_speech(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.struct("turn", F.concat("text", F.when(F.col("turn") % 2 == 0, ",").otherwise(".")).alias("t")).alias("s"))
    ordered = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("conv_id", S.join_speech(F.transform("s", lambda s: s["t"])).alias("speech"))


@query(with_duck(ENTRIES + " select * from d4", *_FX))
def dialogue_entries(spark, sf_dir):
    paras, who = spoken(spark, sf_dir)
    return D.dialogue_entries(paras, who)


@query(with_duck(" select book_id, cast(entry_idx as bigint) as entry_idx, speaker, text from fx_script qualify row_number() over (partition by book_id, speaker, text order by entry_idx) = 1", "fx_script"))
def dedupe_entries(spark, sf_dir):
    return D.dedupe_entries(X.script(spark, sf_dir).select("book_id", "entry_idx", "speaker", "text"))


@query(with_duck(ENTRIES + """, al as (select book_id, chunk_idx, para, part, speaker, text, instruct from d4 union all select book_id, chunk_idx, para, 0, speaker, text, instruct from st),
 nb as (select *, row_number() over (partition by book_id order by chunk_idx, para, part) - 1 as entry_idx from al)
 select book_id, entry_idx, chunk_idx, speaker, text, instruct from nb qualify row_number() over (partition by book_id, speaker, text order by entry_idx) = 1""", *_FX))
def annotate(spark, sf_dir):
    return D.annotate(D.chunk_texts(X.scenes(spark, sf_dir)))


_REPORT = """, al as (select book_id from d4 union all select book_id from st), en as (select book_id, count(*) as n from al group by book_id)
 select book_id, count(distinct chunk_idx) as chunks, coalesce(any_value(n), 0) as entries, coalesce(any_value(n), 0) = 0 as is_empty
 from fx_scene left join en using (book_id) group by book_id"""


@query(with_duck(ENTRIES + _REPORT, *_FX))
def entry_report(spark, sf_dir):
    chunks = D.chunk_texts(X.scenes(spark, sf_dir))
    return D.entry_report(chunks, D.annotate(chunks, dedupe=False))
