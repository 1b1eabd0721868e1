"""Queries of the Markdown, packing and script operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptspark.functions import strings as S
from scriptspark.operators import markdown as M
from scriptspark.operators import packing as P
from scriptspark.plans import fixtures as X
from scriptspark.plans.fixtures import with_duck
from scriptspark.sources import files
from scriptspark.storage import drop_since, spread, stored_so_far

QUERIES, ORACLE = {}, {}

#: Unicode white space, written out for DuckDB.
_WHITE = r"\t\n\x{0B}\f\r \x{0085}\x{00A0}\x{1680}\x{2000}\x{2001}\x{2002}\x{2003}\x{2004}\x{2005}\x{2006}\x{2007}\x{2008}\x{2009}\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def white(sql: str) -> str:
    """sql whose patterns' white space is Unicode's, and whose trims of `text` take it off."""
    sql = sql.replace("trim(text)", r"regexp_replace(text, '^\s+|\s+$', '', 'g')")
    return sql.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def doc_lines(spark, sf_dir):
    """(doc_id, line_idx, text): the lines of documents, as paragraphs."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text")).withColumn("line_idx", F.col("line_idx").cast("long"))


LINES = "with recursive doc_lines as (select doc_id, unnest(string_split(text, chr(10))) as text, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as bigint) as line_idx from documents)"


# Script --------------------------------------------------------------------


@query(with_duck("select book_id, cast(entry_idx as bigint) as entry_idx, speaker, text, case when entry_idx % 2 = 0 then 'Flat.' else instruct end as instruct from fx_script", "fx_script"))
def script_default_instruct(spark, sf_dir):
    entries = X.script(spark, sf_dir).withColumn("instruct", F.when(F.col("entry_idx") % 2 == 0, "Flat."))
    return files.parse_script(files.script_json(entries), "script")


@query(with_duck(white("""select book_id, cast(entry_idx as bigint) as entry_idx, trim(text) <> '' and not regexp_matches(trim(text), '[.!?…"''”’]$') and strlen(trim(text)) < 120 as heading from fx_script"""), "fx_script"))
def heading_like(spark, sf_dir):
    return X.script(spark, sf_dir).select("book_id", "entry_idx", S.heading_like(F.col("text")).alias("heading"))


@query(with_duck("select book_id, cast(entry_idx as bigint) as entry_idx, case when strlen(text) > 80 then concat(substring(text, 1, 80), '…') else text end as preview from fx_script", "fx_script"))
def preview(spark, sf_dir):
    return X.script(spark, sf_dir).select("book_id", "entry_idx", S.preview(F.col("text")).alias("preview"))


RUNS = white(""", hd as (select *, trim(text) <> '' and not regexp_matches(trim(text), '[.!?…"''”’]$') and strlen(trim(text)) < 120 as head from fx_script),
st as (select *, case when lag(speaker) over w is null or lag(speaker) over w <> speaker or lag(instruct) over w <> instruct or lag(head) over w or head then 1 else 0 end as starts from hd window w as (partition by book_id order by entry_idx)),
rn as (select *, cast(sum(starts) over (partition by book_id order by entry_idx) - 1 as bigint) as run from st)""")

CAPPED = RUNS + """, nx as (select *, row_number() over (partition by book_id, run order by entry_idx) as i from rn),
pk as (select book_id, run, i, strlen(text) as cur, 0 as pack from nx where i = 1
  union all select n.book_id, n.run, n.i, case when p.cur + 1 + strlen(n.text) > 500 then strlen(n.text) else p.cur + 1 + strlen(n.text) end, case when p.cur + 1 + strlen(n.text) > 500 then p.pack + 1 else p.pack end
  from pk p join nx n on n.book_id = p.book_id and n.run = p.run and n.i = p.i + 1),
ck as (select n.book_id, n.run, p.pack, min(n.speaker) as speaker, min(n.instruct) as instruct, string_agg(n.text, ' ' order by n.entry_idx) as text, count(*) as n_entries from nx n join pk p using (book_id, run, i) group by all)"""


@query(with_duck(RUNS + " select book_id, cast(entry_idx as bigint) as entry_idx, run from rn", "fx_script"))
def speaker_runs(spark, sf_dir):
    return P.speaker_runs(X.script(spark, sf_dir)).select("book_id", "entry_idx", "run")


@query(with_duck(CAPPED + " select book_id, row_number() over (partition by book_id order by run, pack) - 1 as chunk_idx, speaker, text, instruct, n_entries from ck", "fx_script", recursive=True))
def speaker_chunks(spark, sf_dir):
    return P.group_by_speaker(X.script(spark, sf_dir))


# Markdown ------------------------------------------------------------------

_DUCK_KIND = f"""case when fence then 'FENCE' when fences % 2 = 1 then 'CODE' when blank then 'BLANK' when regexp_matches(opens, '{M.HTML}') then 'HTML'
 when regexp_matches(line, '{M.HEADING}') and length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)) = 1 then 'TITLE'
 when regexp_matches(line, '{M.HEADING}') and length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)) <= 3 then 'CHAPTER' when regexp_matches(line, '{M.HEADING}') then 'SECTION'
 when regexp_matches(line, '{M.RULE}') then 'RULE' when regexp_matches(line, '{M.ITEM}') then 'ITEM' when regexp_matches(line, '{M.QUOTE}') then 'QUOTE' else 'TEXT' end"""
KINDS = f""", f0 as (select *, regexp_matches(line, '{M.FENCE}') as fence, trim(line) = '' as blank from fx_md),
f1 as (select *, sum(cast(fence as int)) over w as fences, sum(cast(blank as int)) over w as blanks from f0 window w as (partition by book_id order by line_idx)),
f2 as (select *, first_value(case when not blank then line end ignore nulls) over (partition by book_id, blanks order by line_idx rows between unbounded preceding and current row) as opens from f1),
kd as (select book_id, cast(line_idx as bigint) as line_idx, line, {_DUCK_KIND} as kind from f2)"""


def _duck_inline(x: str) -> str:
    for pattern, to in S.INLINE_RULES:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return x


_HEAD_TEXT = r"regexp_replace(regexp_replace(line, '^ {0,3}#{1,6}\s*', ''), '\s+#+\s*$', '')"
PARAS = KINDS + f""", s0 as (select *, kind in ('TITLE','CHAPTER','SECTION') as head, lag(kind) over w as prev, lag(regexp_matches(line, '{M.HARD_BREAK}')) over w as broke from kd window w as (partition by book_id order by line_idx)),
s1 as (select *, sum(case when prev is null or prev not in ('TEXT','ITEM','QUOTE') or head or kind = 'ITEM' or broke then 1 else 0 end) over (partition by book_id order by line_idx) as island,
  case when head then {_HEAD_TEXT} else regexp_replace(regexp_replace(regexp_replace(line, '{M.ITEM}', ''), '{M.QUOTE}', ''), '\\\\$', '') end as clean from s0),
s2 as (select book_id, island, coalesce(min(case when head then kind end), 'BODY') as kind, coalesce(string_agg(case when trim(clean) <> '' then trim(clean) end, ' ' order by line_idx), '') as text
  from s1 where kind in ('TITLE','CHAPTER','SECTION','TEXT','ITEM','QUOTE') group by book_id, island),
s3 as (select book_id, island, kind, trim({_duck_inline('text')}) as text from s2),
pg as (select book_id, row_number() over (partition by book_id order by island) - 1 as para_idx, kind, text from s3 where text <> '')"""


@query(with_duck(KINDS + f" select book_id, line_idx, kind, {_duck_inline('trim(' + _HEAD_TEXT + ')')} as text from kd where kind in ('TITLE','CHAPTER','SECTION')", "fx_md"))
def md_headings(spark, sf_dir):
    return M.headings(X.markdown(spark, sf_dir))


@query(with_duck(KINDS + " select book_id, line_idx, line, kind from kd where kind not in ('FENCE','CODE','HTML')", "fx_md"))
def md_drop_code(spark, sf_dir):
    return M.drop_code_and_html(X.markdown(spark, sf_dir))


@query(with_duck(PARAS + " select * from pg", "fx_md"))
def md_blocks(spark, sf_dir):
    return M.assemble_paragraphs(X.markdown(spark, sf_dir))


@query(with_duck(f"select book_id, cast(line_idx as bigint) as line_idx, {_duck_inline('line')} as text from fx_md", "fx_md"))
def md_strip_inline(spark, sf_dir):
    return X.markdown(spark, sf_dir).select("book_id", "line_idx", S.strip_inline(F.col("line")).alias("text"))


@query(white(r"""select conv_id, turn, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' '), '') as text from conversations"""))
def soft_wrap_join(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", S.soft_wrap_join(F.col("text")).alias("text"))


# Packing -------------------------------------------------------------------


def from_paragraphs(spark, sf_dir, pack):
    """What pack makes of the paragraphs of the Markdown lines. It has stored its units by then, so the paragraphs' own table goes."""
    mark = stored_so_far()
    found = pack(M.assemble_paragraphs(X.markdown(spark, sf_dir)))
    drop_since(spark, mark, [found])
    return found


#: Sentences without lookbehind: each match ends at a cut or at the end.
_DUCK_SIMPLE = white(r"list_filter(list_transform(regexp_extract_all({0}, '(?s).*?[.!?](?:\s+|\z)|.+\z'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '')").replace('{', '{{').replace('}', '}}').replace('{{0}}', '{0}')


@query(LINES.replace("recursive ", "") + f""", s as (select doc_id, line_idx, {_DUCK_SIMPLE.format('text')} as ss from doc_lines)
 select doc_id, line_idx, cast(generate_subscripts(ss, 1) - 1 as bigint) as sent, unnest(ss) as sentence from s""")
def sentences_simple(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return lines.select("doc_id", "line_idx", F.posexplode(S.sentences_simple(F.col("text"))).alias("sent", "sentence")).withColumn("sent", F.col("sent").cast("long"))


_ABBREVIATIONS = ", ".join(f"'{a.lower()}'" for a in P.ABBREVIATIONS)


def _guarded_ctes(source: str, keys: str) -> str:
    """CTE gs (keys, sent, sentence) from `source` (keys, text): pieces, local conditions, then a fold over the pieces."""
    on = " and ".join(f"n.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    return white(rf""", gp as (select {keys}, unnest(regexp_extract_all(text, '(?s).*?[.!?](?:\s+|\z)|.+\z')) as piece, generate_subscripts(regexp_extract_all(text, '(?s).*?[.!?](?:\s+|\z)|.+\z'), 1) as i from {source}),
gw as (select *, regexp_extract(piece, '(\S*)[.!?]\s*\z', 1) as w, lead(piece) over (partition by {keys} order by i) as nextp, len(list_filter(string_split_regex(piece, '\s+'), lambda x: x <> '')) as words from gp),
gc as (select *, regexp_matches(piece, '[.!?]\s*\z') and not (contains(w, '.') or lower(w) in ({_ABBREVIATIONS}) or (strlen(w) = 1 and regexp_matches(w, '^\pL$')) or (strlen(w) = 2 and regexp_matches(w, '^\pL+$'))) and (nextp is null or regexp_matches(nextp, '^[\p{{Lu}}0-9"''“‘]')) as cut from gw),
gf as (select {keys}, i, 0 as sent, words, cut and words >= 5 as ended from gc where i = 1
  union all select {own}, n.i, case when p.ended then p.sent + 1 else p.sent end, case when p.ended then n.words else p.words + n.words end, n.cut and (case when p.ended then n.words else p.words + n.words end) >= 5
  from gf p join gc n on {on} and n.i = p.i + 1),
g1 as (select {keys}, sent, regexp_replace(string_agg(piece, '' order by i), '^\s+|\s+$', '', 'g') as sentence from gc join (select {keys}, i, sent from gf) using ({keys}, i) group by all),
gs as (select {keys}, row_number() over (partition by {keys} order by sent) - 1 as sent, sentence from g1 where sentence <> '')""")


@query(LINES + _guarded_ctes("doc_lines", "doc_id, line_idx") + " select * from gs")
def sentences_guarded(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return lines.select("doc_id", "line_idx", F.posexplode(P.sentences_guarded(F.col("text"))).alias("sent", "sentence")).withColumn("sent", F.col("sent").cast("long"))


def _pack_ctes(keys: str, most: int) -> str:
    """CTE pk (keys, i, pack) from un (keys, i from 1, len, slack, glue, force)."""
    names = [k.strip() for k in keys.split(",")]
    on, own = " and ".join(f"n.{k} = p.{k}" for k in names), ", ".join(f"n.{k}" for k in names)
    new = f"n.force or p.cur + n.len + n.slack > {most}"
    return f""", pk as (select {keys}, i, len as cur, 0 as pack from un where i = 1
  union all select {own}, n.i, case when {new} then n.len else p.cur + n.glue + n.len end, case when {new} then p.pack + 1 else p.pack end from pk p join un n on {on} and n.i = p.i + 1)"""


@query(with_duck(PARAS + f""", u0 as (select book_id, para_idx, strlen(trim(text)) > 3000 as over, case when strlen(trim(text)) > 3000 then {_DUCK_SIMPLE.format('trim(text)')} else [trim(text)] end as ss from pg),
u1 as (select book_id, para_idx, over, unnest(ss) as text, generate_subscripts(ss, 1) as s from u0),
un as (select *, row_number() over (partition by book_id order by para_idx, s) as i, strlen(text) as len, case when over then 1 else 2 end as slack, case when over then 1 else 2 end as glue, over and s = 1 as force from u1)"""
                 + _pack_ctes("book_id", 3000) + """, jn as (select u.*, p.pack, row_number() over (partition by u.book_id, p.pack order by u.i) as k from un u join pk p using (book_id, i))
 select book_id, cast(pack as bigint) as chunk_idx, string_agg(case when k = 1 then '' when glue = 2 then chr(10) || chr(10) else ' ' end || text, '' order by i) as text from jn group by book_id, pack""", "fx_md", recursive=True))
def pack_chunks(spark, sf_dir):
    return from_paragraphs(spark, sf_dir, P.pack_text_chunks)


def _segments_ctes(source: str, keys: str, voice_keys: str) -> str:
    """CTE sg (keys, seg_idx, text) from source (keys, para_idx, text)."""
    return (
        f", lp as (select {keys}, para_idx, text from {source} where strlen(text) > 500)" + _guarded_ctes("lp", f"{keys}, para_idx")
        + f""", u1 as (select {keys}, para_idx, cast(0 as bigint) as s, false as over, text from {source} where strlen(text) <= 500 union all select {keys}, para_idx, sent, true, sentence from gs),
un as (select *, row_number() over (partition by {keys} order by para_idx, s) as i, strlen(text) as len, case when over then 1 else 2 end as slack, 1 as glue, over and s = 0 as force from u1)"""
        + _pack_ctes(keys, 500) + f", sg as (select {keys}, cast(pack as bigint) as seg_idx, string_agg(text, ' ' order by i) as text from un join (select {keys}, i, pack from pk) using ({keys}, i) group by {keys}, pack)"
    )


@query(with_duck(PARAS + _segments_ctes("pg", "book_id", "book_id") + " select * from sg", "fx_md", recursive=True))
def pack_segments(spark, sf_dir):
    return from_paragraphs(spark, sf_dir, lambda paragraphs: P.pack_segments(paragraphs, ["book_id"]))


@query(with_duck(PARAS + """, il as (select *, cast(sum(case when kind <> 'BODY' then 1 else 0 end) over (partition by book_id order by para_idx) as bigint) as island from pg),
bd as (select book_id, island, para_idx, text from il where kind = 'BODY')""" + _segments_ctes("bd", "book_id, island", "") + """, en as (
 select book_id, island, cast(-1 as bigint) as seg_idx, kind as speaker, text, case kind when 'TITLE' then 'Slow, atmospheric.' when 'CHAPTER' then 'Measured, clear chapter announcement.' else 'Neutral, even narration.' end as instruct from il where kind <> 'BODY'
 union all select book_id, island, seg_idx, 'warm alto, even', text, 'calm' from sg)
 select book_id, row_number() over (partition by book_id order by island, seg_idx) - 1 as entry_idx, speaker, text, instruct from en""", "fx_md", recursive=True))
def single_speaker(spark, sf_dir):
    return from_paragraphs(spark, sf_dir, lambda paragraphs: P.single_speaker(paragraphs, "warm alto, even", "calm"))
