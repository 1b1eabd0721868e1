"""Derived inputs: script lines, prose, Markdown lines, segments, series and outputs, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEUTRAL = "Neutral, even narration."
NAMES = ["Ann", "Marcus", "Elena", "Boris", "Clara"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries: book_id, entry_idx, speaker, text, instruct; one per text line of a turn."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    order = Window.partitionBy("book_id").orderBy("turn", "pos")
    opens = (F.col("turn") == 0) & (F.col("pos") == 0)
    speaker = F.when(opens, "CHAPTER").otherwise(F.upper("role"))
    return turns.where(F.trim("text") != "").select("book_id", (F.row_number().over(order) - 1).cast("long").alias("entry_idx"), speaker.alias("speaker"), "text", F.lit(NEUTRAL).alias("instruct"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: book_id, para_idx, chunk_idx, text; one for each sentence of a turn, with quoted speech."""
    parts = F.split(F.regexp_replace("text", '[,"]', " "), r"[.\n]+")
    pieces = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), "turn", F.posexplode(parts).alias("pos", "s"))
    pieces = pieces.withColumn("s", F.trim("s")).where("s <> ''")
    name = lambda n: F.element_at(F.array(*map(F.lit, NAMES)), ((F.col("book_id") + F.col("turn") + F.col("pos") + n) % 5 + 1).cast("int"))
    s, nm, nx = F.col("s"), name(0), name(1)
    pro = F.when(F.col("book_id") % 2 == 0, "he").otherwise("she")
    kind = (F.col("book_id") + 5 * F.col("turn") + F.col("pos")) % 6
    text = (
        F.when(kind == 0, F.concat(F.lit('"'), s, F.lit('," '), nm, F.lit(" said. "), nx, F.lit(" waited.")))
        .when(kind == 1, F.concat(F.lit('"'), s, F.lit('."')))
        .when(kind == 2, F.concat(F.lit('"'), s, F.lit('," said '), nm, F.lit('. "'), s, F.lit('."')))
        .when(kind == 3, F.concat(s, F.lit(".")))
        .when(kind == 4, F.concat(nm, F.lit(' turned away. "'), s, F.lit('."')))
        .otherwise(F.concat(F.lit('"'), s, F.lit('," '), pro, F.lit(" said.")))
    )
    order = Window.partitionBy("book_id").orderBy("turn", "pos")
    return pieces.select("book_id", (F.row_number().over(order) - 1).cast("long").alias("para_idx"), F.expr("turn div 4").alias("chunk_idx"), text.alias("text"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose with two sentences to a paragraph, so that names and pronouns meet: book_id, para_idx, chunk_idx, text."""
    pairs = prose(spark, sf_dir).groupBy("book_id", F.expr("para_idx div 2").alias("pair")).agg(F.min("chunk_idx").alias("chunk_idx"), F.array_sort(F.collect_list(F.struct("para_idx", "text"))).alias("parts"))
    return pairs.select("book_id", F.col("pair").alias("para_idx"), "chunk_idx", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines: book_id, line_idx, line."""
    mod = lambda n: F.col("doc_id") % n
    fence = "`" * 3
    head = F.when(mod(5) == 0, "# Part ").when(mod(5) == 1, "### Note ").when(mod(5) == 2, "#### Aside ").otherwise("## Chapter ")
    code = F.when(mod(4) == 0, f"{fence}\ncode **x**\n{fence}\n\n").otherwise("")
    body = F.when(mod(2) == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    md = F.concat(head, F.col("doc_id").cast("string"), F.lit("\n\n"), code, F.lit("**Lead** "), body, F.lit("\n"))
    docs = _table(spark, sf_dir, "documents").select(F.struct("lang", "source", "doc_id").alias("of"), F.split(md, "\n").alias("lines"))
    docs = docs.where("lines is not null")
    # a document's first line counts the lines before it in its book: few columns are sorted by book, texts go by document
    counts = docs.groupBy("of").agg(F.sum(F.size("lines")).alias("n"), F.count("*").alias("copies")).select("of", F.col("of.lang").alias("lang"), F.col("of.source").alias("source"), F.col("of.doc_id").alias("doc_id"), "n", "copies")
    order = Window.partitionBy("lang", "source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"), "copies")
    placed = lambda copies: docs.join(starts.where(copies).hint("merge"), "of").select("of", "start", F.posexplode("lines").alias("pos", "line"))
    # documents of one id lie line by line beside each other
    beside = F.row_number().over(Window.partitionBy("of").orderBy("pos")) - 1
    lines = placed("copies = 1").unionByName(placed("copies > 1").withColumn("pos", beside))
    return lines.select(F.concat("of.lang", F.lit("/"), "of.source").alias("book_id"), (F.col("start") + F.col("pos")).cast("long").alias("line_idx"), "line")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, seg_idx, speaker, sample_rate, channels, samples."""
    order = Window.partitionBy("label").orderBy("vec_id")
    speaker = F.when(F.col("vec_id") % 3 == 0, "NARRATOR").when(F.col("vec_id") % 3 == 1, "ANN").otherwise("MARCUS")
    return _table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("book_id"), (F.row_number().over(order) - 1).cast("long").alias("seg_idx"), speaker.alias("speaker"), F.lit(64).alias("sample_rate"), F.lit(1).alias("channels"), F.col("embedding").alias("samples"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, pos, x: one series per user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), (F.col("value") / 200.0).alias("x"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, chunk_idx, speaker, n_samples, sample_rate; one of each segment."""
    return segments(spark, sf_dir).select("book_id", F.col("seg_idx").alias("chunk_idx"), "speaker", F.lit(64).cast("long").alias("n_samples"), "sample_rate")


def unfinished_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a run that stopped: some are missing."""
    return outputs(spark, sf_dir).where((F.col("book_id") + F.col("chunk_idx")) % 7 != 0)


DUCK = {
    "fx_script": """select book_id, row_number() over (partition by book_id order by turn, pos) - 1 as entry_idx,
       case when turn = 0 and pos = 0 then 'CHAPTER' else upper(role) end as speaker, line as text, 'Neutral, even narration.' as instruct
from (select conv_id as book_id, turn, role, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)),1)-1 as pos from conversations) q
where trim(line) <> ''""",
    "fx_prose": """select book_id, row_number() over (partition by book_id order by turn, pos) - 1 as para_idx, turn // 4 as chunk_idx,
  case kind when 0 then concat('"', s, '," ', nm, ' said. ', nx, ' waited.') when 1 then concat('"', s, '."')
   when 2 then concat('"', s, '," said ', nm, '. "', s, '."') when 3 then concat(s, '.')
   when 4 then concat(nm, ' turned away. "', s, '."') else concat('"', s, '," ', pro, ' said.') end as text
from (select book_id, turn, pos, trim(piece) as s, (book_id + 5 * turn + pos) % 6 as kind, case when book_id % 2 = 0 then 'he' else 'she' end as pro,
        list_extract(['Ann','Marcus','Elena','Boris','Clara'], cast((book_id + turn + pos) % 5 + 1 as int)) as nm,
        list_extract(['Ann','Marcus','Elena','Boris','Clara'], cast((book_id + turn + pos + 1) % 5 + 1 as int)) as nx
      from (select conv_id as book_id, turn, unnest(parts) as piece, generate_subscripts(parts, 1) - 1 as pos
            from (select conv_id, turn, string_split_regex(regexp_replace(text, '[,"]', ' ', 'g'), E'[.\\n]+') as parts from conversations) a) b
      where trim(piece) <> '') c""",
    "fx_scene": "select book_id, para_idx // 2 as para_idx, min(chunk_idx) as chunk_idx, string_agg(text, ' ' order by para_idx) as text from fx_prose group by book_id, para_idx // 2",
    "fx_md": """select concat(lang, '/', source) as book_id, row_number() over (partition by lang, source order by doc_id, pos) - 1 as line_idx, line
from (select lang, source, doc_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)),1)-1 as pos from (
  select lang, source, doc_id,
   concat(case when doc_id % 5 = 0 then '# Part ' when doc_id % 5 = 1 then '### Note ' when doc_id % 5 = 2 then '#### Aside ' else '## Chapter ' end,
          cast(doc_id as varchar(20)), E'\\n\\n', case when doc_id % 4 = 0 then concat(repeat(chr(96), 3), E'\\ncode **x**\\n', repeat(chr(96), 3), E'\\n\\n') else '' end,
          '**Lead** ', replace(text, E'\\n', case when doc_id % 2 = 0 then E'\\n\\n' else E'\\n' end), E'\\n') as md from documents) a) b""",
    "fx_segments": """select cast(label as bigint) as book_id, row_number() over (partition by label order by vec_id) - 1 as seg_idx,
  case when vec_id % 3 = 0 then 'NARRATOR' when vec_id % 3 = 1 then 'ANN' else 'MARCUS' end as speaker, 64 as sample_rate, 1 as channels, embedding as samples from embeddings""",
    "fx_series": "select user_id as book_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value / 200.0 as x from events",
    "fx_outputs": "select book_id, seg_idx as chunk_idx, speaker, cast(64 as bigint) as n_samples, 64 as sample_rate from fx_segments",
    "fx_unfinished": "select * from fx_outputs where (book_id + chunk_idx) % 7 <> 0",
}


def with_duck(sql: str, *names: str, recursive: bool = False) -> str:
    """The fixtures as CTEs in front of sql, which goes on with a comma or with select."""
    ctes = ",\n".join(f"{n} as ({DUCK[n]})" for n in names)
    return f"with {'recursive ' if recursive else ''}{ctes}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
