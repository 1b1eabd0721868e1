"""Markdown blocks over lines: code fences, blank runs and paragraphs are one small automaton, scanned in chunks of a book.

Lines are (book_id, line_idx, line). What a line is depends on the lines before it by four things: whether a fence is open,
whether the block began as HTML, whether the last line lets a paragraph go on, and how many paragraphs began. The first three have
twelve states in all, so a chunk's effect on the lines after it is a table of twelve rows, and tables compose.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptspark.functions import strings as S
from scriptspark.operators.scan import CHUNK_ROWS, numbered_scan
from scriptspark.storage import drop_since, store, stored_so_far, tidy

# Line forms.
FENCE = r"^ {0,3}(```|~~~)"
HEADING = r"^ {0,3}#{1,6}(\s|$)"
RULE = r"^ {0,3}((\* *){3,}|(- *){3,}|(_ *){3,})$"
ITEM = r"^\s*([-*+]|[0-9]{1,9}[.)])\s+"
QUOTE = r"^ {0,3}> ?"
HTML = r"^ {0,3}<(/?[A-Za-z]|!--)"
HARD_BREAK = r"(  |\\)$"


def explode_lines(books: DataFrame) -> DataFrame:
    """books (book_id, markdown) to lines (book_id, line_idx, line)."""
    return books.select("book_id", F.posexplode(F.split("markdown", "\r?\n")).alias("line_idx", "line")).withColumn("line_idx", F.col("line_idx").cast("long"))


KINDS = "FENCE CODE BLANK HTML TITLE CHAPTER SECTION RULE ITEM QUOTE TEXT".split()
HEADS = ("TITLE", "CHAPTER", "SECTION")
_CODE = {kind: i for i, kind in enumerate(KINDS)}
_KIND_BITS, _HTML_BIT, _BREAK_BIT = 15, 16, 32


class Blocks:
    """Kinds and paragraph numbers of lines, as number * 16 + kind.

    A state is (fence open, the block: 1 HTML, 0 other, 2 the next line begins it; whether a paragraph goes on, paragraphs so far).
    """

    columns = ["__mark"]
    START = (0, 2, False, 0)

    def run(self, columns: list[np.ndarray], begins: np.ndarray, entry: tuple | None) -> tuple[np.ndarray, tuple]:
        odd, block, goes_on, count = self.START if entry is None else entry
        mark = columns[0]
        n, plain = len(mark), mark & _KIND_BITS
        book = np.zeros(n, np.int64)
        book[begins[1:]] = 1
        book = np.cumsum(book)
        fence, blank = plain == _CODE["FENCE"], plain == _CODE["BLANK"]
        opens = np.concatenate(([block == 2], blank[:-1]))
        opens[begins[1:]] = True
        opened = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
        html = np.where(opened >= 0, (mark & _HTML_BIT)[opened] > 0, block == 1)
        parity = self._within(fence, begins, book, odd) & 1
        kind = np.select([fence, parity > 0, blank, html], [plain, _CODE["CODE"], plain, _CODE["HTML"]], plain)
        on = np.isin(kind, [_CODE[k] for k in ("ITEM", "QUOTE", "TEXT")]) & ((mark & _BREAK_BIT) == 0)
        starts = ~np.concatenate(([goes_on], on[:-1])) | np.isin(kind, [_CODE[k] for k in (*HEADS, "ITEM")])
        starts[begins[1:]] = True
        number = self._within(starts, begins, book, count)
        return number * 16 + kind, (int(parity[-1]), 2 if blank[-1] else int(html[-1]), bool(on[-1]), int(number[-1]))

    @staticmethod
    def _within(flags: np.ndarray, begins: np.ndarray, book: np.ndarray, first: int) -> np.ndarray:
        """Running counts of flags within each book; that of the first book goes on from `first`."""
        total = np.cumsum(flags)
        base = total[begins] - flags[begins]
        base[0] -= first
        return total - base[book]

    def summary(self, columns: list[np.ndarray]) -> dict[tuple, tuple]:
        states = [(odd, block, goes_on) for odd in (0, 1) for block in (0, 1, 2) for goes_on in (False, True)]
        return {s: self.run(columns, np.array([0]), (*s, 0))[1] for s in states}

    def through(self, summary: dict[tuple, tuple], entry: tuple) -> tuple:
        *left, more = summary[tuple(entry[:3])]
        return (*left, entry[3] + more)


def _known(lines: DataFrame) -> DataFrame:
    """book_id, line_idx, line, kind, island: kinds of lines, and the number of the paragraph they would stand in."""
    line = F.col("line")
    level = F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})", 1))
    code = lambda kind: F.lit(_CODE[kind])
    heading = F.when(level == 1, code("TITLE")).when(level <= 3, code("CHAPTER")).otherwise(code("SECTION"))
    plain = (
        F.when(line.rlike(FENCE), code("FENCE")).when(F.trim(line) == "", code("BLANK")).when(line.rlike(HEADING), heading)
        .when(line.rlike(RULE), code("RULE")).when(line.rlike(ITEM), code("ITEM")).when(line.rlike(QUOTE), code("QUOTE")).otherwise(code("TEXT"))
    )
    flag = lambda pattern, bit: F.when(line.rlike(pattern), F.lit(bit)).otherwise(F.lit(0))
    marked = lines.select("book_id", "line_idx", "line", (plain + flag(HTML, _HTML_BIT) + flag(HARD_BREAK, _BREAK_BIT)).cast("long").alias("__mark"))
    found = numbered_scan(store(marked, "lines"), ["book_id"], "line_idx", T.StructField("__at", T.LongType()), Blocks())
    tidy(lines.sparkSession)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("__at").bitwiseAND(15) + 1).cast("int"))
    return found.select("book_id", "line_idx", "line", kind.alias("kind"), F.shiftright("__at", 4).alias("island"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines with kind: FENCE, CODE, HTML, BLANK, TITLE, CHAPTER, SECTION, RULE, ITEM, QUOTE or TEXT (a null line too)."""
    return _known(lines).drop("island")


def drop_code_and_html(lines: DataFrame) -> DataFrame:
    return classify_lines(lines).where(~F.col("kind").isin("FENCE", "CODE", "HTML")).select("book_id", "line_idx", "line", "kind")


def headings(lines: DataFrame) -> DataFrame:
    """(book_id, line_idx, kind, text)."""
    found = classify_lines(lines).where(F.col("kind").isin("TITLE", "CHAPTER", "SECTION"))
    text = F.trim(F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}\s*", ""), r"\s+#+\s*$", ""))
    return found.select("book_id", "line_idx", "kind", S.strip_inline(text).alias("text"))


def assemble_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs (book_id, para_idx, kind, text): soft-wrapped lines joined, headings on their own, inline marks gone."""
    mark = stored_so_far()
    head = F.col("kind").isin(*HEADS)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", ITEM, ""), QUOTE, ""), r"\\$", "")
    clean = F.when(head, F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}\s*", ""), r"\s+#+\s*$", "")).otherwise(body)
    kept = _known(lines).where(F.col("kind").isin(*HEADS, "TEXT", "ITEM", "QUOTE")).select("book_id", "line_idx", "kind", "island", clean.alias("line"))
    chunk = F.floor(F.col("island") / CHUNK_ROWS).alias("chunk")
    parts = kept.select("*", chunk).repartition("book_id", "chunk").groupBy("book_id", "chunk", "island").agg(F.min(F.when(head, F.col("kind"))).alias("kind"), F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("parts"))
    joined = F.array_join(F.filter(F.transform("parts", lambda p: F.trim(p["line"])), lambda x: x != ""), " ")
    text = parts.select("book_id", "chunk", "island", F.coalesce("kind", F.lit("BODY")).alias("kind"), F.trim(S.strip_inline(joined)).alias("text")).where("text <> ''")
    # numbered within a chunk of paragraphs, which one task holds anyway, and from what the chunks before it have
    own = F.row_number().over(Window.partitionBy("book_id", "chunk").orderBy("island"))
    held = store(text.withColumn("own", own.cast("long")).drop("island"), "paragraphs")
    counts = held.groupBy("book_id", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("book_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    # at most one in CHUNK_ROWS paragraphs
    later = store(counts.withColumn("before", before).where("chunk > 0").select(F.struct("book_id", "chunk").alias("of"), "before"), "paragraphs-before")
    # no step from here on reads the lines
    drop_since(lines.sparkSession, mark, [held, later])
    found = held.withColumn("of", F.struct("book_id", "chunk")).join(F.broadcast(later), "of", "left")
    return found.select("book_id", (F.col("own") + F.coalesce("before", F.lit(0)) - 1).alias("para_idx"), "kind", "text")


def tagged(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the heading tag in front of the text, as text chunks carry it."""
    tag = F.when(F.col("kind") != "BODY", F.concat(F.lit("@@"), F.col("kind"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return paragraphs.select("book_id", "para_idx", tag.alias("text"))
