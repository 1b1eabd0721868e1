"""Scans in chunks against plain loops, with keys that span many tasks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptspark.operators import markdown, packing, signal
from scriptspark.operators import scan
from scriptspark.operators.scan import chunked_scan
from scriptspark.plans import fixtures
from scriptspark.storage import store


@pytest.fixture
def many_tasks(spark):
    """Ranges stay as they are cut: seven of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def greedy(units, most):
    """Pack of each unit (key, len, slack, glue, force), one after the other."""
    out, key, cur, pack = [], object(), 0, 0
    for k, n, slack, glue, force in units:
        n = n or 0
        if k != key:
            key, cur, pack = k, n, 0
        elif force or cur + n + slack > most:
            cur, pack = n, pack + 1
        else:
            cur += glue + n
        out.append(pack)
    return out


def random_units(rng, n, keys, lengths, glue):
    out = []
    for k in sorted(rng.choice(keys) for _ in range(n)):
        out.append((k, rng.choice(lengths), glue, glue, rng.random() < 0.02))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packs_in_chunks_match_the_fold(spark, many_tasks, seed):
    rng = random.Random(seed)
    lengths = [list(range(40)), [0, 1, None], [7], [500, 3, 90], list(range(400)), [99, 100, 101]][seed]
    rows = random_units(rng, 3000, ["a"] if seed % 2 else ["a", "a", "a", "b", "c"], lengths, 1 + seed % 2)
    if seed % 3 == 0:  # as paragraphs and the sentences of long ones
        rows = [(k, n, 2, 1, f) for k, n, _, _, f in rows]
    df = spark.createDataFrame([(k, i, n, s, g, f, "x", 1) for i, (k, n, s, g, f) in enumerate(rows)], "book_id string, i long, len int, slack int, glue int, force boolean, text string, __x int").repartition(3)
    packed = chunked_scan(df.select("book_id", "i", *packing.Packer.columns), ["book_id"], ["i"], T.StructField("pack", T.IntegerType()), packing.Packer(100))
    assert [r.pack for r in packed.orderBy("i").collect()] == greedy(rows, 100)
    assert [r.pack for r in packing.with_pack(df, ["book_id"], ["i"], 100).orderBy("i").collect()] == greedy(rows, 100)


def test_null_keys_and_empty_tables(spark, many_tasks):
    rows = [(None if i % 2 else "b", i, 30, 1, 1, False) for i in range(200)]
    df = spark.createDataFrame(rows, "book_id string, i long, len int, slack int, glue int, force boolean")
    got = {r.i: r.pack for r in packing.with_pack(df, ["book_id"], ["i"], 100).collect()}
    for odd in (0, 1):
        own = [(k, *r) for k, _, *r in rows if (k is None) == bool(odd)]
        assert [got[i] for i in range(odd, 200, 2)] == greedy([("k", *r[1:]) for r in own], 100)
    assert packing.with_pack(df.where(F.lit(False)), ["book_id"], ["i"], 100).count() == 0


def test_maps_of_chunks_compose(spark):
    """The map of a chunk gives for every fill on entry what the scan gives."""
    rng = np.random.default_rng(2)
    packer = packing.Packer(60)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        columns = [rng.integers(0, 30, n), np.full(n, 2), np.full(n, 1), rng.random(n) < 0.1]
        for fill in range(62):
            _, leaves = packer.run(columns, np.array([0]), (fill, 5))
            assert packer.through(packer.summary(columns), (fill, 5)) == leaves


@pytest.mark.parametrize("keys", [1, 3, 90])
def test_gains_in_chunks_match_the_loop(spark, many_tasks, keys):
    rng = np.random.default_rng(keys)
    n = 30_000
    key = np.sort(rng.integers(0, keys, n))
    target = np.where(rng.random(n) < 0.02, 0.0, -30 * rng.random(n) * (rng.random(n) < 0.5))
    pos = np.concatenate([np.arange((key == k).sum()) for k in range(keys)])
    df = spark.createDataFrame(list(zip(key.tolist(), pos.tolist(), target.tolist(), strict=True)), "book_id long, pos long, target double").repartition(5)
    for settings in (signal.Compressor(), signal.Compressor(attack_ms=3000, release_ms=20_000), signal.Compressor(attack_ms=50, release_ms=20)):
        got = np.array([r.gain for r in signal.attack_release(df, 100, settings).orderBy("book_id", "pos").collect()])
        up, down = settings.coefficient(settings.attack_ms, 100), settings.coefficient(settings.release_ms, 100)
        want = np.concatenate([signal.smooth_gains(target[key == k], up, down) for k in range(keys)])
        assert np.abs(got - want).max() < 1e-9


def test_maps_of_gains(spark):
    rng = np.random.default_rng(4)
    for n in (1, 5, 300):
        step = signal.Gain(0.09, 0.01, -20.0, 0.0)
        columns = [-20 * rng.random(n)]
        for entry in np.linspace(-20, 0, 41):
            _, leaves = step.run(columns, np.array([0]), entry)
            assert abs(step.through(step.summary(columns), entry) - leaves) < 1e-12


def test_sliding_rms_over_blocks(spark, many_tasks):
    rng = np.random.default_rng(5)
    rows = [(k, p, float(v)) for k, m in (("a", 1000), ("b", 64), ("c", 65), ("d", 1)) for p, v in enumerate(rng.random(m))]
    df = spark.createDataFrame(rows, "book_id string, pos long, x double").repartition(4)
    for n, block in ((1, 64), (16, 64), (50, 8), (64, 64)):
        got = {(r.book_id, r.pos): r.rms for r in signal.sliding_rms(df, n, block=block).collect()}
        for k in "abcd":
            x = np.array([v for b, _, v in rows if b == k])
            want = [np.sqrt((x[i : i + n] ** 2).sum() / n) for i in range(len(x))]
            assert np.allclose(np.square([got[k, i] for i in range(len(x))]), np.square(want), rtol=0, atol=1e-12)
    assert len(got) == len(rows)


def blocks_by_hand(lines):
    """Kinds and paragraphs of a book's lines, one line after the other."""
    kinds, paras, fenced, html, fresh, goes_on = [], [], False, False, True, False
    for line in lines:
        blank = not line.strip(" ")
        if fresh:
            html = bool(re.match(markdown.HTML, line))
        fresh = blank
        fence = bool(re.match(markdown.FENCE, line))
        fenced ^= fence
        level = re.match(r" {0,3}(#{1,6})(?:\s|$)", line)
        if fence:
            kind = "FENCE"
        elif fenced:
            kind = "CODE"
        elif blank:
            kind = "BLANK"
        elif html:
            kind = "HTML"
        elif level:
            kind = {1: "TITLE", 2: "CHAPTER", 3: "CHAPTER"}.get(len(level[1]), "SECTION")
        else:
            kind = next((k for k in ("RULE", "ITEM", "QUOTE") if re.search(getattr(markdown, k), line)), "TEXT")
        kinds.append(kind)
        text = re.sub(r"^[*] |<[a-z]+>", "", re.sub(r"^> ", "", re.sub(r"^#+ *", "", line))).strip(" ")
        if kind in ("TITLE", "CHAPTER", "SECTION"):
            paras.append((kind, [text]))
        elif kind in ("TEXT", "ITEM", "QUOTE"):
            if goes_on and kind != "ITEM":
                paras[-1][1].append(text)
            else:
                paras.append(("BODY", [text]))
        goes_on = kind in ("TEXT", "ITEM", "QUOTE") and not line.endswith("  ")
    joined = [(k, " ".join(filter(None, p))) for k, p in paras]
    return kinds, [x for x in joined if x[1]]


@pytest.mark.parametrize("seed", range(4))
def test_markdown_in_chunks_matches_a_loop(spark, many_tasks, seed):
    """A book of 1500 lines, in seven ranges, beside short ones: an open fence, a long HTML block and a long paragraph cross ranges."""
    rng = random.Random(seed)
    pool = [["one", "two  ", "", "```", "# T", "### C", "#### S", "* item", "> said", "<div>q", "---", "~~~ x"], ["a", "b"], ["<p>q", "x", "x", "x"], ["```", "a", ""] + ["c"] * 60][seed]
    books = {b: [rng.choice(pool) for _ in range(n)] for b, n in (("a", 1), ("m", 1500), ("n", 3), ("z", 40))}
    lines = spark.createDataFrame([(b, i, x) for b, ls in books.items() for i, x in enumerate(ls)], "book_id string, line_idx long, line string").repartition(3)
    kinds, paras = {}, {}
    for r in markdown.classify_lines(lines).orderBy("line_idx").collect():
        kinds.setdefault(r.book_id, []).append(r.kind)
    for r in markdown.assemble_paragraphs(lines).orderBy("para_idx").collect():
        assert r.para_idx == len(paras.setdefault(r.book_id, []))
        paras[r.book_id].append((r.kind, r.text))
    for b, ls in books.items():
        expected = blocks_by_hand(ls)
        assert kinds[b] == expected[0]
        assert paras.get(b, []) == expected[1]


def test_markdown_of_odd_tables(spark, many_tasks):
    """An empty table gives none; a null line is text without words, a null book a book."""
    schema = "book_id string, line_idx long, line string"
    assert markdown.classify_lines(spark.createDataFrame([], schema)).count() == markdown.assemble_paragraphs(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, 0, "# T"), (None, 1, None), (None, 2, "x"), ("b", 0, "y")], schema)
    assert [r.kind for r in markdown.classify_lines(odd).orderBy("book_id", "line_idx").collect()] == ["TITLE", "TEXT", "TEXT", "TEXT"]
    assert [(r.para_idx, r.text) for r in markdown.assemble_paragraphs(odd).orderBy("book_id", "para_idx").collect()] == [(0, "T"), (1, "x"), (0, "y")]


@pytest.mark.parametrize("seed", range(4))
def test_numbered_markdown_matches_a_loop(spark, many_tasks, monkeypatch, seed):
    """Chunks of 64 numbers, batches of 50 rows: books of many chunks, of one, and chunks cut by batches."""
    monkeypatch.setattr(scan, "CHUNK_ROWS", 64)
    monkeypatch.setattr(markdown, "CHUNK_ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        test_markdown_in_chunks_matches_a_loop(spark, many_tasks, seed)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


class Held:
    """Gives each row the number of rows that the scan holds with it."""

    columns = ["x"]

    def run(self, columns, begins, entry):
        return np.full(len(columns[0]), len(columns[0])), None


def test_a_scan_of_lines_holds_one_batch(spark, many_tasks):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = store(spark.range(5000).selectExpr("cast(id % 2 as string) as book_id", "id div 2 as i", "id as x"), "held")
        got = scan.numbered_scan(rows, ["book_id"], "i", T.StructField("held", T.LongType()), Held())
        assert got.count() == 5000 and got.agg(F.max("held")).first()[0] <= 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packs_are_not_broadcast(spark):
    df = spark.createDataFrame([("a", i, 5, 1, 1, False) for i in range(300)], "book_id string, i long, len int, slack int, glue int, force boolean")
    plan = packing.with_pack(df, ["book_id"], ["i"], 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_lines_of_a_book_are_spread(spark, many_tasks, tmp_path):
    """One book of 300 documents is no single task's; documents of one id, null ones too, have their lines beside each other."""
    docs = [("en", "s", i, f"a{i}\nb") for i in range(300)] + [("en", "s", 7, "c"), ("en", None, 1, "x"), ("en", None, None, "y"), ("en", None, None, "z\nw"), ("de", "s", 5, None)]
    spark.createDataFrame(docs, "lang string, source string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = fixtures.markdown(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    book = [r for r in lines if r.book_id == "en/s"]
    assert len({r.task for r in book}) > 1
    assert sorted(r.line_idx for r in book) == list(range(len(book)))
    assert [r.line for r in sorted(book, key=lambda r: r.line_idx) if r.line.startswith("#")] == [f"{'# Part' if i % 5 == 0 else '### Note' if i % 5 == 1 else '#### Aside' if i % 5 == 2 else '## Chapter'} {i}" for i in range(300) for _ in range(1 + (i == 7))]
    assert sorted(r.line_idx for r in lines if r.book_id is None) == list(range(sum(r.book_id is None for r in lines)))
