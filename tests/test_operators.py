"""One test per operator on inline rows, with the quirks that are kept."""

import json
import os
import random
import struct
import threading
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptspark import storage
from scriptspark.functions import strings as S
from scriptspark.operators import dialogue as D
from scriptspark.operators import enrich as E
from scriptspark.operators import markdown as M
from scriptspark.operators import packing as P
from scriptspark.operators import signal as A
from scriptspark.operators import timeline as T
from scriptspark.operators import voices as V
from scriptspark.plans import text_queries
from scriptspark.sources import files
from scriptspark.sources import wav as wav_source
from scriptspark.streaming import resume as R


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'array<' + kinds[type(v[0])] + '>' if isinstance(v, list) else '')}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize("text, sentences", [
    ("We all wanted him to do it. Then the rain came down hard.", 1),
    ("She waited there all night... Then the rain came down hard.", 1),
    ("The rain came down very hard. Then everyone went home again.", 2),
    ("It rained hard. Then everyone went home again today.", 1),
    ("They went to see Prof. Smith about the old house today.", 1),
])
def test_guarded_sentences(spark, text, sentences):
    assert len(one(spark, P.sentences_guarded(F.col("t")), t=text)) == sentences


@pytest.mark.parametrize("text, heading", [("Chapter One", True), ("Chapter One.", False), ("", False), ("x" * 120, False), ("x" * 119, True)])
def test_heading_like(spark, text, heading):
    assert one(spark, S.heading_like(F.col("t")), t=text) is heading


@pytest.mark.parametrize("span, left", [("Dorsey said. The kettle had gone cold...", "The kettle had gone cold..."), ("said Marlow.", ""), ("Rain ran down the glass.", "Rain ran down the glass.")])
def test_strip_attribution(spark, span, left):
    assert one(spark, S.strip_attribution(F.col("t")), t=span) == left


def test_strings(spark):
    assert one(spark, S.join_speech(F.col("t")), t=["We can leave by the back stairs,", "Nobody watches them at noon."]) == "We can leave by the back stairs. Nobody watches them at noon."
    assert one(spark, S.strip_emphasis(F.col("t")), t="**Guard:**") == "Guard:"
    assert [one(spark, S.fmt_duration(F.col("n")), n=n) for n in (59, 3600)] == ["00:59", "01:00:00"]
    assert [one(spark, S.literal_voice(F.col("t")), t=t) for t in ("ELENA", "female alto, warm")] == [False, True]
    assert one(spark, S.strip_inline(F.col("t")), t="a [link](http://x) and ![pic](y) `code` <b>bold</b> ~~gone~~") == "a link and pic code bold gone"
    assert one(spark, S.speaker_slug(F.col("t")), t="Élan Vital!") == "élan_vital_"
    assert one(spark, S.clean_direction(F.col("r"), F.col("t")), r="Narrator: Slow, low. And more", t="text") == "Slow, low."


def hash31(name: str) -> int:
    h = 0
    for b in name.encode():
        h = (h * 31 + b) % 2**64
    return h


@pytest.mark.parametrize("name", ["A", "REEVES", "ÉLODIE", "A very long name that wraps around many times over"])
def test_hash31(spark, name):
    assert one(spark, S.hash31(F.col("t"), 9), t=name) == hash31(name) % 9
    assert one(spark, S.hash31(F.col("t"), 4), t=name) == hash31(name) % 4


def entries(spark, rows):
    return spark.createDataFrame([(1, i, s, t, "n") for i, (s, t) in enumerate(rows)], "book_id long, entry_idx long, speaker string, text string, instruct string")


def test_group_by_speaker_keeps_headings_apart(spark):
    assert P.group_by_speaker(entries(spark, [("A", "Hi there."), ("A", "A title"), ("A", "Bye now.")])).count() == 3
    long = "x" * 249 + "."
    assert P.group_by_speaker(entries(spark, [("A", long), ("A", long)])).count() == 2
    assert P.group_by_speaker(entries(spark, [("A", long), ("A", long[1:])])).count() == 1


def test_group_by_speaker_matches_a_loop(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(rng.choice("AB"), "w" * rng.randint(1, 300) + rng.choice([".", ".", ""])) for _ in range(60)]
        made = []
        for s, t in rows:
            head = lambda x: x.strip() != "" and x[-1] not in ".!?" and len(x) < 120
            if made and made[-1][0] == s and len(made[-1][1]) + 1 + len(t) <= 500 and not head(made[-1][1]) and not head(t):
                made[-1] = (s, made[-1][1] + " " + t)
            else:
                made.append((s, t))
        got = P.group_by_speaker(entries(spark, rows)).orderBy("chunk_idx").select("speaker", "text").collect()
        assert [tuple(r) for r in got] == made


def test_packs_match_a_plain_fold(spark):
    rng = random.Random(6)
    rows = [(b, i, rng.randint(0, 200), rng.randint(1, 2), rng.randint(1, 2), rng.random() < 0.05) for b in (None, 0, 1) for i in range(20000 if b == 1 else 80)]
    want, key = set(), ()
    for b, i, n, slack, glue, force in rows:
        if b != key:
            key, cur, pack = b, n, 0
        elif force or cur + n + slack > 400:
            cur, pack = n, pack + 1
        else:
            cur += glue + n
        want.add((b, i, pack))
    rng.shuffle(rows)
    units = spark.createDataFrame(rows, "book_id long, i long, len int, slack int, glue int, force boolean")
    got = P.with_pack(units, ["book_id"], ["i"], 400).select("book_id", "i", "pack").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_packs_keep_all_text(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(n))
    paras = [(1, i, words(rng.choice([3, 40, 900]))) for i in range(25)]
    df = spark.createDataFrame(paras, "book_id long, para_idx long, text string")
    got = P.pack_text_chunks(df).orderBy("chunk_idx").collect()
    assert " ".join(r["text"] for r in got).split() == " ".join(p[2] for p in paras).split()
    assert all(len(r["text"]) <= 3000 for r in got)


def test_markdown_blocks(spark):
    text = "# T\n\none\ntwo\n\n```\ncode\n```\n* item **b**\n> quote\n\n<div>\nhtml\n</div>\n\n---\n#### Deep #\nlast  \nbreak"
    books = spark.createDataFrame([("b", text)], "book_id string, markdown string")
    got = [(r["kind"], r["text"]) for r in M.assemble_paragraphs(M.explode_lines(books)).orderBy("para_idx").collect()]
    assert got == [("TITLE", "T"), ("BODY", "one two"), ("BODY", "item b quote"), ("SECTION", "Deep"), ("BODY", "last"), ("BODY", "break")]


def chunks(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "book_id long, chunk_idx long, text string")


def test_annotate(spark):
    text = '@@CHAPTER: One\n\n"Go," Marcus said. "Now."\n\nYemi leaned forward. "Why?"\n\n"Because of you."\n\n"Oh, I see."\n\nIt rained.\n\nHe said "go'
    got = [(r["speaker"], r["text"]) for r in D.annotate(chunks(spark, text)).orderBy("entry_idx").collect()]
    assert got == [("CHAPTER", "One"), ("MARCUS", "Go. Now."), ("NARRATOR", "Yemi leaned forward."), ("YEMI", "Why?"), ("MARCUS", "Because of you."), ("YEMI", "Oh, I see."), ("NARRATOR", "It rained."), ("MARCUS", "go")]


def test_alternate_speaker_matches_a_loop(spark):
    rng = random.Random(8)
    names = ["Ann", "Bob", "Cid"]
    texts, expected = [], []
    for c in range(12):
        n = rng.randint(0, 3)
        known = sorted(x.upper() for x in names[:n])
        paras, last = [], None
        if n:
            paras.append(" ".join(f"{x} said." for x in names[:n]))
        for _ in range(12):
            kind = rng.choice(["none", "none", "cue", "plain"])
            if kind == "plain":
                paras.append("Rain.")
                last = None
            elif kind == "cue":
                paras.append('"Hi," Zoe said.')
                last = "ZOE"
                expected.append("ZOE")
            else:
                paras.append('"Well now."')
                last = next((x for x in known if x != last), known[0] if known else "UNKNOWN")
                expected.append(last)
        texts.append("\n\n".join(paras))
    # the cue's own name is left out of the roster, as nobody is named Zoe before
    for i, text in enumerate(texts):
        df = D.clean_chunks(chunks(spark, text))
        paras = D.paragraphs_of(df)
        roster = D.roster(D.extract_names(df).where("name <> 'ZOE'"))
        none = spark.createDataFrame([], "book_id long, name string, gender string, from_chunk long")
        got = [r["speaker"] for r in D.speakers(paras, D.cast_of(roster, none)).orderBy("para").collect()]
        assert got == expected[: len(got)], i
        expected = expected[len(got):]


def test_large_roster_as_of_chunk(spark):
    """A cue's name counts from its own chunk on, whatever the roster's size; turns go between the first two."""
    def spelled(i):
        return "B" + "".join(chr(97 + i // 26**k % 26) for k in range(4))

    cast = [(1, spelled(i).upper(), i, 0 if i < 2 else i % 7, "FM"[i % 2] if i > 3 else None, i % 5 if i > 3 else None) for i in range(3000)]
    cast = spark.createDataFrame(cast, "book_id long, name string, rank long, first_chunk long, gender string, from_chunk long")
    late = spelled(2996 + (6 - 2996 % 7) % 7 - 7)  # first met in chunk 6
    said = [f'"Well," said {late}.', f'{late} rose. "Well."', '"Well."', '"So?" he said.', '"So?" she said.']
    paras = spark.createDataFrame([(1, c, i, t) for c in (0, 5, 6) for i, t in enumerate(said)], "book_id long, chunk_idx long, para long, text string")
    got = {(r["chunk_idx"], r["para"]): (r["cue"] and tuple(r["cue"]), r["anchor"]) for r in D.resolve_cues(D.attribution_cues(paras, cast)).collect()}
    rows = [tuple(r) for r in cast.collect()]
    for c in (0, 5, 6):
        of = {g: next((r[1] for r in rows if r[4] == g and max(r[3], r[5]) <= c), None) for g in "MF"}
        met = c == 6
        assert got[c, 0] == (("inverted", late.upper()), late.upper() if met else None)
        assert got[c, 1] == ((("beat", late.upper()), late.upper()) if met else (None, None))
        assert got[c, 2] == (None, None)
        assert got[c, 3] == (("forward", "HE"), of["M"]) and got[c, 4] == (("forward", "SHE"), of["F"])
    spoken = {(r["chunk_idx"], r["para"]): r["speaker"] for r in D.speakers(paras, cast).collect()}
    assert spoken[0, 0] == spelled(0).upper() and spoken[0, 1] == spelled(1).upper() and spoken[6, 2] == spelled(0).upper()


def test_gender_and_elimination(spark):
    df = D.clean_chunks(chunks(spark, 'Marcus said. Ann said.\n\n"Marcus," he said.', "Bob said."))
    paras, names = D.paragraphs_of(df), D.roster(D.extract_names(df))
    final = D.gender_by_elimination(names, D.gender_first(D.gender_evidence(paras, names)))
    got = {r["name"]: (r["gender"], r["from_chunk"]) for r in final.collect()}
    assert got == {"MARCUS": ("M", 0), "ANN": ("F", 0)}


def test_dedupe(spark):
    assert D.dedupe_entries(entries(spark, [("A", "Yes."), ("A", "Yes."), ("B", "Yes.")])).count() == 2


@pytest.mark.parametrize("text, title", [("Prologue.", "Prologue."), ("It rained.", "Audiobook"), ("It rained.\n", "Audiobook"), ("\u3000Prologue.\xa0", "Prologue."), ("\tRain\u2003", "Rain")])
def test_chapters(spark, text, title):
    df = spark.createDataFrame([(1, 0, "NARRATOR", text)], "book_id long, chunk_idx long, speaker string, text string")
    assert T.chapters(df).select("title", "chunk_idx").first() == (title, 0)


def test_timeline_and_marks(spark):
    segs = spark.createDataFrame([(1, 0, "A", 44100, 44100), (1, 2, "A", 100, 44100), (1, 3, "B", 100, 44100)], "book_id long, chunk_idx long, speaker string, n_samples long, sample_rate int")
    line = T.timeline(segs, "chunk_idx")
    assert [r["start_sample"] for r in line.orderBy("chunk_idx").collect()] == [0, 44100 + 11025, 44100 + 11025 + 100 + 22050]
    found = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "b", 1), (1, 2, "late", 9)], "book_id long, chapter_no long, title string, chunk_idx long")
    marks = T.chapter_marks(found, line).orderBy("chapter_no").collect()
    assert [(m["start_sample"], m["start_ms"], m["end_ms"]) for m in marks] == [(0, 0, 1250), (55125, 1250, (55125 + 100 + 22050 + 100) * 1000 // 44100)]
    assert one(spark, T.cue_time(F.col("n"), F.lit(44100)), n=44100) == "00:01:00"


def test_signal(spark):
    assert one(spark, A.quantise(F.col("s")), s=[2.0, -1.0, 0.5]) == [32767, -32767, 16383]
    assert one(spark, A.downmix(F.col("s"), 2), s=[1.0, 0.0, 0.5, 0.5, 9.0]) == [0.5, 0.5]
    assert len(one(spark, A.resample_linear(F.col("s"), 2, 3), s=[0.0, 1.0, 2.0, 3.0])) == 6
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, 200)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "book_id long, pos long, x double")
    got = [r["rms"] for r in A.sliding_rms(df, 16).orderBy("pos").collect()]
    assert np.allclose(got, [np.sqrt((x[i : i + 16] ** 2).sum() / 16) for i in range(200)])
    full = A.compress(df, 1000).orderBy("pos").collect()
    limit = int(10 ** (-1 / 20) * 32767)
    assert len(full) == 200 and max(abs(r["sample"]) for r in full) <= limit


def test_voices(spark):
    df = spark.createDataFrame([(1, 0, "TITLE", "t", "x"), (1, 1, "ANN", "a", ""), (1, 2, "ANN", "b", "soft")], "book_id long, chunk_idx long, speaker string, text string, instruct string")
    assert V.narrator_of(df).first()["narrator"] == "ANN"
    styles = V.speaker_styles(df)
    assert [tuple(r) for r in styles.collect()] == [(1, "ANN", "soft", 0)]
    assert V.voice_profile(styles).first()["voice"].startswith("male")


def test_enrich_keeps_failures(spark):
    def backend(system, prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return "Slow, quiet. Rest."

    got = {r["text"]: (r["direction"], r["error"]) for r in E.direct(entries(spark, [("A", "good"), ("A", "bad")]), backend).collect()}
    assert got["good"] == ("Slow, quiet.", None) and got["bad"][0] is None and "no" in got["bad"][1]


def test_failure_report(spark):
    rows = [(1, None), (1, "a"), (1, "b"), (1, "b"), (2, None)]
    got = E.failure_report(spark.createDataFrame(rows, "book_id long, error string")).orderBy("book_id").collect()
    assert [tuple(r) for r in got] == [(1, 4, 3, "b"), (2, 1, 0, None)]


def test_entry_report_names_empty_books(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "book_id long, chunk_idx long")
    made = spark.createDataFrame([(1, "x")], "book_id long, text string")
    assert sorted(map(tuple, D.entry_report(chunks, made).collect())) == [(1, 2, 1, False), (2, 1, 0, True)]


def test_missing_outputs(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "book_id long, chunk_idx long")
    made = spark.createDataFrame([(1, 1), (2, 0)], "book_id long, chunk_idx long")
    assert [tuple(r) for r in T.missing_outputs(chunks, made).collect()] == [(1, 2, 0, 2)]


def test_synthesize(spark):
    df = spark.createDataFrame([(1, 0, "A", "hi", "v", "s"), (1, 1, "A", "", "v", "s")], "book_id long, chunk_idx long, speaker string, text string, voice string, style string")

    def engine(text, voice, style):
        if not text:
            raise ValueError("empty")
        return [0.0] * len(text), 8000

    got = {r["chunk_idx"]: (r["n_samples"], r["error"]) for r in E.synthesize(df, engine).collect()}
    assert got[0] == (2, None) and got[1][0] is None


def test_script_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"speaker": "NARRATOR", "text": "One", "instruct": "x"}, {"speaker": "PRIYA", "text": "Two"}]))
    got = files.read_script(spark, str(tmp_path / "a.json")).orderBy("entry_idx").collect()
    assert [(r["speaker"], r["instruct"]) for r in got] == [("NARRATOR", "x"), ("PRIYA", "Neutral, even narration.")]
    (tmp_path / "b.json").write_text('[{"speaker": "A"}]')
    with pytest.raises(Exception, match="without text"):
        files.read_script(spark, str(tmp_path / "b.json")).collect()
    files.write_script(entries(spark, [("A", "x"), ("B", "y")]), str(tmp_path / "out"))
    again = files.read_script(spark, str(tmp_path / "out" / "*" / "*.txt"))
    assert again.count() == 2
    (tmp_path / "book.md").write_text("# T\n\nx")
    assert files.read_books(spark, str(tmp_path / "book.md")).first()["markdown"] == "# T\n\nx"


def test_books_are_streamed_to_files(spark, tmp_path):
    """Files are those of the whole-book columns; a second write replaces the first; one that fails leaves the first alone."""
    top, rng = tmp_path / "out", random.Random(2)
    rows = [(f"file:///x/{b} 1.md", i, "A", "é \"q\" " * rng.randint(0, 3), "calm") for b in "abcdefgh" for i in range(rng.randint(1, 50))]
    df = spark.createDataFrame(rows, "book_id string, entry_idx long, speaker string, text string, instruct string").repartition(5)
    files.write_script(df.where("book_id like '%a%'").withColumn("speaker", F.lit("OLD")), str(top))
    files.write_script(df, str(top))
    want = {r.book_id: r.script for r in files.script_json(df).collect()}
    found = {p.parent.name: p.read_text() for p in top.rglob("*.txt")}
    assert len(found) == 8 and sorted(found.values()) == sorted(want.values())
    assert found["book_id=file%3A%2F%2F%2Fx%2Fa+1.md"] == want["file:///x/a 1.md"] and [p.name for p in top.iterdir() if "=" not in p.name] == []
    with pytest.raises(Exception, match="a row without a file"):
        files.write_script(df.withColumn("book_id", F.when(F.col("book_id").like("%b%"), F.col("book_id"))), str(top))
    assert {p.parent.name: p.read_text() for p in top.rglob("*.txt")} == found and not (top / "_temporary").exists()
    marks = spark.createDataFrame([(b, n, f"T=\u00e9{n}", n * 48000, n * 1000, n * 1000 + 999, 48000) for b in ("a", "b", "untitled") for n in range(12)], "book_id string, chapter_no long, title string, start_sample long, start_ms long, end_ms long, sample_rate int")
    titles = spark.createDataFrame([("a", "Book; A", "X", "a.wav"), ("b", "B", "Y", "b.wav"), ("none", "N", "Z", "n.wav")], "book_id string, title string, author string, file string")
    files.write_metadata(marks, titles, str(tmp_path / "meta"))
    files.write_cue(marks, titles, str(tmp_path / "cue"))
    assert {p.parent.name[8:]: p.read_text() for p in (tmp_path / "meta").rglob("*.txt")} == {r.book_id: r.metadata for r in T.chapter_metadata(marks, titles).collect()}
    assert {p.parent.name[8:]: p.read_text() for p in (tmp_path / "cue").rglob("*.cue")} == {r.book_id: r.cue for r in T.cue_sheet(marks, titles).collect()}


def wav(kind, bits, channels, rate, body):
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


class Counting:
    """A file that notes how many bytes were read."""

    def __init__(self, file):
        self.file, self.seek, self.taken = file, file.seek, 0

    def read(self, n):
        got = self.file.read(n)
        self.taken += len(got)
        return got


def test_wav_ranges(spark, tmp_path):
    """Of a file of 1 GB, its header and one range are read; blocks joined are the file's samples."""
    head, tail = wav(1, 16, 2, 48000, b"")[:-4], 10**9
    path = tmp_path / "long.wav"
    with open(path, "wb") as out:
        out.write(head + struct.pack("<I", tail))
        out.truncate(len(head) + 4 + tail)
    with open(path, "rb") as raw:
        file = Counting(raw)
        found = wav_source.header(file, path.stat().st_size)
        assert found[5] == tail and file.taken <= 1024
        first, samples = wav_source.block(file, found, 500_000_001, 500_000_101)
        assert first == -(-(500_000_001 - found[4]) // 2) and len(samples) == 50 and file.taken <= 1024 + 100
    assert files.wav_stats(spark, str(path)).collect()[0].n_samples == tail // 4
    rng = np.random.default_rng(4)
    noise = rng.integers(-32767, 32768, 5001).astype("<i2")
    (tmp_path / "few").mkdir()
    (tmp_path / "few" / "a.wav").write_bytes(wav(1, 16, 1, 8000, noise.tobytes()))
    (tmp_path / "few" / "b.wav").write_bytes(wav(1, 16, 1, 8000, b""))
    (tmp_path / "few" / "c.wav").write_bytes(b"junk" * 999)
    rows = files.read_wav_blocks(spark, str(tmp_path / "few"), 777).orderBy("path", "first").collect()
    a = [r for r in rows if r.path.endswith("a.wav")]
    assert len(a) == 13 and [r.first for r in a] == np.cumsum([0, *(len(r.samples) for r in a[:-1])]).tolist()
    assert np.concatenate([r.samples for r in a]).astype("f4").tolist() == files.wav_samples((tmp_path / "few" / "a.wav").read_bytes())[0].tolist()
    assert [(r.first, r.samples, r.error) for r in rows if not r.path.endswith("a.wav")] == [(0, [], None), (None, None, "not a RIFF WAVE file")]


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(1, 16, 1, 8000, np.array([0, 32767, -32767], "<i2").tobytes()))
    (tmp_path / "b.wav").write_bytes(wav(3, 32, 2, 8000, np.array([0.5, -0.5], "<f4").tobytes()))
    (tmp_path / "c.wav").write_bytes(wav(1, 8, 1, 8000, b"abc"))
    (tmp_path / "d.wav").write_bytes(b"junk")
    got = {r["path"][-5]: r for r in files.read_wav(spark, str(tmp_path / "*.wav")).collect()}
    assert got["a"]["samples"] == [0.0, 1.0, -1.0] and got["b"]["channels"] == 2 and got["c"]["error"] and got["d"]["error"]
    stats = {r["path"][-5]: r for r in files.wav_stats(spark, str(tmp_path / "*.wav")).collect()}
    assert stats["a"]["n_samples"] == 3 and stats["b"]["n_samples"] == 1 and stats["d"]["error"]


def test_equal_prompts_are_asked_once(spark, tmp_path):
    """Of 300 rows with nine prompts, one of them null and one failing, each prompt is asked once, at most four at a time, one session a task."""
    log = str(tmp_path)

    def session():
        lock, state = threading.Lock(), [0, 0]
        open(f"{log}/session-{uuid.uuid4().hex}", "w").close()

        def ask(system, text):
            open(f"{log}/call-{uuid.uuid4().hex}", "w").close()
            with lock:
                state[0] += 1
                state[1] = max(state)
            time.sleep(0.1)
            with lock:
                state[0] -= 1
            if text == "p3":
                raise ValueError("no")
            return f"{text}|{state[1]}"

        return ask

    rows = [(i, None if i % 9 == 0 else f"p{i % 9}" if i % 2 else "p1") for i in range(300)]
    df = spark.createDataFrame(rows, "copy long, asked string").repartition(3)
    got = {r["copy"]: r for r in E.enrich(df, session, "s", "asked", tries=1, in_flight=4, per_task=True).collect()}
    assert len(got) == 300 and {k: r["asked"] for k, r in got.items()} == dict(rows)
    calls, sessions = ([f for f in os.listdir(log) if f.startswith(k)] for k in ("call", "session"))
    assert len(calls) == len({p for _, p in rows}) and len(sessions) <= 4
    assert all((r["error"] == "ValueError: no") == (r["asked"] == "p3") for r in got.values())
    answers = [r["answer"] for r in got.values() if r["answer"]]
    assert all(r["answer"].split("|")[0] == str(r["asked"]) for r in got.values() if r["answer"])
    assert max(int(a.split("|")[1]) for a in answers) <= 4


def test_blocks_are_the_assembled_book(spark):
    rng = random.Random(3)
    rows = [(b, i, [rng.randint(-9, 9) for _ in range(rng.choice([0, 1, 5, 40]))], rng.choice([0, 3, 25])) for b in ("a", "b") for i in range(30)]
    line = spark.createDataFrame([*rows, ("n", 0, None, 4), ("z", 0, [], 0)], "book_id string, seg_idx long, faded array<int>, gap int")
    got = {}
    for r in A.assemble_blocks(line, block=16).orderBy("book_id", "block_no").collect():
        assert r.start_sample == len(got.setdefault(r.book_id, [])) == 16 * r.block_no and len(r.samples) <= 16
        got[r.book_id] += r.samples
    want = {}
    for b, _, x, gap in rows:
        want.setdefault(b, []).extend(x + [0] * gap)
    assert got == want | {"n": [0] * 4}


def test_resume(spark, tmp_path, monkeypatch):
    """Runs that end between outputs and manifest, or between manifest and checkpoint, add nothing twice; nor does a lost checkpoint."""
    schema = "book_id long, chunk_idx long"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run(checkpoint=check):
        R.resume(spark, source, schema, out, checkpoint, lambda df: df).awaitTermination()

    def done():
        found = R.outputs(spark, out)
        return [] if found is None else sorted(r["chunk_idx"] for r in found.collect())

    def add(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    add((1, 0), (1, 1))
    assert done() == []
    commit = R._commit
    monkeypatch.setattr(R, "_commit", lambda keys, path: (_ for _ in ()).throw(RuntimeError("ended before the manifest")))
    with pytest.raises(Exception, match="ended before the manifest"):
        run()
    assert done() == []
    monkeypatch.setattr(R, "_commit", commit)
    run()
    assert done() == [0, 1]
    add((1, 1), (1, 2))

    def late(keys, path):
        commit(keys, path)
        raise RuntimeError("ended after the manifest")

    monkeypatch.setattr(R, "_commit", late)
    with pytest.raises(Exception, match="ended after the manifest"):
        run()
    monkeypatch.setattr(R, "_commit", commit)
    assert done() == [0, 1, 2]
    run()
    run(str(tmp_path / "other"))
    assert done() == [0, 1, 2]


def test_smooth_stream_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(b, i, float(-v)) for b in (1, 2) for i, v in enumerate(rng.random(40))]
    schema = "book_id long, pos long, target double"
    source = str(tmp_path / "in")
    for a in (0, 20):
        spark.createDataFrame([r for r in rows if a <= r[1] < a + 20], schema).coalesce(1).write.mode("append").parquet(source)
    stream = R.smooth_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 100)
    out = stream.writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = {(r["book_id"], r["pos"]): r["gain"] for r in spark.table("smoothed").collect()}
    want = A.attack_release(spark.createDataFrame(rows, schema), 100).collect()
    assert len(got) == 80 and all(abs(got[r["book_id"], r["pos"]] - r["gain"]) < 1e-12 for r in want)


def test_late_points_wait_for_their_place(spark, tmp_path):
    """Points that come up to ten seconds late, in three micro-batches, are smoothed in order; one that comes a minute late is left out."""
    rng = np.random.default_rng(6)
    rows = [(b, i, float(-v), i * 1000) for b in (1, 2) for i, v in enumerate(rng.random(40))]
    parts = [rows[0:15] + rows[40:62], rows[20:40] + [r for r in rows[62:] if r[1] % 2], rows[15:20] + [r for r in rows[62:] if not r[1] % 2], [(3, 0, 0.0, 90_000)], [(3, 1, 0.0, 200_000), (1, 7, -9.0, 7_500)]]
    source, key = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "book_id long, pos long, target double, ms long").select("book_id", "pos", "target", F.timestamp_millis(F.col("ms") + 10**12).alias("at")).coalesce(1).write.mode("append").parquet(source)
        stream = R.smooth_late_stream(spark.readStream.schema("book_id long, pos long, target double, at timestamp").parquet(source), 100, "30 seconds")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(key, old)
    got = [(r["book_id"], r["pos"], r["gain"]) for r in spark.read.parquet(str(tmp_path / "out")).where("book_id < 3").collect()]
    want = {(r["book_id"], r["pos"]): r["gain"] for r in A.attack_release(spark.createDataFrame([r[:3] for r in rows], "book_id long, pos long, target double"), 100).collect()}
    assert len(got) == 80 and max(abs(want[b, p] - g) for b, p, g in got) < 1e-12


def test_white_space_of_any_kind(spark):
    nb = "\u00a0"
    row = spark.range(1).select(
        S.heading_like(F.lit("Chapter One.\t")).alias("dot"), S.heading_like(F.lit(f"{nb}Chapter One{nb}")).alias("plain"), S.heading_like(F.lit(f"{nb}\t")).alias("blank"),
        S.literal_voice(F.lit(f"female{nb}alto")).alias("voice"), S.soft_wrap_join(F.lit(f"one{nb}\n{nb}\n\u3000two")).alias("wrap"),
        S.sentences_simple(F.lit(f"One.{nb}Two!\u2003Three")).alias("simple"),
        P.sentences_guarded(F.lit(f"This one has five words.{nb}Here five words are too.")).alias("guarded"),
    ).first()
    assert (row.dot, row.plain, row.blank, row.voice, row.wrap) == (False, True, False, True, "one two")
    assert row.simple == ["One.", "Two!", "Three"] and row.guarded == ["This one has five words.", "Here five words are too."]


def test_second_compressor_pass_runs_over_the_joined_series(spark):
    rng = np.random.default_rng(3)
    series = spark.createDataFrame([(b, i, float(x)) for b in (1, 2) for i, x in enumerate(rng.uniform(-1, 1, 400))], "book_id long, pos long, x double")
    got = A.compress(series, 64).orderBy("book_id", "pos").toPandas()
    up, down = A.Compressor().coefficient(10.0, 64), A.Compressor().coefficient(100.0, 64)
    for _, g in got.groupby("book_id"):
        assert np.allclose(g["gain"], A.smooth_gains(g["target"].to_numpy(), up, down))


def test_cue_of_many_tracks(spark, tmp_path):
    """Beyond 99 tracks or minutes the query follows its SQL, whose fields have two characters; the operator's numbers stay whole."""
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    c.sql("create table embeddings as select range as vec_id, cast(7 as int) as label, [cast(0.5 as float)] as embedding from range(9000)")
    c.sql(f"copy embeddings to '{tmp_path}/embeddings.parquet'")
    want = c.sql(entry.oracle_sql()["chapter_cue"]).fetchall()
    got = entry.queries()["chapter_cue"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == want
    marks = spark.createDataFrame([(1, 120, "x", 64 * 60 * 130, 64)], "book_id int, chapter_no long, title string, start_sample long, sample_rate int")
    titles = spark.createDataFrame([(1, "t", "a", "f")], "book_id int, title string, author string, file string")
    whole = T.cue_sheet(marks, titles).first().cue
    assert "TRACK 121 AUDIO" in whole and "INDEX 01 130:00:00" in whole


def test_entries_are_the_packs_of_a_book(spark):
    """Headings stand alone among packs, and no window moves a book's texts to number them."""
    kinds = ["BODY", "TITLE", "CHAPTER", "BODY", "BODY", "SECTION", "BODY", "BODY", "BODY", "CHAPTER", "CHAPTER"]
    texts = ["before.", "T", "", "a" * 200, "b" * 298, "h" * 600, "c" * 250, "d" * 249, "One two three four five. " * 40, "K", "L"]
    rows = [(b, i, k, t) for b in ("x", None) for i, (k, t) in enumerate(zip(kinds, texts, strict=True))]
    found = P.single_speaker(spark.createDataFrame(rows, "book_id string, para_idx long, kind string, text string"), "v", "s")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    entries = {b: [(r.speaker, r.text, r.instruct) for r in sorted(found.collect(), key=lambda r: r.entry_idx) if r.book_id == b] for b in ("x", None)}
    sentence = "One two three four five."
    body = ["before.", " ".join(["a" * 200, "b" * 298]), "c" * 250, "d" * 249, *[" ".join([sentence] * 20)] * 2]
    assert entries["x"] == entries[None] == [
        ("v", body[0], "s"), ("TITLE", "T", "Slow, atmospheric."), ("CHAPTER", "", "Measured, clear chapter announcement."), ("v", body[1], "s"), ("SECTION", "h" * 600, "Neutral, even narration."),
        *(("v", t, "s") for t in body[2:]), ("CHAPTER", "K", "Measured, clear chapter announcement."), ("CHAPTER", "L", "Measured, clear chapter announcement."),
    ]
    assert sorted(r.entry_idx for r in found.collect() if r.book_id == "x") == list(range(len(entries["x"])))


def test_finished_tables_are_gone(spark, sf_dir):
    """Lines and paragraphs don't stay on disk through the steps after them."""
    mark = storage.stored_so_far()
    found = text_queries.single_speaker(spark, sf_dir)
    held = {path.rpartition("/")[2].rsplit("-", 5)[0] for path in storage._paths[mark:]}
    assert held == {"units", "scan"} and found.count() > 0
