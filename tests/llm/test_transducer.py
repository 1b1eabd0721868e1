"""Token counts against the tokenizer library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scriptspark.llm import transducer
from scriptspark.llm.tokens import default_path

ODD = [
    "", " ", "\n\t", "don't we'll they're I'VE 's 'said !'s a''s 'r 're're'''ll l'l 'lx", "1'2's 3'll '", "12 345.67\x1c\x1d x\x85y　z",
    "a<|endoftext|>b <|startoftext|><|endoftext|> <|endoftext |>", "<|ENDOFTEXT|>", "日本語テキスト" * 50, "İSTANBUL ẞß ΑΣ ΣΑΣ é é 가 가",
    "😂" * 40 + "!!…", "\x00\x01", "a" * 127 + " " + "b" * 128 + "c" * 300, "x" * 1000, "ab" * 3000 + " c", "!?" * 2000, "привет, мир " * 30,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def compiled():
    return transducer.tokenizer(default_path())


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_token_of_the_vocabulary(library, compiled):
    words = [t.replace("</w>", "") for t in library.get_vocab()]
    assert compiled.counts(words).tolist() == wanted(library, words)


def test_odd_texts(library, compiled):
    assert compiled.counts(ODD).tolist() == wanted(library, ODD)
    assert compiled.counts([None]).tolist() == [0]


def test_random_texts_without_blanks(library, compiled):
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoin'sr1!é") for _ in range(rng.randrange(1, 900))) for _ in range(200)]
    texts += ["".join(rng.choice("thean ") for _ in range(rng.randrange(1, 900))) for _ in range(200)]
    assert compiled.counts(texts).tolist() == wanted(library, texts)


def test_plain_code_points_are_lowered_as_the_library_does(library):
    plain = [chr(c) for c in range(0xE000) if transducer._plain(chr(c))]
    assert len(plain) > 30_000
    got = [(c.lower(), library.normalizer.normalize_str(c)) for c in plain]
    # white space becomes a blank, which ends runs all the same
    assert [x for x in got if x[0] != x[1] and not (x[1] == " " and library.pre_tokenizer.pre_tokenize_str(x[0]) == [])] == []


def test_long_texts_are_cut_at_blanks(library, compiled, monkeypatch):
    text = "It's the Étude of 12 words, don't  cut\n\nthem <|endoftext|> wrongly! " * 200
    monkeypatch.setattr(transducer, "PIECE", 37)
    monkeypatch.setattr(transducer, "BLOCK", 500)
    assert len(compiled.pieces(text)[0]) > 100
    assert compiled.counts([text, "", text]).tolist() == wanted(library, [text, "", text])


def test_compilation_anew(library, monkeypatch):
    fresh = transducer.Tokenizer(default_path())
    monkeypatch.setattr(transducer, "MOST", 10)
    texts = ["some quite ordinary words", "and others of them"]
    assert fresh.counts(texts).tolist() == wanted(library, texts)
    assert fresh.n_kept == 0
    assert fresh.counts(texts).tolist() == wanted(library, texts)


def test_prefix_scan_of_state_maps(compiled):
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 4, 5000).astype(np.uint8)
    state, want = transducer.OPEN, []
    for k in kind.tolist():
        want.append(bool(compiled.starts[k * transducer.STATES + state]))
        state = int(compiled.next[k * transducer.STATES + state])
    assert compiled.run_starts(kind).tolist() == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "a b", "y"), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = transducer.token_counts(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 0, False), (1, 3, 2, False), (1, 3, 2, False), (None, 3, 2, False), (2, 0, 0, False)], key=str)
    assert transducer.token_counts(docs.where(F.lit(False))).count() == 0
    assert {r.over_limit for r in transducer.token_counts(docs, limit=1).where("n_tokens = 2").collect()} == {True}


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: n for d, n in zip(docs, wanted(library, [d.text or "" for d in docs]), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in entry.queries()["op13_transducer_counts"](spark, sf_dir).collect()}
    assert got == {d.doc_id: (len((d.text or "").encode()), want[d.doc_id], want[d.doc_id] > 2048) for d in docs}
