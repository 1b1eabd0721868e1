"""Alignment of two tokenizers against whole-text encoding and a plain merge."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scriptspark.llm import alignment

ODD = [
    "Plain words, and more of them. " * 200, "don't  stop\n\nnow\t <s>x</s> <|endoftext|> <unk>", " leading", "trailing ", "é ü ç “quoted” – dash…",
    "日本語のテキスト " * 90, "😂 mixed 한국어 текст", "\x00nul", "a" * 5000, "　 wide", "x", " ", "ﬁ é́ ​", "same text", "same text", "1234567890 " * 30,
]


@pytest.fixture(scope="module")
def pair():
    return alignment._pair(*alignment.default_paths())


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.default_paths()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=b)


def brute(library, texts):
    """(n_a, n_b, n_groups, links, groups) of each text, whole texts encoded, tokens met one by one."""
    letters = {c: b for b, c in enumerate(alignment._byte_letters())}
    names = {i: bytes(letters[c] for c in t if c in letters) for t, i in library[0].get_vocab().items()}
    out = []
    for text in texts:
        a = library[0].encode(f" {text}", add_special_tokens=False).ids if text else []
        b = library[1].encode(text) if text else []
        x = [names[i] for i in a]
        y = [bytes([int(p[3:5], 16)]) if library[1].is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [library[1].id_to_piece(i)]]
        if not text or b"".join(x) != f" {text}".encode() or b"".join(y) != f" {text}".encode():
            out.append((0, 0, 0, [], ""))
            continue
        i = j = n = at = end_a = end_b = 0
        links, groups, own = [], [], ([], [])
        while i < len(a):
            if end_a == at:
                end_a = at + len(x[i])
                own[0].append(a[i])
            if end_b == at:
                end_b = at + len(y[j])
                own[1].append(b[j])
            links.append((a[i], b[j]))
            at = min(end_a, end_b)
            if end_a == end_b:
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                n, own = n + 1, ([], [])
            i, j = i + (end_a == at), j + (end_b == at)
        out.append((len(a), len(b), n, links, ";".join(groups)))
    return out


def wanted(library, texts):
    found = brute(library, texts)
    count = Counter(x for f in found for x in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (na, nb, n, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if na else "")
        for na, nb, n, links, groups in found
    ]


def test_lanes_give_what_whole_texts_give(pair, library, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", 40)
    assert len(alignment._split(ODD[0])) > 1000
    sums, of, pairs, times = alignment.align(pair, ODD)
    got = list(zip(*(list(v) for v in sums.values()), strict=True))
    want = [(na, nb, n, len(links), hashlib.sha256(g.encode()).hexdigest() if na else "") for na, nb, n, links, g in brute(library, ODD)]
    assert got == want
    held = Counter({(t, p >> 15, p & 32767): n for t, p, n in zip(of.tolist(), pairs.tolist(), times.tolist(), strict=True)})
    assert held == Counter((t, *x) for t, f in enumerate(brute(library, ODD)) for x in f[3])
    assert sum(na > 0 for na, *_ in want) >= 14


def test_settled_characters_by_both_engines(pair):
    settled = [chr(c) for c in range(0xE000) if alignment._settled(chr(c))]
    assert len(settled) > 30_000
    for form in (" a{0}a 1{0}1 !{0}! {0}  {0} {0}'s",):
        texts = [form.format(c) for c in settled]
        assert [pair.fast.encode_ordinary(x) for x in texts] == [e.ids for e in pair.a.encode_batch(texts, add_special_tokens=False)]


def test_counts_over_all_documents(spark, library):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(3, ODD[3], 9), (None, ODD[1], 9), (50, None, 9), (51, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair long").repartition(3)
    got = alignment.alignments(docs, block_bytes=200)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(k, *w) for (k, _, _), w in zip(rows, wanted(library, [t or "" for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert alignment.alignments(docs.where(F.lit(False))).count() == 0


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in entry.queries()["op12_lockstep_alignment"](spark, sf_dir).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, wanted(library, [d.text or "" for d in docs]), strict=True)}
