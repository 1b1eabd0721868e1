"""The training-data operators against brute force, exact round trips and held-out pages."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptspark.llm import bestfit, common, gif, harmonic, labeller, mixing, passages, quality, sharding, simhash, tokens, warc, wordhash
from scriptspark.llm.htmlblocks import Blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a table column that clashes with working names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, long, "b"), (5, long, "b"), (5, long, "b"), (None, "x y z", None), (7, "x y z", "a")]
    return docs_of(spark, rows).withColumn("key", F.lit(1)).withColumn("start", F.lit(2)).withColumn("words", F.lit(3))


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).limit(0)


def components_of(nodes, links):
    least = {n: n for n in nodes}

    def find(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# Shared pieces -------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == components_of({n for a, b in links if a != b for n in (a, b)}, links)


def test_running_total(spark):
    rows = [(i % 3, i, (i * 7) % 11) for i in range(500)]
    df = common.store(spark.createDataFrame(rows, "k long, id long, n long"), "rows")
    got = common.running_total(df, ["k"], "n", ["id"], 9, "before").collect()
    for k in range(3):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: (r["before"], r["n"]))
        at = 0
        for r in own:
            assert r["before"] == at
            at += r["n"]


# 1 GIF ---------------------------------------------------------------------


def plain_decode(stream, bits):
    clear, width, at, n, out = 1 << bits, bits + 1, 0, int.from_bytes(stream, "little"), []
    table, last = {i: bytes([i]) for i in range(clear)}, None
    while at + width <= 8 * len(stream):
        code, at = n >> at & ((1 << width) - 1), at + width
        if code == clear:
            table, last, width = {i: bytes([i]) for i in range(clear)}, None, bits + 1
            free = clear + 2
            continue
        if code == clear + 1:
            break
        s = table[code] if code in table else last + last[:1]
        out.append(s)
        if last is not None and free < 4096:
            table[free] = last + s[:1]
            free += 1
        if free == 1 << width and width < 12:
            width += 1
        last = s
    return b"".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_lzw(seed):
    rng = random.Random(seed)
    raw = bytes(rng.choice(range(rng.choice([2, 5, 40, 256]))) for _ in range(rng.choice([1, 3, 500, 9000, 60_000])))
    packed = gif.compress(raw)
    assert gif.decompress(packed, 8, len(raw)).tobytes() == raw
    if len(raw) < 10_000:
        assert plain_decode(packed, 8) == raw
    assert gif.decompress(gif.compress(b"a" * 90_000), 8, 90_000).tobytes() == b"a" * 90_000


def test_gif_rules():
    """Local palette, transparency, disposal and interlace, on a file made by hand."""
    import struct

    def frame(pixels, w, h, left=0, top=0, disposal=1, transparent=None, interlace=False, delay=7):
        gce = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
        return gce + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlace) + b"\x02" + gif._blocks(gif.compress(bytes(pixels), 2))

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    body = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    body += frame([1, 1, 1, 1], 2, 2) + frame([2, 3], 2, 1, disposal=2, transparent=3) + frame([3], 1, 1, 1, 1, disposal=3) + frame([1, 2, 3, 0], 2, 2, interlace=True) + b"\x3b"
    m = gif.parse(body)
    shown = [c.copy() for c in gif.rendered(m)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert shown[0].tolist() == [[red, red], [red, red]]
    assert shown[1].tolist() == [[green, red], [red, red]]
    assert shown[2].tolist() == [[[0] * 4, [0] * 4], [red, blue]]
    assert m.frames[3].delay_ms == 70 and shown[3].tolist() == [[red, green], [blue, [0, 0, 0, 255]]]
    assert gif.histogram(shown[2])[0].tolist() == [1, 0, 0, 0, 0, 0, 0, 1]
    rows = gif._rows_in_order(9)
    assert sorted(rows.tolist()) == list(range(9)) and rows[:2].tolist() == [0, 8]


def test_op1(spark, documents, texts, odd, empty, sf_dir):
    got = {r["doc_id"]: r for r in gif.op1_gif_media(spark, sf_dir).collect()}
    for i, t in texts.items():
        raw = t.encode()
        full = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    more = gif.digest_media(gif.encode_column(odd, "doc_id", "text"), "doc_id", "media").collect()
    assert len(more) == 8 and {r["n_bytes"] for r in more if r["doc_id"] in (1, 2)} == {0}
    assert gif.digest_media(gif.encode_column(empty, "doc_id", "text"), "doc_id", "media").count() == 0
    media = gif.encode_column(odd.where("doc_id in (2, 4)"), "doc_id", "text").unionByName(spark.createDataFrame([(9, bytearray(b"GIF89a junk")), (10, None)], "doc_id long, media binary"))
    frames = gif.decode_frames(media, "doc_id", "media").collect()
    assert Counter(r["error"] is None for r in frames)[False] == 2 and sum(r["doc_id"] == 4 for r in frames) > 1


# 2 Mixing ------------------------------------------------------------------


def fill(sizes, weights, total):
    got, open_ = {}, set(sizes)
    while True:
        rest = total - sum(got.values())
        rate = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if rate * weights[s] > 2 * sizes[s]}
        if not over:
            return got | {s: rate * weights[s] for s in open_}
        got |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def held_mix(rows, texts):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values())) if sum(sizes.values()) else {}
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)


def test_op2(spark, documents, texts, odd, empty):
    got = mixing.mix(documents)
    rows = got.join(documents.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == len(texts)
    held_mix(rows, texts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(documents.repartition(7)).collect()))
    more = mixing.mix(odd).collect()
    assert len(more) == 8 and mixing.mix(empty).count() == 0
    assert abs(sum(r["taken"] for r in more) - 1.5 * sum(r["size"] for r in more)) <= 3
    assert all(r["taken"] == 2 * r["size"] for r in more if r["doc_id"] is None)
    pieces = mixing.stage(spark, documents, "")
    assert pieces.columns == documents.columns
    count = lambda t: len(t.encode().split())
    # every shard but the last is full, and another seed moves the draws
    placed, goals = mixing.place(documents)
    drawn = mixing.slots(goals).collect()
    per = Counter(r["shard"] for r in drawn)
    assert len({(r["shard"], r["slot"]) for r in drawn}) == len(drawn) and all(per[k] == mixing.SLOTS_PER_SHARD for k in range(max(per)))
    by_doc = Counter()
    for r in pieces.collect():
        by_doc[r["doc_id"]] += count(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert by_doc == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_draws_by_shard(spark, documents, monkeypatch):
    """Small shards: the tree's counts are those of the slots; a changed draw changes places, not totals; many sources, the same law."""
    _, goals = mixing.place(documents)
    plain = mixing.slots(goals, 8).collect()
    totals = Counter(r["rank"] for r in plain)
    counts = np.array([totals[k] for k in sorted(totals)], np.int64)
    per = Counter((r["shard"], r["rank"]) for r in plain)
    n_shards = -(-int(counts.sum()) // 8)
    assert n_shards > 20
    for shard in range(n_shards):
        first, n = mixing.shard_counts(counts, shard, 8)
        assert n.tolist() == [per[shard, k] for k in sorted(totals)] and int(n.sum()) == (8 if shard < n_shards - 1 else len(plain) - 8 * shard)
        assert first.tolist() == [sum(per[s, k] for s in range(shard)) for k in sorted(totals)]
    spots = lambda rows: {(r["rank"], r["block"], r["pass"]): (r["shard"], r["slot"]) for r in rows}
    monkeypatch.setattr(mixing, "SOURCES_HELD", 0)
    other = mixing.slots(goals, 8).collect()
    assert set(spots(other)) == set(spots(plain)) and sorted(spots(other).values()) == sorted(spots(plain).values())
    monkeypatch.undo()
    before = {tuple(r)[:5]: (r["shard"], r["slot"]) for r in mixing.mix(documents).collect()}
    assert before == {tuple(r)[:5]: (r["shard"], r["slot"]) for r in mixing.mix(documents.repartition(5)).collect()}
    assert spots(mixing.slots(goals, 8).collect()) == spots(plain) != spots(mixing.slots(goals, 8, seed=7).collect())
    rng = np.random.default_rng(1)
    drawn = np.array([mixing._taken_of(np.array([30, 60, 10]), 20, rng) for _ in range(400)])
    assert (drawn.sum(axis=1) == 20).all() and np.abs(drawn.mean(axis=0) - [6, 12, 2]).max() < 0.3
    large = mixing._taken_of(np.array([3 * 10**9, 10**9]), 2 * 10**9, rng)
    assert large.sum() == 2 * 10**9 and abs(large[0] - 1.5e9) < 1e6


@pytest.mark.parametrize("good, bad, take", [(1, 1, 1), (1, 10, 3), (7, 5, 6), (30, 970, 50), (3, 400, 390), (500, 500, 20)])
def test_op2_draws_follow_the_law(good, bad, take):
    """Draws of small numbers against the exact chances; of numbers beyond 1e12, mean and spread, and the chances against exact ratios."""
    rng, n = np.random.default_rng(good), 20_000
    low, high = max(0, take - bad), min(take, good)
    chance = np.array([math.comb(good, x) * math.comb(bad, take - x) / math.comb(good + bad, take) for x in range(low, high + 1)])
    seen = np.bincount([mixing._hypergeometric(good, bad, take, rng) - low for _ in range(n)], minlength=high - low + 1)
    held = chance * n >= 5
    chi = ((seen - chance * n)[held] ** 2 / (chance * n)[held]).sum()
    free = max(1, held.sum() - 1)
    assert chi < free + 5 * math.sqrt(2 * free) + 5 and seen[~held].sum() <= 5 + 3 * n * chance[~held].sum()
    big = 10**12
    wide = [mixing._hypergeometric(good * big, bad * big, take * big // 2, rng) for _ in range(500)]
    total, t = (good + bad) * big, take * big // 2
    mean, spread = t * good / (good + bad), math.sqrt(t * (good / (good + bad)) * (bad / (good + bad)) * ((total - t) / total))
    assert abs(np.mean(wide) - mean) < 5 * spread / math.sqrt(500) and 0.8 < np.std(wide) / spread < 1.2
    x, p, q = round(mean + spread), t / total, (total - t) / total
    step = mixing._log_binomial(x + 1, good * big, p, q) + mixing._log_binomial(t - x - 1, bad * big, p, q) - mixing._log_binomial(x, good * big, p, q) - mixing._log_binomial(t - x, bad * big, p, q)
    exact = math.log1p((((good * big - x) * (t - x)) - (x + 1) * (bad * big - t + x + 1)) / ((x + 1) * (bad * big - t + x + 1)))
    assert abs(step - exact) < 1e-9


def test_permutation():
    for n in (1, 2, 3, 10, 257, 1000):
        p = mixing._permuted(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n))
        assert mixing._permuted(p, n, 5, back=True).tolist() == list(range(n))


# 3 Block labeller ----------------------------------------------------------


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return labeller.fit(labeller.training_sample(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def test_gradients():
    rng = np.random.default_rng(3)
    page = labeller.composed(2, 1, ["a", "b", "c"])
    w = {k: v.astype(np.float64) for k, v in labeller.fresh(rng).items()}
    pages, labels = zip(*page, strict=True)
    _, g = labeller._gradients(w, list(pages), list(labels))
    for k, at in (("xf", (0, 5)), ("hb", (2, 7)), ("cf", (3,)), ("out", (4,)), ("path", (int(pages[0].path[0]), 2)), ("word", (int(pages[0].words[0]), 1))):
        own = []
        for d in (1e-3, -1e-3):
            moved = {**w, k: w[k].copy()}
            moved[k][at] += d
            own.append(labeller._gradients(moved, list(pages), list(labels))[0])
        assert abs((own[0] - own[1]) / 2e-3 - g[k][at]) < 2e-4 + 0.05 * abs(g[k][at]), k


def test_held_out_pages(weights):
    held = labeller.composed(150, 12345, [f"w{i}" for i in range(400)])
    wrong = total = 0
    for a in range(0, len(held), 50):
        part = held[a : a + 50]
        for (_, y), p in zip(part, labeller.scores(weights, [x for x, _ in part]), strict=True):
            wrong += int(((p > 0.5) != (y > 0.5)).sum())
            total += len(y)
    assert wrong <= 0.005 * total


def test_blocks():
    html = "<body><nav><ul><li><a href='/'>Home</a><li>Two</ul></nav><p>One &amp; two\n <b>bold</b><p>Three<script>x<p></script><!-- <p>no --><div class='ad'>Buy</div> tail"
    got = [(t, n > 0) for t, _, n in Blocks().split(html)]
    assert got == [("Home", True), ("Two", False), ("One & two bold", False), ("Three", False), ("Buy", False), ("tail", False)]


@pytest.mark.parametrize("html, want", [
    ('<article><p>One <svg class="i"/></p><p>Two</p></article>', ["One", "Two"]),
    ('<p>One<svg/></p><p>Two</p><svg><text>no</text></svg><p>Three</p>', ["One", "Two", "Three"]),
    ("<p>One</p><svg><p>Two</p>", ["One", "Two"]),
    ("<svg-icon>a</svg-icon><p>One</p><title-bar>Two</title-bar><template-x>Three</template-x>", ["a", "One", "Two", "Three"]),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<math/></p><p>Two</p>", ["So x=2 holds", "Two"]),
    ("<p>One</p><noscript><p>Two</p></noscript>", ["One", "Two"]),
])
def test_foreign_and_custom_elements(html, want):
    assert [t for t, _, _ in Blocks().split(html)] == want


@pytest.mark.parametrize("part", ["<p ", "<div>x", "<script ", "<svg>", "<!", "<a href='", "<b>x</q>", "<p title=\"a>", "<svg-x>"])
def test_hostile_pages_take_linear_time(part):
    began = time.process_time()
    Blocks().split(part * (200_000 // len(part)))
    assert time.process_time() - began < 6


def test_malformed_tags_keep_the_text():
    html = "<p title='it>One <b <i>two</i></p><svg a><title>no</title><path d='</p>'/></svg><p>three<svg/> four<p>five &lt; six"
    assert [b[0] for b in Blocks().split(html)] == ["One <b two", "three four", "five < six"]


def test_op3(spark, weights, sf_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in labeller.extract(pages, weights).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        text = "\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)
    strange = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>" * 3000, "t"), (4, "u", "a < b > c &bogus; <", "t")], "page_id long, url string, html string, text string")
    assert {r["page_id"]: r["text"] for r in labeller.extract(strange, weights).collect()}[1] == ""
    assert labeller.extract(strange.limit(0), weights).count() == 0


# 4 Sharding ----------------------------------------------------------------


def held_shards(rows, shards=16, slack=0.05):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes


def test_op4(spark, documents, texts, odd, empty, sf_dir):
    rows = sharding.op4_label_propagation(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    sizes = held_shards(rows)
    mean = sum(sizes.values()) / 16
    largest = max(r["size"] for r in rows)  # in so small a table a document can be as large as a shard
    assert all(abs(n - mean) < max(0.05 * mean, largest / 4) for n in sizes.values())
    groups = defaultdict(set)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= max(2, 0.05 * sum(n > 1 for n in Counter(texts.values()).values()))
    more = sharding.shard_documents(odd).collect()
    assert len(more) == 8 and {r["size"] for r in more if r["doc_id"] in (1, 2)} == {1}
    assert sharding.shard_documents(empty).count() == 0


def test_a_group_larger_than_a_shard_is_split(spark):
    df = docs_of(spark, [(i, "same text here" if i % 2 else f"text number {i} of many", "s") for i in range(1200)])
    sizes = held_shards(sharding.shard_documents(df).collect())
    mean = sum(sizes.values()) / 16
    assert all(abs(n - mean) <= 50 for n in sizes.values())


# 5 Passages ----------------------------------------------------------------


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


WORDS = [a + b for a in "ka lo mi nu pe ra so ti".split() for b in "bel dor fan gis hul jem kor lun".split()]


def spans_of(found, texts):
    """(doc_id, the words taken out, keeper, kind) of each span."""
    return {(r["doc_id"], " ".join(texts[r["doc_id"]].split()[r["start"] : r["start"] + r["words"]]), r["keeper"], r["kind"]) for r in found.collect()}


def later_windows(texts, gone=None, size=50):
    """For each text the places of words in runs of `size` that a text with a smaller id has as well; runs with a word of gone don't count."""
    first, out, gone = {}, {i: set() for i in texts}, gone or {}
    for i in sorted(texts):
        words, lost = texts[i].encode().lower().split(), gone.get(i, set())
        for at in range(len(words) - size + 1):
            if not lost.intersection(range(at, at + size)) and first.setdefault(tuple(words[at : at + size]), i) != i:
                out[i].update(range(at, at + size))
    return out


def nothing_lost(rows, texts):
    """Every word of a removed passage stays in the keeper, or where the keeper's own passages have it; no keeper's part goes with a paragraph."""
    words = {i: t.lower().split() for i, t in texts.items()}
    gone = defaultdict(set)
    for r in rows:
        if r["kind"] == "paragraph":
            gone[r["doc_id"]].update(range(r["start"], r["start"] + r["words"]))
    passage = defaultdict(list)
    for r in rows:
        if r["kind"] == "passage":
            passage[r["doc_id"]].append((r["start"], r["start"] + r["words"], r["keeper_doc_id"]))

    def stays(i, at):
        if at in gone[i]:
            return False
        held = [p for p in passage[i] if p[0] <= at < p[1]]
        return not held or any(found(i, *p, at) for p in held)

    def found(i, a, b, keeper, at):
        own = words[keeper]
        for low in range(max(a, at - 49), min(at, b - 50) + 1):
            run = words[i][low : low + 50]
            if any(own[k] == run[0] and own[k : k + 50] == run and stays(keeper, k + at - low) for k in range(len(own) - 49)):
                return True
        return False

    for i, held in list(passage.items()):
        for a, b, keeper in held:
            assert keeper < i and not gone[i].intersection(range(a, b))
            assert all(found(i, a, b, keeper, at) for at in (a, (a + b) // 2, b - 1)), (i, a, b, keeper)


def test_op5_passages_match_brute_force(spark):
    """Whole table: every run of 50 words that an earlier document has and keeps, no other word, and a keeper that has it."""
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got, gone, lines = defaultdict(set), defaultdict(set), 0
    joined = {i: " " + " ".join(t.lower().split()) + " " for i, t in texts.items()}
    rows = passages.op5_paragraph_minhash(spark, sf_dir).collect()
    for r in rows:
        if r["kind"] == "passage":
            got[r["doc_id"]].update(range(r["start"], r["start"] + r["words"]))
            words = texts[r["doc_id"]].lower().split()
            assert all(" " + " ".join(words[at : at + 50]) + " " in joined[r["keeper_doc_id"]] for at in (r["start"], r["start"] + r["words"] - 50))
        else:
            lines += 1
            gone[r["doc_id"]].update(range(r["start"], r["start"] + r["words"]))
            assert r["words"] >= passages.LEAST_WORDS and r["keeper_doc_id"] < r["doc_id"]
    want = later_windows(texts, gone)
    assert lines > 100 and sum(map(len, got.values())) > 1000
    assert {i: x for i, x in want.items() if x} == dict(got)
    nothing_lost(rows, texts)


def test_a_passage_whose_keeper_goes_stays_elsewhere(spark):
    """B is a near copy of A and holds a passage that C and D have: B goes, C keeps the passage, D loses it."""
    rng = random.Random(21)
    words = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10_000)}" for _ in range(n)]
    a, z = words(600), words(55)
    texts = {1: a, 2: [*a[:300], *z, *a[355:]], 3: [*words(100), *z, *words(100)], 4: [*words(80), *z, *words(90)]}
    texts = {i: " ".join(w) for i, w in texts.items()}
    df = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    rows = [r.asDict() | {"keeper_doc_id": r["keeper"]} for r in passages.removals(df).collect()]
    assert {(r["doc_id"], r["start"], r["words"], r["keeper"], r["kind"]) for r in rows} == {(2, 0, 600, 1, "paragraph"), (4, 80, 55, 3, "passage")}
    nothing_lost(rows, texts)
    out = {r["doc_id"]: r["text"] for r in passages.stage(spark, df, "").collect()}
    assert out[1] == texts[1] and out[3] == texts[3] and 2 not in out and " ".join(z) not in out[4]


def test_no_copy_is_lost_in_mixed_tables(spark):
    """Near copies, passages across them and passages that overlap one another, in random order."""
    for seed in range(3):
        rng = random.Random(seed)
        words = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10_000)}" for _ in range(n)]
        pool = [words(rng.randint(60, 200)) for _ in range(6)]
        texts = {}
        for i in range(40):
            lines = []
            for _ in range(rng.randint(1, 4)):
                line = list(rng.choice(pool)) if rng.random() < 0.5 else words(rng.randint(30, 120))
                if rng.random() < 0.4:
                    line[rng.randrange(len(line))] = "changed"
                if rng.random() < 0.5:
                    other = rng.choice(pool)
                    at = rng.randrange(len(other) - 50)
                    line[10:10] = other[at : at + rng.randint(50, 90)]
                lines.append(" ".join(line))
            texts[i] = "\n".join(lines)
        rows = [r.asDict() | {"keeper_doc_id": r["keeper"]} for r in passages.removals(docs_of(spark, [(i, t, "s") for i, t in texts.items()])).collect()]
        assert {r["kind"] for r in rows} == {"passage", "paragraph"}
        nothing_lost(rows, texts)


def test_planted_passages(spark):
    rng = random.Random(9)
    clean = {i: "\n".join(" ".join(sentence(rng, rng.randint(6, 14)) for _ in range(8)) for _ in range(4)) for i in range(60)}
    passage = " ".join(sentence(rng, 9) for _ in range(7))
    planted = {100 + i: "\n".join([sentence(rng, 12), sentence(rng, 10) + f" Mark{i}. " + passage + f" Then{i}. " + sentence(rng, 11), sentence(rng, 30)]) for i in range(12)}
    near = {}
    for i in range(10):
        words = clean[i].split("\n")[1].split(" ")
        words[20 + i] = "changed"
        near[200 + i] = sentence(rng, 20) + "\n" + " ".join(words)
    parts = [[rng.choice(WORDS) for _ in range(15)] for _ in range(6)]
    patched = {300 + i: " ".join([sentence(rng, 20), *p, sentence(rng, 20)]) for i, p in enumerate(parts)}
    patched[310] = " ".join(w for p in parts for w in p)  # no 50 words of it stand in one document
    texts = {**clean, **planted, **near, **patched}
    df = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    got = spans_of(passages.removals(df), texts)
    assert {x[0] for x in got} == {*range(101, 112), *range(200, 210)}
    assert all((i, passage, 100, "passage") in got for i in range(101, 112))
    out = {r["doc_id"]: r["text"] for r in passages.stage(spark, df, "").collect()}
    assert all(out[i] == t for i, t in {**clean, **patched}.items()) and out[100] == planted[100]
    assert [out[i] for i in range(101, 112)] == [planted[i].replace(passage + " ", "") for i in range(101, 112)]


def test_cut():
    text = " a b\n c  d e\n\nf g"
    assert passages.cut(text, [(2, 1)]) == " a b\nd e\n\nf g"
    assert passages.cut(text, [(3, 2)]) == " a b\n c\nf g"
    assert passages.cut(text, [(1, 1), (3, 1)]) == " a\nc e\n\nf g"
    assert passages.cut(text, [(0, 2), (1, 1)]) == "c  d e\n\nf g"
    assert passages.cut(text, [(5, 2)]) == " a b\n c  d e"
    assert passages.cut(text, [(0, 7)]) == "" and passages.cut(text, []) == text


def test_word_hashes():
    """Words, runs and least places against plain Python, over groups and words longer than a group."""
    rng = random.Random(6)
    texts = ["", "  ", *(" ".join(rng.choice(WORDS + ["Élan", "x" * 30]) for _ in range(rng.randint(1, 90))) + rng.choice("\n \t") for _ in range(50)), "y" * 1_200_000 + " z", "z " * 3000]
    words, h = [], []
    for _, part in wordhash.grouped(pa.array(texts)):
        w = wordhash.words_of(part)
        assert [w.first[i + 1] - w.first[i] for i in range(len(part))] == [len(t.split()) for t in part]
        words += [x.lower() for t in part for x in t.split()]
        h += w.h.tolist()
        if len(w.h) > 8:
            runs, same = w.windows(5)
            own = [x.lower() for t in part for x in t.split()]
            by = defaultdict(set)
            for i in np.flatnonzero(same).tolist():
                by[tuple(own[i : i + 5])].add(int(runs[i]))
            assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)
    assert len(words) == len(h) and len(set(zip(words, h))) == len(set(words)) == len(set(h))
    x = np.array([rng.randint(0, 6) for _ in range(300)], np.uint64)
    for size in (1, 2, 7, 35, 300):
        assert wordhash.least_places(x, size).tolist() == [min(range(i, i + size), key=lambda j: (x[j], j)) for i in range(300 - size + 1)]


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar_of(spark, df, same_band=False):
    """({h: component}, {doc_id: h}) of the paragraphs of one-line documents."""
    units = passages.scanned(df, "doc_id", "text").select("key", F.inline("paragraphs"))
    if same_band:
        units = common.store(units.withColumn("bands", F.array(F.lit(7).cast("long"))), "units")
    met = passages.in_buckets(units)
    sets = common.store(passages.read_again(df, "doc_id", "text", passages.set_spots(units, met)).select(F.inline("sets")), "sets")
    return {r["h"]: r["component"] for r in passages.similar(met, sets).collect()}, {r["key"]: r["h"] for r in units.collect()}


def linked_like_brute_force(spark, lines):
    got, hashes = similar_of(spark, docs_of(spark, [(i, " ".join(w), "s") for i, w in enumerate(lines)]))
    sets = [shingle_set(w) for w in lines]
    links = [(hashes[a], hashes[b]) for a, b in combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components_of(set(hashes.values()), links)
    same = lambda c: {frozenset(n for n in c if c[n] == k) for k in set(c.values())}
    assert same({n: got.get(n, n) for n in want}) == same(want)
    return same(want)


@pytest.mark.parametrize("small", [24, 2])
def test_similar_paragraphs_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(passages, "SMALL_BUCKET", small)  # 2: the prefix filter finds nearly all pairs
    rng = random.Random(10)
    base = [[rng.choice(WORDS) for _ in range(80)] for _ in range(25)]
    lines = []
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(80)] = "x" + rng.choice(WORDS)
            lines.append(w)
    linked_like_brute_force(spark, lines)


def test_a_large_bucket_of_many_families(spark):
    """One template in families that are under 0.8 to one another; each has two members that are over."""
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(220)]
    families = [c for c in combinations(range(37), 3) if sum(c) % 37 == 0]  # two share one changed place at most
    lines = []
    for f, places in enumerate(families):
        w = list(base)
        for at in places:
            w[5 + 5 * at] = f"x{f}"
        lines += [w, [*w[:-22], *(f"last{f}" + x for x in w[-22:])]]
    assert len(linked_like_brute_force(spark, lines)) == len(families) > 200


def test_copies_with_one_changed_word_name_few_pairs(spark):
    """Copies of one text, each with a word of its own: pairs named in their bucket are about those that are similar, not all."""
    rng = random.Random(17)
    base = [rng.choice(WORDS) + str(i) for i in range(60)]
    lines = []
    for i in range(150):
        at = rng.randrange(60)
        lines.append([*base[:at], f"own{i}", *base[at + 1 :]])
    ids = {x: i for i, x in enumerate(sorted(set().union(*map(shingle_set, lines))))}
    sets = [shingle_set(w) for w in lines]
    rows = common.store(spark.createDataFrame([(h, [ids[x] for x in s]) for h, s in enumerate(sets)], "h long, set array<long>"), "sets")
    open_ = common.store(rows.select("h", F.lit(7).cast("long").alias("band"), F.col("h").alias("component"), F.lit(150).cast("long").alias("n")), "open")
    named = {(r["a"], r["b"]) for r in passages._large_buckets(open_, rows).collect()}
    links = {(a, b) for a, b in combinations(range(150), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert components_of(set(range(150)), named & links) == components_of(set(range(150)), links)
    assert len(named) < 2 * len(links) < 3000


def test_short_lines_and_wrapped_text(spark):
    rng = random.Random(13)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    line, wrapped = words(30), words(88)
    lines_of = lambda w: "\n".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11))
    changed = list(wrapped)
    changed[30] = "xone"
    texts = [
        "\n".join([" ".join(words(60)), " ".join(line), " ".join(words(60))]),
        "\n".join([" ".join(words(60)), " ".join([*line[:-1], "xlast"]), " ".join(words(60))]),
        f"{lines_of(words(77))}\n\n{lines_of(wrapped)}\n\n{lines_of(words(99))}",
        f"{lines_of(words(66))}\n\n{lines_of(changed)}\n\n{lines_of(words(77))}",
        "\n".join([" ".join(words(70)), " ".join(line)]),
    ]
    got = {x[:3] for x in spans_of(passages.removals(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).where("kind = 'paragraph'"), texts)}
    assert got == {(1, " ".join([*line[:-1], "xlast"]), 0), (3, " ".join(changed), 2), (4, " ".join(line), 0)}


def test_passages_that_start_mid_sentence(spark):
    rng = random.Random(14)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    shared = {n: words(n) for n in range(49, 62)}
    texts = {}
    for n, w in shared.items():
        texts[n] = " ".join([*words(rng.randint(3, 90)), *w, *words(rng.randint(3, 90))]) + "."
        texts[100 + n] = " ".join([*words(rng.randint(3, 90)), *w, *words(rng.randint(3, 90))]) + "."
    got = spans_of(passages.removals(docs_of(spark, [(i, t, "s") for i, t in texts.items()])), texts)
    assert got == {(100 + n, " ".join(w) + "." * (texts[100 + n].endswith(" ".join(w) + ".")), n, "passage") for n, w in shared.items() if n >= 50}


def test_a_repeated_phrase_has_few_shingles(spark):
    """60 words and the same twice have similarity 0.93, whatever bucket they meet in."""
    rng = random.Random(15)
    one = [rng.choice(WORDS) for _ in range(60)]
    lines = [one, one * 2, *([rng.choice(WORDS) for _ in range(50)] for _ in range(3))]
    got, hashes = similar_of(spark, docs_of(spark, [(i, " ".join(w), "s") for i, w in enumerate(lines)]), same_band=True)
    assert set(got) == {hashes[0], hashes[1]}


def test_op5_odd_tables(spark, odd, empty):
    rng = random.Random(16)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(None, "one\n" + passage, "s"), (None, "two\n" + passage, "s"), (3, "three\n" + passage, "s"), (3, "other words", "s"), (3, "four\n" + passage, "s"), (3, "four\n" + passage, "s"), (9, passage + "\nfive", None)]
    docs, _, back = common.own_keys(docs_of(spark, rows), "doc_id", "text", "row")
    assert docs.select("row").distinct().count() == 6 and back.count() == 5
    got = passages.removals(docs, "row").collect()  # the key 9 of its own comes first
    assert {(r["keeper"], r["words"], r["kind"]) for r in got} == {(9, 60, "paragraph")} and len({r["row"] for r in got}) == 4
    left = Counter((r["doc_id"], r["text"]) for r in passages.stage(spark, docs_of(spark, rows), "").collect())
    assert left == Counter([(None, "one"), (None, "two"), (3, "three"), (3, "other words"), (3, "four"), (3, "four"), (9, passage + "\nfive")])
    assert {r["doc_id"] for r in passages.removals(common.own_keys(odd, "doc_id", "text", "row")[0], "row").join(common.own_keys(odd, "doc_id", "text", "row")[0], "row").collect()} == {5}
    assert passages.removals(empty).count() == 0
    kept = passages.stage(spark, odd, "")
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 7, None}
    assert passages.stage(spark, empty, "").collect() == []


# 6 and 10 Packing ----------------------------------------------------------


@pytest.fixture(scope="module")
def whole(texts):
    coder = tokens.coder(tokens.default_path())
    return {i: [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}


def test_word_coder(texts):
    coder = tokens.coder(tokens.default_path())
    rng = random.Random(4)
    letters = "aAzé'sß.,%*<|endoftext|> \n\t\x1c\x85\xa0 123İΣςÅÁ̸x-_~`\"()[]{}ŒœǅЖж中🙂"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    made += ["don't", "we'll", "x<|endoftext|>y", "<|startoftext|>", "THE", "a.b", "'s", "É", "áb"]
    for t in [*made, *texts.values()]:
        assert coder.ids(t).tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


def test_best_fit_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        most = rng.choice([5, 16, 100, 2048])
        lengths = [rng.randint(1, most) for _ in range(rng.randint(0, 80))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(most - n)
        rows = bestfit.best_fit(lengths, most)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(most - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


def test_op6(spark, whole, odd, empty, sf_dir):
    pieces = defaultdict(dict)
    rows = bestfit.op6_best_fit_decreasing(spark, sf_dir).collect()
    for r in rows:
        ids, at, ends = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 2048 and ends[-1] == r["n_tokens"] <= 2048
        for k, (d, s) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
            pieces[d][s] = ids[ends[k] : ends[k + 1]].tolist()
            assert at[ends[k] : ends[k + 1]].tolist() == list(range(ends[k + 1] - ends[k]))
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in pieces.items()} == whole
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert sum(len(r["doc_ids"]) for r in bestfit.best_fit_pack(odd).collect()) >= 8
    assert bestfit.best_fit_pack(empty).count() == 0


def test_cuts():
    for n in range(1, 9000, 7):
        c = harmonic.cuts(n)
        assert sum(c) == n and all(x <= 2048 for x in c) and sum(x < 64 for x in c) <= 1
        # a full bin of a piece's class wastes under a hundredth, one of short pieces under 2 * 64
        assert all((2048 // x) * x > (2048 * 0.98 if x >= 64 else 2048 - 128) for x in c)


def held_pack(rows, whole):
    tokens_of, bins = Counter(), defaultdict(list)
    for r in rows:
        if whole is not None:
            ids = np.array(whole[r["doc_id"]], "<u4")
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        tokens_of[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    used = []
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
        used.append(at)
    return tokens_of, used


def test_op10(spark, whole, odd, empty, sf_dir):
    got = harmonic.op10_harmonic_packing(spark, sf_dir).collect()
    tokens_of, used = held_pack(got, whole)
    assert tokens_of == Counter({i: len(x) for i, x in whole.items()})
    assert sum(used) >= 0.98 * 2048 * len(used)
    ids = {r["sequence_id"] for r in got}
    assert ids == set(range(len(ids)))
    held_pack(harmonic.harmonic_pack(odd).collect(), None)
    assert harmonic.harmonic_pack(odd).where("doc_id = 1").collect()[0]["doc_tokens"] == 1
    assert harmonic.harmonic_pack(empty).count() == 0
    ids = harmonic.harmonic_pack(docs_of(spark, [(1, "a b c", "s")]), with_ids=True).first()
    assert zlib.crc32(np.array(ids["ids"], "<u4").tobytes()) == ids["ids_crc32"]


@pytest.mark.parametrize("tasks", [1, 5])
def test_harmonic_bins_match_brute_force(spark, texts, tasks):
    """All but the common bins hold exactly k pieces of one class, and there are as many as counting gives."""
    docs = docs_of(spark, [(i, t, "s") for i, t in texts.items()]).repartition(tasks, "doc_id")
    rows, bins = harmonic.harmonic_pack(docs).collect(), defaultdict(list)
    held_pack(rows, None)
    for r in rows:
        bins[r["sequence_id"]].append(2048 // r["length"])
    n = Counter(k for b in bins.values() for k in b)
    want = Counter({k: m // k for k, m in n.items() if m >= k})
    common = sum(want.values())
    full = [b for i, b in bins.items() if i < common]
    assert all(len(b) == b[0] and len(set(b)) == 1 for b in full) and Counter(b[0] for b in full) == want
    left = [x for i, b in bins.items() if i >= common for x in b]
    assert Counter(left) == Counter({k: m % k for k, m in n.items() if m % k})


# 7 WARC --------------------------------------------------------------------


def held_captures(rows, pages):
    most = {}
    for i, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            most[raw] = max(most.get(raw, i), i)
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        keeper = most.get(raw)
        revisit = keeper is not None and i is not None and i < keeper
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=key) == sorted(want, key=key)


def read_all(pages):
    places, folder, index, listed, tasks = warc.archive(pages)
    return warc.read_captures(warc.lookup(places.select("page_id", "surt"), index, listed, tasks), folder, tasks).collect(), (places, folder, index, listed)


def test_op7(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    held_captures(warc.op7_warc_index(spark, sf_dir).collect(), [tuple(r) for r in pages.collect()])
    rows = [(1, "http://a.b/x", "y" * 2000), (2, "http://a.b/x", "y" * 2000), (5, None, "y" * 2000), (5, "q", "y" * 2000), (None, "http://u@www.A.b:8080/x?q#f", None), (7, "http://a.b/x\nz", "s"), (7, "http://a.b/x\nz", "s"), (8, "é", "é" * 700), (-1, "http://u@www.A.b:8080/x?q#f", "minus one")]
    got, _ = read_all(spark.createDataFrame(rows, "page_id long, url string, html string"))
    held_captures(got, rows)
    assert read_all(spark.createDataFrame([], "page_id long, url string, html string"))[0] == []


def test_records_are_whole_http_messages():
    headers, payload = warc.read_record(warc._record(3, "http://a/", "é\r\n\r\nx".encode(), "d", None, "", "2020-01-01T00:00:00Z"))
    assert payload.decode() == "é\r\n\r\nx" and {"WARC-Date", "WARC-Record-ID", "WARC-Type", "Content-Length"} <= set(headers)
    revisit, nothing = warc.read_record(warc._record(1, "http://a/", b"xyz", "d", 3, "http://b/", "2020-01-01T00:00:00Z"))
    assert nothing == b"" and revisit["Payload-Length"] == "3" and revisit["WARC-Refers-To-Target-URI"] == "http://b/"
    assert revisit["WARC-Record-ID"] != headers["WARC-Record-ID"]


def test_join_hot(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 1, id) as k")
    few = spark.createDataFrame([(1, "a"), (950, "b"), (5000, "c")], "k long, v string")
    got = sorted(map(tuple, common.join_hot(rows, few, "k", "id").select("id", "v").collect()))
    assert got == sorted([(i, "a") for i in range(900)] + [(950, "b")])


def test_surt_and_absent_keys(spark):
    assert warc.surt("https://www.Example.com:443/a?b#c") == "com,example)/a?b"
    assert warc.surt("http://u@m.example.com:8080") == "com,example,m:8080)/"
    df = spark.createDataFrame([(i, f"http://h{i % 5}.org/{i}", "x") for i in range(2000)], "page_id long, url string, html string")
    _, (places, folder, index, listed) = read_all(df)
    look = warc.Index(index, listed)
    assert look.find("org,h3)/3", 3) and not look.find("org,h3)/3", 4) and not look.find("a", 1) and not look.find("zz", 1)
    assert all(len(look.find(warc.surt(f"http://h{i % 5}.org/{i}"), i)) == 1 for i in range(2000))


# 8 Quality -----------------------------------------------------------------


def plain_counts(t):
    words = t.encode().split()
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    hit = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_op8(spark, texts, odd, empty, sf_dir):
    rows = {r["doc_id"]: r for r in quality.op8_host_rules(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        r = rows[i]
        n = plain_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r["base_failed"] and r["kept"])
    assert quality.judge(odd).count() == 8 and quality.judge(empty).count() == 0
    kept = quality.stage(spark, odd, "")
    assert kept.columns == odd.columns and all(r["doc_id"] not in (1, 2, 3) for r in kept.collect())


def test_host_verdicts(spark):
    plain, junk = " ".join(f"word{i}" for i in range(40)), " ".join(f"word{i}%%" for i in range(40))
    rows = [(i, junk if i % 2 else plain, "bad") for i in range(200)] + [(1000 + i, junk if i == 0 else plain, "good") for i in range(200)] + [(2000, junk, "tiny"), (2001, plain, None)]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, rows)).collect()}
    assert got[0]["kept"] and not got[1]["kept"] and got[1001]["kept"] and got[1000]["kept"] and got[2001]["kept"]
    assert 0.005 < got[2000]["host_rate"] < 1  # one document doesn't settle a host's rate


# 9 SimHash -----------------------------------------------------------------


def plain_fingerprint(t):
    words = t.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op9(spark, texts, odd, empty, sf_dir):
    rows = {r["doc_id"]: r for r in simhash.op9_simhash(spark, sf_dir).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == prints and all(len(r["fingerprint"]) == 16 for r in rows.values())
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in rows.items()} == components_of(prints, links)
    groups = lambda df: simhash.near_duplicates(common.store(simhash.with_fingerprint(df), "fingerprints"), "doc_id")
    assert groups(odd).count() == 8 and groups(empty).count() == 0
    kept = simhash.stage(spark, odd, "").collect()
    assert simhash.stage(spark, empty, "").collect() == []
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 4, 7]


def test_links_match_brute_force(spark):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for _ in range(rng.randint(1, 4)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_variants_are_not_broadcast(spark, monkeypatch):
    """A small file of fingerprints gives 64 times its rows, and well-pressed files many rows: no file size makes them a broadcast."""
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    marked = common.store(spark.range(300).selectExpr("id as doc_id", "id * id * 7919 as fp"), "fingerprints")
    assert "BroadcastHashJoin" not in plan_of(simhash.links(marked.select("fp")))
    assert "BroadcastHashJoin" not in plan_of(simhash.near_duplicates(marked, "doc_id"))


# Pipeline ------------------------------------------------------------------


def test_pipeline(spark, sf_dir, texts, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{common.shared_folder(spark)}/test-{name}-{random.random()}"
        stage(spark, seen[-1], sf_dir).write.parquet(path)
        seen.append(spark.read.parquet(path))
    assert all(df.columns == docs.columns for df in seen[:-1])
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in seen[1].collect()} == kept
    prints = {i: plain_fingerprint(texts[i]) for i in kept}
    roots = components_of(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    sets = {i: shingle_set(texts[i].encode().lower().split()) for i in set(roots.values())}
    again = components_of(sets, [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert {r["doc_id"] for r in seen[2].collect()} == set(again.values())
    words = lambda df: sum(len(r["text"].encode().split()) for r in df.collect())
    assert abs(words(seen[4]) - 1.5 * words(seen[3])) <= 20
    tokens_of, used = held_pack(seen[5].collect(), None)
    assert set(tokens_of) == {r["doc_id"] for r in seen[4].collect()}
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, got.drop("ids").collect())) == sorted(map(str, seen[5].drop("ids").collect()))
    own = quality.judge(docs_of(spark, [(1, "x y z", "s")])).where("not kept")  # stays readable through the release of the stages
    for start, ids in ((odd, {4}), (odd.limit(0), set())):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, "odd")
            if name != "harmonic_packing":
                path = f"{common.shared_folder(spark)}/odd-{name}-{random.random()}"
                at.write.parquet(path)
                at = spark.read.parquet(path)
                assert at.columns == odd.columns
        assert {r["doc_id"] for r in at.collect()} <= ids
    assert own.count() == 1


def test_anchors_are_gone_before_texts_are_read_again(spark, monkeypatch):
    """What every document's anchors take is not held on disk through the later steps."""
    held, read_again = [], passages.read_again
    monkeypatch.setattr(passages, "read_again", lambda *a: held.extend(x[1] for x in common._paths[mark:]) or read_again(*a))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60)) + f" x{i % 2}") for i in range(4)], "doc_id long, text string")
    mark = common.stored_so_far()
    found = passages.removals(docs)
    assert held and not any("/scanned-" in path for path in held)
    assert {r.doc_id for r in found.collect()} == {1, 2, 3}


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """Band keys, moved windows and keys of kept documents grow with the texts: small files don't make them a broadcast."""
    plans, store = {}, common.store
    see = lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and store(df, name)
    monkeypatch.setattr(passages, "store", see)
    monkeypatch.setattr(simhash, "store", see)
    small = common.broadcast_if_small
    for module in (passages, simhash):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, most=20_000, **b: small(df, 0, **b))
    text = lambda i: " ".join(f"w{j}" for j in range(60)) + f" x{i % 2} " + " ".join(f"y{i}z{j}" for j in range(i * 10))
    docs = common.store(spark.createDataFrame([(i, text(i)) for i in range(4)], "doc_id long, text string"), "docs")
    kept = simhash.stage(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {0, 2, 3}
    assert {r.doc_id for r in passages.removals(docs).collect()} == {1, 2, 3}
    assert not {name for name in ("buckets", "moved-contexts", "first-texts") if "BroadcastHashJoin" in plans[name]}
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
