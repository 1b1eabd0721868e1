"""Alignment of two tokenizers' tokens over the same bytes.

A text, with a space before it, is encoded by A (a byte-level BPE file) and by B (a piece model with byte fallback,
which adds the space itself). Two tokens are linked where their byte ranges overlap; where tokens of both end at one
byte, a group ends.

Tokens of both end at single spaces between words, so a block's distinct words are encoded once and texts put together from them.
The merge runs in lockstep: long texts are cut in lanes at such spaces, and every
lane of a block has a place in one state vector of two pointers. Each step emits the link of
each lane's two tokens, notes whether both end there (a cut), and advances the pointer whose token ends first, or both; lanes
that are done leave the vector. So a block of any texts takes as many steps as its longest lane has links.

How often a pair is linked is counted over all documents: each block gives its distinct pairs once, Spark sums
them and finds the most frequent of each B id, and what a block's pairs came to goes back to that block alone, so
no pair stands on more rows than there are blocks.

Null and empty texts, and those whose tokens don't give back the text's bytes (a space before them), have no tokens: zeros
and an empty groups_sha256. Special tokens' strings are plain text. Texts of any length are read whole. Keys may be null or
repeated: every row gives a row, and each counts. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .tokens import _byte_letters

#: Bytes of a lane of the state vector, and bytes of a block.
LANE, BLOCK = 2048, 1 << 21
#: Characters of distinct words that are encoded together.
TOGETHER = 1 << 14

_ENDS, _BEGINS = "[\x21-\x7e¡-ɏЀ-џ‐-‧一-鿿가-힣]", "[A-Za-z0-9À-ɏЀ-џ]"
_split = re.compile(f"(?<={_ENDS}) (?={_BEGINS})").split
#: Texts whose characters every version of Unicode takes for the same kind: the fast engine serves for them.
_settled = re.compile("[\t\n\r\x20-\x7e¡-ɏЀ-џ‐-‧一-鿿가-힣]*").fullmatch
#: Words that can stand side by side in one text.
_clean = re.compile(f"(?s)(?={_BEGINS}).*(?<={_ENDS})").fullmatch


class _Tokens:
    """Ids of distinct words, laid end to end, and of any sequence of these."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, back: np.ndarray, size: np.ndarray):
        self.n, self.first = n[back], (np.cumsum(n) - n)[back]
        self.flat, self.size = flat, size

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the byte after each, where each word's begin, and the end)."""
        n = self.n[words]
        start = np.r_[0, np.cumsum(n)]
        ids = self.flat[np.repeat(self.first[words] - start[:-1], n) + np.arange(start[-1])]
        return ids, np.cumsum(self.size[ids]), start


class Pair:
    """The two tokenizers, their tokens' bytes, and each id's decimal form with what can follow it."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(_byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # ids go by the order of merges, so they are the ranks that this engine wants
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = {i: t for t, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(i) for i in range(n))}
        if n > 1 << 15 or max(self.bytes_a) >= 1 << 16:
            raise ValueError("ids of A take 16 bits, ids of B 15")
        self.size_a, self.size_b = (np.array([len(t.get(i, b"")) for i in range(max(t) + 1)], np.int64) for t in (self.bytes_a, self.bytes_b))
        top = max(len(self.size_a), n)
        # by side, whether it is the last of its group, and id
        self.spelled = [f"{i}{c}".encode() for c in (",", "|", ",", ";") for i in range(top)]
        self.top = top

    def encode(self, words: list[str]) -> tuple[_Tokens, _Tokens, np.ndarray]:
        """(each word's ids under A and under B, a space before it; whether they don't give back its bytes)."""
        plain = [i for i, w in enumerate(words) if _clean(w) and _settled(w)]
        rest = sorted(set(range(len(words))).difference(plain))
        parts, order, begin, size = [], [], 0, 0
        for k, i in enumerate(plain):
            size += len(words[i])
            if size >= TOGETHER or k + 1 == len(plain):
                own = plain[begin : k + 1]
                found = self._together([words[i] for i in own])
                if found is None:
                    rest += own
                else:
                    parts.append(found)
                    order += own
                begin, size = k + 1, 0
        if rest:
            parts.append(self._apart([words[i] for i in rest]))
        back = np.empty(len(words), np.int64)
        back[np.array(order + rest, np.int64)] = np.arange(len(words))
        flat_a, n_a, flat_b, n_b, lost = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * 5))
        return _Tokens(flat_a, n_a, back, self.size_a), _Tokens(flat_b, n_b, back, self.size_b), lost.astype(bool)[back]

    def _together(self, words: list[str]) -> tuple | None:
        """(ids, ids per word) under A and B and what is lost (nothing), from one text of all words; None where bytes don't come back."""
        text = " ".join(words)
        raw = f" {text}".encode()
        ends = np.cumsum(np.array(list(map(len, words)) if text.isascii() else [len(w.encode()) for w in words], np.int64) + 1)
        out = []
        for ids, size, table in ((self.fast.encode_ordinary(f" {text}"), self.size_a, self.bytes_a), (self.b.encode(text), self.size_b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            flat = np.array(ids, np.int64)
            last = np.searchsorted(np.cumsum(size[flat]), ends) + 1
            out += flat, np.diff(np.r_[0, last])
        return *out, np.zeros(len(words), bool)

    def _apart(self, words: list[str]) -> tuple:
        """The same, word by word, by the libraries that define the ids."""
        a = [e.ids for e in self.a.encode_batch([f" {w}" for w in words], add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        lost = np.array([not self._whole(*x) for x in zip(words, a, b, strict=True)], bool)
        flat = [x for ids in (a, b) for x in (np.array(list(chain.from_iterable(ids)), np.int64), np.array(list(map(len, ids)), np.int64))]
        return *flat, lost

    def _whole(self, word: str, a: list[int], b: list[int]) -> bool:
        raw = f" {word}".encode("utf-8", "surrogatepass")
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw


def lockstep(end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, place in A, place in B) of every link of all lanes.

    end_a, end_b: the byte after each token, counted alike in both; at_a, at_b: each lane's first token; until: the place after
    its last token of A. A step emits one link of every lane in the state vector.
    """
    lane, i, j = np.arange(len(at_a)), at_a.copy(), at_b.copy()
    links: list[tuple] = []
    live = i < until
    lane, i, j, until = lane[live], i[live], j[live], until[live]
    while len(lane):
        links.append((lane, i, j))
        a, b = end_a[i], end_b[j]
        i, j = i + (a <= b), j + (b <= a)
        live = i < until
        if not live.all():
            lane, i, j, until = lane[live], i[live], j[live], until[live]
    if not links:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*links, strict=True))


def align(pair: Pair, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray, np.ndarray]:
    """(columns n_a, n_b, n_groups, n_links, groups_sha256; and of each text's distinct linked pairs: text, pair, how many links)."""
    number: dict[str, int] = {}
    sequence, counts, n = [], [], len(texts)
    for text in texts:
        own = [number.setdefault(w, len(number)) for w in _split(text)] if text else []
        sequence += own
        counts.append(len(own))
    words, text_of = np.array(sequence, np.int64), np.repeat(np.arange(n), counts)
    of_a, of_b, lost = pair.encode(list(number))
    if lost.any():
        kept = (np.bincount(text_of, lost[words], n) == 0)[text_of]
        words, text_of = words[kept], text_of[kept]
    (a, end_a, first_a), (b, end_b, first_b) = of_a.of(words), of_b.of(words)
    # a lane begins with a text, and about every LANE bytes of it
    byte = np.r_[0, end_a][first_a[:-1]]
    begin = np.searchsorted(text_of, text_of)
    place = (byte - byte[begin]) // LANE
    head = np.flatnonzero(np.r_[True, (text_of[1:] != text_of[:-1]) | (place[1:] != place[:-1])]) if len(words) else np.zeros(0, np.int64)
    lane, i, j = lockstep(end_a, end_b, first_a[head], first_b[head], first_a[np.r_[head[1:], len(words)]] if len(head) else first_a[head])
    cut, lane_of = end_a[i] == end_b[j], text_of[head]
    sums = {
        "n_a": np.bincount(text_of, np.diff(first_a), n).astype(np.int64), "n_b": np.bincount(text_of, np.diff(first_b), n).astype(np.int64),
        "n_groups": np.bincount(lane_of[lane[cut]], minlength=n).astype(np.int64), "n_links": np.bincount(lane_of[lane], minlength=n).astype(np.int64),
    }
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[i[cut]], last_b[j[cut]] = True, True
    sums["groups_sha256"] = _digests(pair, a, b, last_a, last_b, np.cumsum(sums["n_a"] + sums["n_b"]))
    key, times = np.unique(lane_of[lane] << 31 | a[i] << 15 | b[j], return_counts=True)
    return sums, key >> 31, key & (1 << 31) - 1, times


def _digests(pair: Pair, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, until: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups: A's ids, then B's, group by group. until: where each text's tokens end."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b, before_a = np.r_[0, np.flatnonzero(last_b) + 1], np.r_[0, np.flatnonzero(last_a) + 1]
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + before_b[group_a]] = a + last_a * pair.top
    code[np.arange(len(b)) + before_a[group_b + 1]] = b + (2 + last_b) * pair.top
    parts = list(map(pair.spelled.__getitem__, code.tolist()))
    out, at = [], 0
    for end in until.tolist():
        out.append(hashlib.sha256(b"".join(parts[at:end])[:-1]).hexdigest() if end > at else "")
        at = end
    return out


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_DOC = "block long, row int, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks of about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
        begin = 0
        for k, x in enumerate(sizes):
            size += x
            if size >= most:
                yield pa.Table.from_batches([*held, batch.slice(begin, k + 1 - begin)]).combine_chunks().to_batches()[0]
                held, size, begin = [], 0, k + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def linked(docs: DataFrame, key: str, text: str, paths: tuple[str, str], block_bytes: int = BLOCK) -> DataFrame:
    """One stored row per document, its distinct pairs and their links among them; and one per block and distinct pair (pair, n; key and the rest null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = _pair(*paths), TaskContext.get().partitionId()
        for number, batch in enumerate(_blocks(batches, block_bytes)):
            block, n = task << 32 | number, batch.num_rows
            sums, of, pairs, times = align(pair, batch.column(1).to_pylist())
            cuts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
            held = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pairs, times)]
            rows = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), batch.column(0), *(pa.array(x) for x in sums.values()), *held]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
            one, back = np.unique(pairs, return_inverse=True)
            count = np.bincount(back, times, len(one)).astype(np.int64)
            blank = [pa.nulls(len(one), t) for t in types]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), block)), *blank, pa.array(one.astype(np.int32)), pa.array(count)], names)

    names = [x.split()[0] for x in _DOC.split(", ")] + ["pair", "n"]
    ints = pa.list_(pa.int32())
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), ints, ints]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return store(rows.mapInArrow(run, f"{_DOC}, pair int, n long"), "linked")


def alignments(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per document."""
    rows = linked(docs, key, text, paths or default_paths(), block_bytes)
    of_block = rows.where("pair is not null").select("block", "pair", "n")
    counted = of_block.groupBy("pair").agg(F.sum("n").alias("count"))
    # a B id has at most as many pairs as A has ids
    best = F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 15) - 1))))
    known = of_block.join(counted.select("pair", "count", best.alias("best")), "pair").select("block", "pair", "count", "best")
    docs_ = rows.where("pair is null").drop("pair", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(begin, end - begin)
                if blocks[begin] != block:
                    block, held, ready = blocks[begin], [], None
                n = part.num_rows - part.column("row").null_count
                pairs, own = part.slice(0, part.num_rows - n), part.slice(part.num_rows - n)
                if pairs.num_rows:
                    held.append([pairs.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")])
                if not n:
                    continue
                if ready is None:
                    pair, count, best = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
                    order = np.argsort(pair)
                    ready = pair[order], count[order].astype(np.int64), best[order].astype(np.int64)
                lists, times = own.column("pairs"), own.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.searchsorted(ready[0], lists.flatten().to_numpy(zero_copy_only=False))
                cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
                sums = [np.diff(np.r_[0, np.cumsum(times * x[at], dtype=np.int64)][cuts]) for x in (ready[2], ready[1])]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), own.column("groups_sha256")], names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # a block's pairs stand before its documents
    both = known.unionByName(docs_, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("row").asc_nulls_first())
    ddl = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    return both.mapInArrow(run, ddl).withColumnRenamed("key", key)


def op12_lockstep_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
