"""Token counts by finite-state transducers.

Two deterministic transducers stand for a word-level BPE tokenizer. The first reads code points and starts
tokens of text (runs of letters, single digits, runs of other signs, contractions); it has five states. The
second reads the bytes of those runs, the last one marked, and its transitions carry how many tokens they add
(or take back, where bytes merge): the sum over a run is the number of its BPE tokens. A state of the second
holds, for each place from which a token can still reach on, the last token before it and how many tokens
lie after that. Its transitions are compiled when first met and kept by the worker, up to MOST of them; then
compilation starts anew, which costs time and changes nothing.

Text is cut into chunks that run side by side. Of the first transducer each chunk's whole state map (five
entries) is taken, and a parallel prefix scan composes the maps, so that every chunk's entry is known. Of the second
a chunk's map is taken at the entry UNKNOWN, which forgets what stands before the first end of a run; what it
skipped is run again from the exit of the chunk before. Chunks without any end of a run are entered at the
state that the bytes before them lead to, and are run again wherever composition finds another entry.

Null and empty texts have no tokens. Whole texts are read, whatever their length; long ones are cut at blanks,
where both transducers are in their first state. Rows alike in key and text give rows alike; keys may be null. An empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path

LIMIT = 2048
#: Code points in a block that is processed at once, and in a piece of a long text.
BLOCK, PIECE = 1 << 19, 1 << 16
#: Code points, and bytes, of a chunk.
WIDE, NARROW = 256, 128
#: Bytes before a chunk without ends from which its entry is guessed.
LOOK_BACK = 32
#: Transitions that a worker keeps.
MOST = 1 << 20

# Classes of code points, the last two given by what follows an apostrophe; states of the first transducer.
WHITE, LETTER, DIGIT, SIGN, SHORT, LONG = range(6)
OPEN, IN_LETTERS, IN_SIGNS, ONE_LEFT, TWO_LEFT = range(5)
STATES = 5

UNKNOWN, START = 0, 1

#: Texts of these code points alone: composing leaves them as they are, and lower case goes by single code points.
_plain = re.compile("[\x00-˿Ѐ-џ‐-‧一-鿿가-힣]*").fullmatch
_blank = re.compile(r"(?<=[\x21-\x7e])[ \n](?=[A-Za-z0-9])")


def run_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) of the first transducer, by class * STATES + state."""
    nxt, starts = np.zeros((6, STATES), np.int8), np.zeros((6, STATES), bool)
    opened = {LETTER: IN_LETTERS, DIGIT: OPEN, SIGN: IN_SIGNS, SHORT: ONE_LEFT, LONG: TWO_LEFT}
    for kind, into in opened.items():
        nxt[kind], starts[kind] = into, True
    nxt[LETTER, [ONE_LEFT, TWO_LEFT]], starts[LETTER, [IN_LETTERS, ONE_LEFT, TWO_LEFT]] = [OPEN, ONE_LEFT], False
    for kind in (SIGN, SHORT, LONG):  # within signs an apostrophe is one of them
        nxt[kind, IN_SIGNS], starts[kind, IN_SIGNS] = IN_SIGNS, False
    return nxt.reshape(-1), starts.reshape(-1)


class Tokenizer:
    """The two transducers of a tokenizer file, compiled as far as texts have asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("a BPE tokenizer with marked ends of words is needed")
        names = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.kinds = np.full(0x110000, 255, np.uint8)
        self.next, self.starts = run_table()
        self._read(model)
        self._reset()

    # The second transducer -------------------------------------------------

    def _read(self, model: dict) -> None:
        """Tokens as strings of symbols (a byte, or a byte + 256 at the end of a run), how each is made, what starts one."""
        from .tokens import _byte_letters

        symbol, end = {c: chr(b) for b, c in enumerate(_byte_letters())}, model["end_of_word_suffix"]

        def spelled(token: str) -> str:
            last = token.endswith(end)
            s = "".join(symbol[c] for c in (token.removesuffix(end) if last else token))
            return s[:-1] + chr(ord(s[-1]) + 256) if last else s

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {spelled(a + b): (spelled(a), spelled(b), rank) for rank, (a, b) in enumerate(merges)}
        self.made, self.rank = made, {(a, b): rank for a, b, rank in made.values()}
        tokens = {spelled(t) for t in model["vocab"] if all(c in symbol for c in t.removesuffix(end))}
        self.ends: dict[str, list] = {}
        self.begins: dict[str, list] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.tokens = {t for t in tokens if t not in made or self._stands(t)}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))} | {t for t in self.tokens if ord(t[-1]) < 256}

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The tokens that stand at one edge of a token while it is made, and the rank of the merge that ends each."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until, token = self.made[token][2], self.made[token][side]

    def _apart(self, a: str, b: str, most: float) -> bool:
        """Whether a and b stay two tokens side by side until merges of rank `most`: nothing at the joint merges before both edges are gone."""
        if a not in self.ends:
            self.ends[a] = self._spine(a, 1)
        if b not in self.begins:
            self.begins[b] = self._spine(b, 0)
        for x, until in self.ends[a]:
            for y, till in self.begins[b]:
                rank = self.rank.get((x, y))
                # of equal merges the left one comes first
                if rank is not None and rank < min(until, most) and rank <= till:
                    return False
        return True

    def _stands(self, token: str) -> bool:
        """Whether the tokenizer gives the token for its own text."""
        if token not in self.made:
            return True
        a, b, rank = self.made[token]
        return self._stands(a) and self._stands(b) and self._apart(a, b, rank)

    def _reset(self) -> None:
        start = ("", (("", 0),))
        self.states, self.number = [None, start], {start: START}
        self.n_kept, self.bits = 0, 14
        self.keys, self.into, self.adds = (np.full(1 << self.bits, x, np.int64) for x in (-1, 0, 0))

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens added) of one transition."""
        last = symbol >= 256
        if state == UNKNOWN:
            return (START if last else UNKNOWN), 0
        held, before = self.states[state]
        word = held + chr(symbol)
        found = None
        for i in range(len(word)):
            token = word[i:]
            if token not in self.tokens:
                continue
            left, n = before[i]
            fit = not left or self.fits.get((left, token))
            if fit is None:
                fit = self.fits[left, token] = self._apart(left, token, float("inf"))
            if fit:
                if found is not None:
                    raise ValueError("the merges give no single last token")
                found = token, n + 1
        if found is None:
            raise ValueError("the merges give no last token")
        token, adds = found
        if last:
            return START, adds
        keep = next(i for i in range(len(word) + 1) if word[i:] in self.prefixes)
        new = word[keep:], (*((t, n - adds) for t, n in before[keep:]), (token, 0))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new], adds

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _seek(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or the empty place where it would, from its slot on."""
        held = self.keys[at]
        off = np.flatnonzero((held != key) & (held >= 0))
        while len(off):
            at[off] = at[off] + 1 & (1 << self.bits) - 1
            held = self.keys[at[off]]
            off = off[(held != key[off]) & (held >= 0)]
        return at

    def _learn(self, key: np.ndarray) -> None:
        key = np.unique(key)
        if (self.n_kept + len(key)) * 2 > 1 << self.bits:
            held = np.flatnonzero(self.keys >= 0)
            old = self.keys[held], self.into[held], self.adds[held]
            while (self.n_kept + len(key)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.into, self.adds = (np.full(1 << self.bits, x, np.int64) for x in (-1, 0, 0))
            self._place(*old)
        made = np.array([self._compile(k >> 9, k & 511) for k in key.tolist()], np.int64).reshape(-1, 2)
        self._place(key, made[:, 0], made[:, 1])
        self.n_kept += len(key)

    def _place(self, key: np.ndarray, into: np.ndarray, adds: np.ndarray) -> None:
        """New keys into the table; of those that want one empty place, one gets it and the others go on."""
        while len(key):
            at = self._seek(key, self._slots(key))
            self.keys[at] = key
            here = self.keys[at] == key
            self.into[at[here]], self.adds[at[here]] = into[here], adds[here]
            key, into, adds = key[~here], into[~here], adds[~here]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, tokens added) of transitions side by side."""
        key = state << 9 | symbol
        at = self._slots(key)
        if (self.keys[at] != key).any():
            new = self.keys[self._seek(key, at)] != key
            if new.any():
                self._learn(key[new])
                at = self._seek(key, self._slots(key))
        return self.into[at], self.adds[at]

    def run(self, symbols: np.ndarray, state: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, tokens added) of rows of symbols, each read up to its length from its entry state."""
        order = np.argsort(-length, kind="stable")
        out, added, lasting = state[order].copy(), np.zeros(len(state), np.int64), length[order]
        for t in range(int(lasting[0]) if len(lasting) else 0):
            n = int(np.searchsorted(-lasting, -t, side="left"))
            out[:n], adds = self.step(out[:n], symbols[order[:n], t])
            added[:n] += adds
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out[back], added[back]

    def chunk_counts(self, symbols: np.ndarray) -> np.ndarray:
        """What each byte of a stream of runs (the last of each + 256) adds to the tokens: a row for each chunk of NARROW bytes."""
        n = len(symbols)
        rows = -(-n // NARROW)
        grid = np.full(rows * NARROW, 0, np.int64)
        grid[:n] = symbols
        grid = grid.reshape(rows, NARROW)
        length = np.full(rows, NARROW)
        length[-1:] = n - (rows - 1) * NARROW
        added = np.zeros((rows, NARROW), np.int16)
        ended = grid >= 256
        known = np.r_[True, ended[:-1, -1]]
        state = np.where(known, START, UNKNOWN)
        steps = np.ascontiguousarray(grid.T)
        for t in range(NARROW):
            upto = rows if t < length[-1] else rows - 1
            state[:upto], added[:upto, t] = self.step(state[:upto], steps[t, :upto])
        # what chunks with an unknown entry skipped: up to their first end, or all of it
        skipped = np.flatnonzero(~known)
        if not len(skipped):
            return added
        has_end = ended[skipped].any(axis=1)
        head = np.where(has_end, ended[skipped].argmax(axis=1) + 1, length[skipped])
        entry = state[skipped - 1]
        guessed = np.flatnonzero(entry == UNKNOWN)
        if len(guessed):
            before = np.ascontiguousarray(grid[skipped[guessed] - 1, -LOOK_BACK:])
            entry[guessed], _ = self.run(before, np.full(len(guessed), START), np.full(len(guessed), LOOK_BACK))
        todo = np.arange(len(skipped))
        while len(todo):
            leaves = self._heads(grid, added, skipped[todo], entry[todo], head[todo])
            open_ = ~has_end[todo]
            state[skipped[todo[open_]]] = leaves[open_]
            todo = np.flatnonzero(state[skipped - 1] != entry)
            entry[todo] = state[skipped[todo] - 1]
        return added

    def _heads(self, grid: np.ndarray, added: np.ndarray, rows: np.ndarray, entry: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Runs the first `head` bytes of chunks from their entries and notes what they add; gives their states after these."""
        order = np.argsort(-head, kind="stable")
        rows, state, lasting = rows[order], entry[order].copy(), head[order]
        for t in range(int(lasting[0])):
            n = int(np.searchsorted(-lasting, -t, side="left"))
            state[:n], added[rows[:n], t] = self.step(state[:n], grid[rows[:n], t])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back]

    # The first transducer --------------------------------------------------

    def classes(self, cps: np.ndarray) -> np.ndarray:
        """Class of each code point, as the tokenizer's own pattern has it."""
        kind = self.kinds[cps]
        if (kind == 255).any():
            for c in np.unique(cps[kind == 255]).tolist():
                # what the library makes of it between letters and between signs
                parts = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}a")), len(self.library.pre_tokenizer.pre_tokenize_str(f"!{chr(c)}!"))
                self.kinds[c] = {(1, 3): LETTER, (3, 1): SIGN, (3, 3): DIGIT, (2, 2): WHITE}[parts]
            kind = self.kinds[cps]
        kind = kind.copy()
        at = np.flatnonzero(cps == 39)
        if len(at):
            ahead = np.concatenate([cps, np.zeros(2, cps.dtype)])
            a, b = ahead[at + 1], ahead[at + 2]
            is_ = lambda x, s: np.isin(x, [ord(c) for c in s])
            kind[at[is_(a, "stmd")]] = SHORT
            kind[at[is_(a, "rv") & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = LONG
        return kind

    def run_starts(self, kind: np.ndarray) -> np.ndarray:
        """Whether a run starts at each code point: state maps of chunks, a prefix scan over them, then one reading from known entries."""
        n = len(kind)
        rows = -(-n // WIDE)
        grid = np.zeros(rows * WIDE, np.int64)
        grid[:n] = kind
        steps = np.ascontiguousarray(grid.reshape(rows, WIDE).T) * STATES
        maps = np.tile(np.arange(STATES, dtype=np.int8), (rows, 1))
        for t in range(WIDE):
            maps = self.next[steps[t][:, None] + maps]
        far = 1
        while far < rows:  # maps[i] becomes what chunks i - 2 * far + 1 .. i do together
            maps[far:] = np.take_along_axis(maps[far:], maps[:-far].astype(np.int64), axis=1)
            far *= 2
        state = np.r_[OPEN, maps[:-1, OPEN]].astype(np.int64)
        out = np.empty((WIDE, rows), bool)
        for t in range(WIDE):
            key = steps[t] + state
            out[t], state = self.starts[key], self.next[key]
        return out.T.reshape(-1)[:n]

    # Texts -----------------------------------------------------------------

    def normal(self, text: str) -> str:
        return text.lower() if _plain(text) else self.library.normalizer.normalize_str(text)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """(normalised parts of a text that no run reaches across, number of special tokens between them)."""
        parts, n = [text], 0
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            n = len(parts) - 1
        out = []
        for p in parts:
            while len(p) > PIECE and (m := _blank.search(p, PIECE)):
                out.append(self.normal(p[: m.start()]))
                p = p[m.end() :]
            out.append(self.normal(p))
        return out, n

    def count_block(self, text: str, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each stretch of a normalised text; bounds: where the stretches end. Each stretch ends with white space."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.classes(cps)
        starts = self.run_starts(kind)
        white = kind == WHITE
        last = ~white & np.r_[white[1:] | starts[1:], True]
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        ends = np.cumsum(1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000))
        raw[ends[last] - 1] += 256
        keep = np.repeat(~white, np.diff(np.r_[0, ends])) if white.any() else np.ones(len(raw), bool)
        symbols = raw[keep]
        if not len(symbols):
            return np.zeros(len(bounds), np.int64)
        total = np.r_[0, np.cumsum(self.chunk_counts(symbols).reshape(-1), dtype=np.int64)]
        at = np.r_[0, np.cumsum(keep)][np.r_[0, ends][bounds]]
        return np.diff(np.r_[0, total[at]])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out, parts, bounds, of, held = np.zeros(len(texts), np.int64), [], [], [], 0

        def flush() -> None:
            nonlocal parts, bounds, of, held
            if parts:
                np.add.at(out, of, self.count_block("".join(parts), np.array(bounds)))
            parts, bounds, of, held = [], [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            found, special = self.pieces(text)
            out[i] += special
            for p in found:
                parts += p, "\n"
                held += len(p) + 1
                bounds.append(held)
                of.append(i)
                if held >= BLOCK:
                    flush()
        flush()
        if self.n_kept > MOST:
            self._reset()
        return out


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """This worker's transducers for the file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit): one row per document; over_limit: more than `limit` tokens."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                small = batch.slice(at, 1024)
                texts = small.column(1)
                size = texts.cast(pa.binary()).fill_null(b"")
                n = compiled.counts(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([small.column(0), pc.binary_length(size).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def op13_transducer_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
