"""Hashes of words and of runs of words, for many texts at once.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D], with A-Z in lower case. Texts are laid end to end, a
line feed between them, in groups of about GROUP_BYTES (a longer text is a group of its own), so that memory
stays bounded and numpy works on whole groups. A word's hash is a polynomial in an odd base modulo
2**64: sums of prefixes give every word at once, and the same again gives every run of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 19

_BASE, _RUN_BASE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
_MIX = np.uint64(0x9E3779B97F4A7C15)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint64) + 1
_lower[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of each number spread over all of it."""
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_up, _down = _powers(_BASE, GROUP_BYTES), _powers(pow(_BASE, -1, 1 << 64), GROUP_BYTES)


def _hashed(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of each word raw[start:stop]."""
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        begin = int(start[at])
        upto = max(at + 1, int(np.searchsorted(stop, begin + GROUP_BYTES, "right")))
        end = int(stop[upto - 1])
        if end - begin <= GROUP_BYTES:
            total = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(_lower[raw[begin:end]] * _up[: end - begin], out=total[1:])
            a, b = start[at:upto] - begin, stop[at:upto] - begin
            out[at:upto] = (total[b] - total[a]) * _down[a]
        else:  # one word longer than a group: its pieces, each raised to its place
            whole = 0
            for a in range(begin, end, GROUP_BYTES):
                part = _lower[raw[a : min(end, a + GROUP_BYTES)]]
                whole += int((part * _up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, a - begin, 1 << 64)
            out[at] = whole % (1 << 64)
        at = upto
    return mixed(out)


@dataclass
class Words:
    """The words of a group of texts: hash, number of the text and of the line (all lines of a group count on)."""

    texts: int
    h: np.ndarray
    text: np.ndarray
    line: np.ndarray
    first: np.ndarray
    total: np.ndarray
    down: np.ndarray

    def runs(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The hash of the `size` words from each place on."""
        return mixed((self.total[at + size] - self.total[at]) * self.down[at] + mixed(np.zeros(len(at), np.uint64) + np.asarray(size).astype(np.uint64)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words, and which of them lie within one text."""
        n = len(self.h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return self.runs(np.arange(n), size), self.text[:n] == self.text[size - 1 :]


def words_of(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    closed = np.ones(len(raw) + 2, bool)
    closed[1:-1] = _space[raw]
    edge = np.flatnonzero(closed[1:] != closed[:-1])
    start, stop = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    breaks = np.flatnonzero(raw == 10)
    h = _hashed(raw, start, stop)
    text = np.searchsorted(begins, start, "right") - 1
    n = len(h)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(_RUN_BASE, n), out=total[1:])
    return Words(len(texts), h, text, np.searchsorted(breaks, start), np.searchsorted(text, np.arange(len(texts) + 1)), total, _powers(pow(_RUN_BASE, -1, 1 << 64), n + 1))


def grouped(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first row, texts as UTF-8) of each group of rows. A null text is empty."""
    texts, held, first = [], 0, 0
    for i, x in enumerate(column.cast(pa.large_binary())):
        raw = x.as_py() or b""
        if texts and held + len(raw) > GROUP_BYTES:
            yield first, texts
            texts, held, first = [], 0, i
        texts.append(raw)
        held += len(raw) + 1
    if texts:
        yield first, texts


def least_places(x: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` numbers the place of its least, the first of equals."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, reach = np.arange(len(x)), 1
    while reach < size:  # place[i] is the least among `reach` numbers from i on
        step = min(reach, size - reach)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(x[b] < x[a], b, a)
        reach += step
    return place


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
