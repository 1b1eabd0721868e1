"""Token ids of whole texts, by words that a worker has met before.

The tokenizer replaces runs of white space by one space and its pattern never reaches across a space,
so a text's ids are the ids of its space-separated words in order. A word of Latin-1 letters with ASCII
punctuation around it falls into runs (normalisation only lowers its case), and the model alone gives
the ids of a run; every other word goes through the whole tokenizer. A worker keeps what it has met, up
to CACHE_WORDS of each. tests/llm holds this against encode() of the whole text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

CACHE_WORDS = 1 << 19
END_ID = 1

_cut = re.compile(r"[ \t\n\r]+").split
#: Python's split() also cuts at these, the tokenizer doesn't.
_odd_space = re.compile("[\x1c-\x1f]").search
_plain = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)").fullmatch

_coders: dict[str, WordCoder] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class WordCoder:
    """Ids of a text by a tokenizer file whose pre-tokenizer drops white space and cuts letters from punctuation."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        #: Little-endian ids of words and of runs.
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {"": b""}

    def _word(self, word: str) -> bytes:
        if word.isascii():
            core = word.rstrip(".,")
            if core.isalpha():
                return self._run(core.lower()) + self._run(word[len(core) :])
        m = None if "<|" in word else _plain(word)
        if m is None:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        before, letters, after = m.groups()
        return self._run(before) + self._run(letters.lower()) + self._run(after) if letters else self._run(word)

    def _run(self, run: str) -> bytes:
        """Ids of a run of letters or of punctuation, in lower case."""
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) >= CACHE_WORDS:
                self.runs = {"": b""}
            spelled = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
            self.runs[run] = found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def ids(self, text: str) -> np.ndarray:
        words = _cut(text) if _odd_space(text) else text.split()
        if len(self.words) + len(words) > CACHE_WORDS:
            self.words = {}
        known = self.words
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        return np.frombuffer(b"".join([known[w] for w in words]), "<u4")


def coder(path: str) -> WordCoder:
    """This worker's coder for the file."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
