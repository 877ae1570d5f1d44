"""Subword ids of whole texts by a public vocabulary file, with the ids of repeated words kept per Python worker."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

#: Words whose ids a worker keeps, in each of two generations; bounds its memory to some 200 MB.
MEMORY_WORDS = 500_000

#: ASCII punctuation but the apostrophe, which starts contractions.
_TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class Subwords(dict):
    """Maps a run of bytes without ASCII blanks to its ids, as bytes of little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and never joins text across it, so a text's ids are those of its runs in order. Two
    more facts of its rules save work: ASCII text is taken in lower case, and punctuation after a letter stands alone.
    A word of letters only has exactly one id that ends a word, its last one, so many new words are encoded in one call.
    Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for piece, number in self._tokenizer.get_vocab().items():
            self._ends[number] = piece.endswith("</w>")
        self._older: dict[bytes, bytes] = {}

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, runs: set[bytes]) -> None:
        """Make the ids of all runs known."""
        if len(self) + len(runs) > MEMORY_WORDS:
            self._older = dict(self)
            self.clear()
        new: dict[bytes, tuple[bytes, bytes]] = {}
        wanted: set[bytes] = set()
        for run in [run for run in runs if run not in self]:
            if (ids := self._older.get(run)) is not None:
                self[run] = ids
                continue
            core = run.lower() if run.isascii() else run
            stem = core.rstrip(_TAIL)
            if not stem or not stem[-1:].isalpha():
                stem = core
            new[run] = stem, core[len(stem) :]
            wanted.update(new[run])
        wanted.discard(b"")
        stems = [w for w in wanted if w not in self]
        words = [w for w in stems if w.decode().isalpha()]
        joined = self._encoded(" ".join(w.decode() for w in words))
        ends = np.flatnonzero(self._ends[joined]) + 1
        if len(ends) == len(words):
            data, at = joined.tobytes(), 0
            for word, end in zip(words, (4 * ends).tolist(), strict=True):
                self[word] = data[at:end]
                at = end
        others = [w for w in stems if w not in self]
        encodings = self._tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        for word, encoding in zip(others, encodings, strict=True):
            self[word] = np.array(encoding.ids, "<u4").tobytes()
        for run, (stem, tail) in new.items():
            self[run] = self[stem] + self[tail] if tail else self[stem]

    def texts(self, utf8: list[bytes]) -> list[bytes]:
        """Ids of whole texts."""
        runs = [text.split() for text in utf8]
        self._learn(set(chain.from_iterable(runs)))
        return [b"".join(map(self.__getitem__, own)) for own in runs]


_of_path: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """The worker's own instance."""
    if path not in _of_path:
        _of_path[path] = Subwords(path)
    return _of_path[path]


def forget() -> None:
    """Drop the worker's instances: stages that encode nothing need their memory."""
    _of_path.clear()
