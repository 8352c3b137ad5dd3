"""Token ids of whole texts, one library call per distinct word.

The vocabularies used here drop white space between pre-tokens, so the ids of a text are
the ids of its words in a row.  Words that are letters with ASCII marks behind them are
split once more, so that ``Word``, ``word`` and ``word,`` share one entry; what a worker
has not seen yet goes through the tokenizers library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that no normaliser changes but by lower-casing, then marks that never join them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*#$%&]*)\Z")
_PLAIN_PARTS = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?|*#$%&]*)$"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    fresh = count(0x100)
    return {b: chr(b) if b in shown else chr(next(fresh)) for b in range(256)}


class WordEncoder:
    """Ids of single words, with a bounded cache of word stems."""

    def __init__(self, path: str, capacity: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._model = self._library.model
        self._letters = _byte_letters()
        self._capacity = capacity
        self._stems: dict[str, bytes] = {}

    def forget(self) -> None:
        self._stems.clear()

    def letters(self, text: str) -> bytes:
        """Ids of lower-case letters or of marks alone, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self._letters)
        return np.array([t.id for t in self._model.tokenize(shown)], "<u4").tobytes()

    def any_word(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, letters: str) -> bytes:
        known = self._stems.get(letters)
        if known is None:
            if len(self._stems) >= self._capacity:
                self._stems.clear()
            known = self._stems[letters] = self.letters(letters)
        return known

    def __call__(self, word: bytes) -> bytes:
        """Ids of any word."""
        text = word.decode()
        plain = _PLAIN.match(text)
        if plain is None:
            return self.any_word(text)
        letters, marks = plain.groups()
        stem = self._stem(letters.lower())
        return stem + self._stem(marks) if marks else stem


class WordIds:
    """Ids of whole texts, out of the stems and marks that their words are made of.

    Arrow splits the texts and finds their distinct words, and the distinct stems among
    these; only stems that this worker does not hold are encoded.  At most ``capacity``
    are held: a full table starts anew between two chunks.
    """

    def __init__(self, path: str, capacity: int = 250_000) -> None:
        self._encode, self._capacity = WordEncoder(path, 0), capacity
        self._start_anew()

    def _start_anew(self) -> None:
        self._slots: dict[str, int] = {"": 0}
        self._fresh: list[bytes] = []
        self._pool = np.zeros(0, "<u4")
        self._ends = np.zeros(2, np.int64)

    def _slots_of(self, words: pa.Array, encode: Callable[[str], bytes]) -> np.ndarray:
        coded, slots, fresh = words.dictionary_encode(), self._slots, self._fresh
        out = np.empty(len(coded.dictionary), np.int64)
        for i, word in enumerate(coded.dictionary.to_pylist()):
            slot = slots.get(word)
            if slot is None:
                slot = slots[word] = len(slots)
                fresh.append(encode(word))
            out[i] = slot
        return out[coded.indices.to_numpy()]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if len(self._slots) > self._capacity:
            self._start_anew()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        per_text, coded = split.value_lengths().to_numpy(), split.flatten().dictionary_encode()
        words = coded.dictionary
        found = pc.extract_regex(words, _PLAIN_PARTS)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        # A plain word is its stem and its marks; any other one is encoded whole.
        two = np.zeros((len(words), 2), np.int64)
        of = found.filter(pa.array(plain))
        two[plain, 0] = self._slots_of(pc.utf8_lower(pc.struct_field(of, "stem")), self._encode.letters)
        two[plain, 1] = self._slots_of(pc.struct_field(of, "marks"), self._encode.letters)
        two[~plain, 0] = self._slots_of(words.filter(pa.array(~plain)), self._encode.any_word)
        if self._fresh:
            sizes = np.fromiter(map(len, self._fresh), np.int64, len(self._fresh)) // 4
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
            self._pool = np.concatenate([self._pool, np.frombuffer(b"".join(self._fresh), "<u4")])
            self._fresh = []
        # Ids of the distinct words in a row, then those of all words out of them.
        own, own_ends = self._gather(two.reshape(-1), self._pool, self._ends)
        own_ends = own_ends[::2]
        ids, ends = self._gather(coded.indices.to_numpy(), own, own_ends)
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])

    @staticmethod
    def _gather(slots: np.ndarray, pool: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots' stretches of the pool in a row, and where each ends, from 0."""
        begins = ends[slots]
        sizes = ends[slots + 1] - begins
        before = np.concatenate([[0], np.cumsum(sizes)])
        return pool[np.repeat(begins - before[:-1], sizes) + np.arange(before[-1])], before


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of this worker process.  It keeps its stems (some 50 MB at most) from task to task."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
