"""Alignment of two tokenizers' tokens over the same text.

Both token sequences tile the bytes of a text.  They are aligned by divide and conquer:
in an interval of tokens, the common end nearest to the middle is located by bisecting the
other tokenizer's ends, and both halves are taken on; an interval without a common end is
a leaf, a group.  All intervals of a chunk of texts advance together, level by level, as
numpy arrays.  A text's first intervals are its stretches, whose edges are common ends;
a worker aligns a stretch once, and texts take the groups and links of theirs.

How often an id pair is linked is counted over all documents.  A document looks its pairs
up in two tiers: pairs that many documents hold are broadcast, at most ``TABLE_PAIRS`` of
them, all others are joined by Spark, where none of them can be hot.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.llm.common import FORGET, chunks, narrow, tables, tidied

#: Pairs of the broadcast tier at most (12 bytes each).
TABLE_PAIRS = 1 << 20
#: Distinct stretches of text whose tokens, groups and links a worker keeps.
CACHE_SIZE = 300_000
#: Stretches that are encoded as one text.
JOINED = 16
#: Bytes of text aligned at once; arrays of that size stay near the processor.
CHUNK = 1 << 20
#: Distinct pairs a task counts at once before it hands their counts on.
COUNTED_PAIRS = 4_000_000

# Neither tokenizer has a token that goes on from a character that is no space into a
# space, tab or newline: texts are tokenized stretch by stretch.
_STRETCH = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
_CAREFUL = re.compile(r"(?<=[^\s\x1c-\x1f\u180e\u200b\ufeff])(?=[ \t\n])")
_SPACES = frozenset(c for c in map(chr, range(0x10000)) if re.fullmatch(r"[\s\x1c-\x1f\u180e\u200b\ufeff]", c))
_ODD = sorted(_SPACES - set(" \t\n"))


def stretches(text: str) -> list[str]:
    """The text, cut before white space that follows other characters."""
    return _CAREFUL.split(text) if any(c in text for c in _ODD) else _STRETCH.findall(text)


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, so many as its size says."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(begins - before[:-1], sizes) + np.arange(before[-1])


class _Tokens:
    """Ids of texts; ``bytes_of`` each id and the ``sizes`` of these."""

    bytes_of: list[bytes]
    sizes: np.ndarray

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _tiled(self, ids: list[int], texts: list[str]) -> np.ndarray | None:
        """How many of the ids each text has, if they reproduce the texts in a row and no id goes over an edge."""
        own = [t.encode() for t in texts]
        if b"".join(map(self.bytes_of.__getitem__, ids)) != b"".join(own):
            return None
        ends, edges = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        last = np.searchsorted(ends, edges)
        return np.diff(last, prepend=-1) if (ends[last] == edges).all() else None

    def encode_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, and how many each has: none if they don't reproduce it."""
        # Stretches begin with white space: behind another character they have the same ids as on their own.
        closing = np.fromiter((t[-1] in _SPACES for t in texts), bool, len(texts))
        closing[JOINED - 1 :: JOINED] = closing[-1] = True
        to = (np.flatnonzero(closing) + 1).tolist()
        spans = list(zip([0, *to[:-1]], to, strict=True))
        lists = self.encode(["".join(texts[x:y]) for x, y in spans])
        ids = list(chain.from_iterable(lists))
        counts = self._tiled(ids, texts)
        if counts is None:
            ids, counts = [], np.zeros(len(texts), np.int64)
            for own, (x, y) in zip(lists, spans, strict=True):
                n = self._tiled(own, texts[x:y])
                if n is None:
                    parts = zip(self.encode(texts[x:y]), texts[x:y], strict=True)
                    kept = [part if b"".join(self.bytes_of[i] for i in part) == t.encode() else [] for part, t in parts]
                    own, n = list(chain.from_iterable(kept)), list(map(len, kept))
                ids += own
                counts[x:y] = n
        return np.array(ids, np.int32), counts


class ByteTokens(_Tokens):
    """Ids of a byte-level vocabulary file, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from signaldeck.llm.word_ids import _byte_letters

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._library.encode_special_tokens = True
        byte_of = {letter: b for b, letter in _byte_letters().items()}
        vocabulary = self._library.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens(_Tokens):
    """Ids of a sentencepiece model, and the bytes of each id; the model writes the leading space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self._library
        self.bytes_of = [
            bytes([int(lib.id_to_piece(i)[3:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode()
            for i in range(lib.get_piece_size())
        ]
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self._anchor = len(lib.encode("x"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        # Behind a letter, so that the model's own leading space stays off the stretch.
        return [ids[self._anchor :] for ids in self._library.encode(["x" + t for t in texts], num_threads=1)]


class _Numbers(dict):
    """Numbers from 0, in the order in which keys are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


class _Pool:
    """Values of all kept stretches in a row."""

    def __init__(self, kind: type) -> None:
        self._values, self._ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._values = np.concatenate([self._values, values.astype(self._values.dtype)])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])

    def sizes(self, slots: np.ndarray) -> np.ndarray:
        return self._ends[slots + 1] - self._ends[slots]

    def take(self, slots: np.ndarray) -> np.ndarray:
        """Values of the slots in a row."""
        return self._values[ragged(self._ends[slots], self.sizes(slots))]

    def keep(self, slots: np.ndarray) -> None:
        values, sizes = self.take(slots), self.sizes(slots)
        self._values, self._ends = values, np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Aligned:
    """Aligned stretches: ids in a row, tokens and groups by stretch, and where groups end (token numbers, exclusive)."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all overlapping pairs, in turn: the bytes between neighbouring ends are one."""
        inner = np.ones(len(self.b), bool)
        inner[self.b_cuts - 1] = False
        ends = np.sort(np.concatenate([self.a_ends, self.b_ends[inner]]), kind="stable")
        return np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_spans: np.ndarray, b_spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as token numbers (exclusive) of both sides.

    The spans hold the first and the last token number (exclusive) of intervals whose ends
    are common; both sequences of ends rise.
    """
    a0, a1, b0, b1 = *a_spans, *b_spans
    a_cuts, b_cuts = [a1], [b1]
    while len(a0):
        # A side with one token has no end inside: a leaf.
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        a0, a1, b0, b1 = a0[open_], a1[open_], b0[open_], b1[open_]
        middle, reach = (a0 + a1 - 2) >> 1, 0
        at, place = np.full(len(a0), -1), np.zeros(len(a0), np.int64)
        todo = np.arange(len(a0))
        while len(todo):
            low = np.maximum(a0[todo], middle[todo] - reach)
            high = np.minimum(a1[todo] - 2, middle[todo] + reach)
            sizes = high - low + 1
            token = ragged(low, sizes)
            found = np.searchsorted(b_ends, a_ends[token])
            # Of the common ends in reach, the one nearest to the middle; the left one of two.
            far = np.abs(2 * (token - np.repeat(middle[todo], sizes)) + 1)
            far[b_ends[found] != a_ends[token]] = np.iinfo(np.int64).max
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(far, starts)
            best = np.flatnonzero((far == np.repeat(least, sizes)) & (far < np.iinfo(np.int64).max))
            owner = np.repeat(todo, sizes)[best]
            at[owner], place[owner] = token[best], found[best]
            todo = todo[(at[todo] < 0) & ((low > a0[todo]) | (high < a1[todo] - 2))]
            reach = 2 * reach + 2
        hit = np.flatnonzero(at >= 0)
        a_at, b_at = at[hit] + 1, place[hit] + 1
        a_cuts.append(a_at)
        b_cuts.append(b_at)
        a0, a1 = np.concatenate([a0[hit], a_at]), np.concatenate([a_at, a1[hit]])
        b0, b1 = np.concatenate([b0[hit], b_at]), np.concatenate([b_at, b1[hit]])
    return np.sort(np.concatenate(a_cuts)), np.sort(np.concatenate(b_cuts))


class GroupText:
    """Groups written as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self) -> None:
        self._shown, self._lengths = np.zeros((0, 1), np.uint8), np.zeros(0, np.int64)

    def __call__(self, got: Aligned) -> list[bytes]:
        """The groups of each stretch."""
        most = int(max(got.a.max(initial=-1), got.b.max(initial=-1))) + 1
        if most > len(self._lengths):
            digits = np.arange(most).astype(f"S{len(str(most))}")
            self._lengths = np.char.str_len(digits).astype(np.int64)
            # One more byte, for the mark behind the digits.
            self._shown = np.pad(digits.view(np.uint8).reshape(most, -1), ((0, 0), (0, 1)))
        n = len(got.a) + len(got.b)
        last_a, last_b = np.zeros(len(got.a), bool), np.zeros(len(got.b), bool)
        last_a[got.a_cuts - 1], last_b[got.b_cuts - 1] = True, True
        place_a = np.arange(len(got.a)) + np.repeat(got.b_cuts - np.diff(got.b_cuts, prepend=0), np.diff(got.a_cuts, prepend=0))
        place_b = np.arange(len(got.b)) + np.repeat(got.a_cuts, np.diff(got.b_cuts, prepend=0))
        ids, mark = np.empty(n, np.int32), np.empty(n, np.uint8)
        ids[place_a], ids[place_b] = got.a, got.b
        mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        shown, size = self._shown[ids], self._lengths[ids]
        shown.reshape(-1)[np.arange(n) * shown.shape[1] + size] = mark
        flat = shown[shown != 0].tobytes()
        edges = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(got.n_a + got.n_b)])].tolist()
        return [flat[x : y - 1] if y > x else b"" for x, y in zip(edges[:-1], edges[1:], strict=True)]


@dataclass
class Texts:
    """The stretches of texts, as numbers in an aligner, and where each text's begin and end."""

    slots: np.ndarray
    edges: np.ndarray

    def sums(self, sizes: np.ndarray) -> np.ndarray:
        """Sizes of the stretches added up by text."""
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[self.edges])


class Aligner:
    """Both tokenizers of a worker, with the alignment of stretches seen before."""

    def __init__(self, path_a: str, path_b: str, capacity: int = CACHE_SIZE) -> None:
        self._sides = (ByteTokens(path_a), PieceTokens(path_b))
        self.width_a, self.width_b = (len(s.bytes_of) for s in self._sides)
        self._capacity = capacity
        self._write = GroupText()
        self.forget()

    def forget(self) -> None:
        self._slots = _Numbers()
        self.a, self.b, self.a_ends, self.b_ends = (_Pool(np.int32) for _ in range(4))
        self.pairs = _Pool(np.int64)
        self._shown: list[bytes] = []
        self._same, self._seen = np.zeros(0, bool), np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Keep stretches that several chunks have held since the last time, half of the capacity at most."""
        kept = np.flatnonzero(self._seen > 1)
        kept = np.sort(kept[np.argsort(-self._seen[kept], kind="stable")[: self._capacity // 2]])
        keys, own = list(self._slots), kept.tolist()
        self._slots = _Numbers(zip(map(keys.__getitem__, own), range(len(own)), strict=True))
        for pool in (self.a, self.b, self.a_ends, self.b_ends, self.pairs):
            pool.keep(kept)
        self._shown = [self._shown[i] for i in own]
        self._same, self._seen = self._same[kept], np.zeros(len(own), np.int64)

    def _learn(self, fresh: list[str]) -> None:
        (a, n_a), (b, n_b) = (side.encode_stretches(fresh) for side in self._sides)
        same = (n_a > 0) & (n_b > 0)
        self._add(a[np.repeat(same, n_a)], np.where(same, n_a, 0), b[np.repeat(same, n_b)], np.where(same, n_b, 0))

    def _add(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Align stretches, by the ids in a row and how many each has."""
        a_ends, b_ends = (np.cumsum(side.sizes[ids]) for side, ids in zip(self._sides, (a, b), strict=True))
        a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
        some = n_a > 0
        a_cuts, b_cuts = shared_cuts(a_ends, b_ends, *(np.stack([to - n, to])[:, some] for to, n in ((a_to, n_a), (b_to, n_b))))
        n_groups = np.diff(np.searchsorted(a_cuts, np.concatenate([[0], a_to]), side="right"))
        got = Aligned(a, b, n_a, n_b, n_groups, a_cuts, b_cuts, a_ends, b_ends)
        at_a, at_b = got.links()
        self.a.add(a, n_a)
        self.b.add(b, n_b)
        self.a_ends.add(a_cuts - np.repeat(a_to - n_a, n_groups), n_groups)
        self.b_ends.add(b_cuts - np.repeat(b_to - n_b, n_groups), n_groups)
        self.pairs.add(a[at_a].astype(np.int64) * self.width_b + b[at_b], n_a + n_b - n_groups)
        self._shown += self._write(got)
        self._same = np.concatenate([self._same, some])
        self._seen = np.concatenate([self._seen, np.zeros(len(n_a), np.int64)])

    def _whole(self, parts: list[str]) -> list[int]:
        """The slot of a text whose stretches are not all reproduced; none if the text isn't, either."""
        sides = [np.array(list(chain.from_iterable(side.encode(parts))), np.int32) for side in self._sides]
        text = "".join(parts).encode()
        if any(b"".join(side.bytes_of[i] for i in ids) != text for side, ids in zip(self._sides, sides, strict=True)):
            return []
        # A key that no stretch has.
        number = self._slots[len(self._slots),]
        self._add(*(x for ids in sides for x in (ids, np.array([len(ids)]))))
        return [number]

    def align(self, texts: list[bytes]) -> Texts:
        """Texts that are empty or that either side does not reproduce have no tokens."""
        if len(self._slots) > self._capacity:
            self._thin()
        parts = [stretches(" " + t.decode()) if t else [] for t in texts]
        known = len(self._slots)
        slots = np.array(list(map(self._slots.__getitem__, chain.from_iterable(parts))), np.int64)
        if fresh := list(islice(reversed(self._slots), len(self._slots) - known))[::-1]:
            self._learn(fresh)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        wrong = np.flatnonzero(~self._same[slots])
        if len(wrong):
            held = [slots[x:y].tolist() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            for i in np.unique(np.searchsorted(edges, wrong, side="right") - 1).tolist():
                held[i] = self._whole(parts[i])
            slots = np.array(list(chain.from_iterable(held)), np.int64)
            edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))])
        self._seen[slots] += 1
        return Texts(slots, edges)

    def groups(self, got: Texts) -> list[bytes]:
        """The groups of each text, as :class:`GroupText` writes them."""
        shown = list(map(self._shown.__getitem__, got.slots.tolist()))
        edges = got.edges.tolist()
        return [b";".join(shown[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]


_OPEN: dict[tuple[str, str], Aligner] = {}


def _forget() -> None:
    for held in _OPEN.values():
        held.forget()


FORGET.append(_forget)


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker process."""
    if (path_a, path_b) not in _OPEN:
        _OPEN[path_a, path_b] = Aligner(path_a, path_b)
    return _OPEN[path_a, path_b]


def _cut(flat: np.ndarray, counts: np.ndarray, width: str) -> pa.Array:
    """The arrays of each text as little-endian bytes."""
    data, edges = flat.astype(width).tobytes(), np.dtype(width).itemsize * np.concatenate([[0], np.cumsum(counts)])
    return pa.array([data[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, a_ids, b_ids and a_ends, b_ends, the token numbers where groups end, of every row.

    All four are BINARY of little-endian uint32.  A text that is null or empty, or whose
    tokens don't reproduce it, has none.  Rows that repeat an id, or have none, are aligned
    one by one; texts of any length are aligned whole.  An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, text_column, CHUNK):
                own = aligner(path_a, path_b)
                got = own.align(texts)
                ids, ends = [], []
                for side, cuts in ((own.a, own.a_ends), (own.b, own.b_ends)):
                    sizes, n_cuts = side.sizes(got.slots), cuts.sizes(got.slots)
                    n, before = got.sums(sizes), np.cumsum(sizes) - sizes
                    before -= np.repeat(np.cumsum(n) - n, np.diff(got.edges))
                    ids.append((side.take(got.slots), n))
                    ends.append((cuts.take(got.slots) + np.repeat(before, n_cuts), got.sums(n_cuts)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], *(_cut(x, n, "<u4") for x, n in ids + ends)], names=[id_column, "a_ids", "b_ids", "a_ends", "b_ends"]
                )

    out = f"`{id_column}` {kind}, a_ids binary, b_ids binary, a_ends binary, b_ends binary"
    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), out)


def linked_pairs(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct id pairs linked in the row: pairs, times.

    A pair is a * (size of b's vocabulary) + b; ``pairs`` are little-endian uint64 (the
    differences of rising pairs), ``times`` uint32.  Rows are treated as in :func:`align`;
    without tokens ``groups_sha256`` is ''.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, text_column, CHUNK):
                own = aligner(path_a, path_b)
                got = own.align(texts)
                n_a, n_b, n_groups, n_links = (got.sums(pool.sizes(got.slots)) for pool in (own.a, own.b, own.a_ends, own.pairs))
                pair = own.pairs.take(got.slots)
                # Sorted within each text: texts in turn, by a stable sort of sorted runs' keys.
                text = np.repeat(np.arange(len(texts)), n_links)
                rank = np.lexsort((pair, text)) if own.width_a * own.width_b >> 40 else None
                if rank is None:
                    both = np.sort(text << 40 | pair)
                    text, pair = both >> 40, both & ((1 << 40) - 1)
                else:
                    text, pair = text[rank], pair[rank]
                new = np.ones(len(pair), bool)
                new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(pair)))
                text, pair = text[starts], pair[starts]
                n_pairs = np.bincount(text, minlength=len(texts))
                steps = np.diff(pair, prepend=0)
                first = np.flatnonzero(np.diff(text, prepend=-1))
                steps[first] = pair[first]
                sha = [hashlib.sha256(g).hexdigest() if g else "" for g in own.groups(got)]
                columns = [batch.column(0)[rows], *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links))]
                columns += [pa.array(sha), _cut(steps, n_pairs, "<u8"), _cut(times, n_pairs, "<u4")]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    out = f"`{id_column}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), out)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' pairs, and how many each row has."""
    held = column.to_pylist()
    steps = np.frombuffer(b"".join(held), "<u8").astype(np.int64)
    counts = np.fromiter(map(len, held), np.int64, len(held)) // 8
    run, own = np.cumsum(steps), counts[counts > 0]
    first = np.cumsum(own) - own
    return run - np.repeat(run[first] - steps[first], own), counts


def pair_counts(linked: DataFrame, width_b: int) -> DataFrame:
    """Pair, n (how many rows hold it) and best (no pair of its a id is held by more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, n = np.unique(_pairs(batch.column(0))[0], return_counts=True)
            seen, at = np.unique(np.concatenate([seen, new]), return_inverse=True)
            total = np.zeros(len(seen), np.int64)
            np.add.at(total, at, np.concatenate([times, n]))
            times = total
            if len(seen) >= COUNTED_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times)], names=["pair", "n"])
                seen, times = seen[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times)], names=["pair", "n"])

    counts = linked.select("pairs").mapInArrow(tidied(run), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = tables(linked.sparkSession).save(counts)
    of_a = F.expr(f"pair div {width_b}")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored_links(linked: DataFrame, counts: DataFrame, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """The rows with n_best (links whose pair is best) and count_sum (the sum of their pairs' counts)."""
    work = tables(linked.sparkSession)
    counts = work.save(counts)
    # The broadcast tier: counts of so many bits that at most table_pairs pairs have them.
    bits = F.length(F.bin("n"))
    room, least = table_pairs, None
    for row in sorted(counts.groupBy(bits.alias("bits")).count().collect(), reverse=True):  # 64 rows at most
        room -= row["count"]
        if room < 0:
            break
        least = row["bits"]
    table = counts.where(bits >= (99 if least is None else least)).sort("pair").toArrow()
    frequent = linked.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in linked.columns if c not in ("pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = frequent.value
        for batch in batches:
            pairs, sizes = _pairs(batch.column("pairs"))
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at = at[found]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            sums = []
            for worth in (best[at] if len(known) else at, count[at] if len(known) else at):
                value = np.zeros(len(pairs) + 1, np.int64)
                value[1:][found] = worth * times[found]
                sums.append(pa.array(np.diff(np.cumsum(value)[edges])))
            row = np.repeat(np.arange(len(sizes)), sizes)[~found]
            left = np.bincount(row, minlength=len(sizes))
            rest = [_cut(x[~found], left, "<i8") for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums, *rest], names=[*kept, "n_best", "count_sum", "rest", "rest_times"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.schema if f.name in kept)
    first = linked.mapInArrow(tidied(look_up), schema + ", n_best bigint, count_sum bigint, rest binary, rest_times binary")
    first = work.save(first.withColumn("row", F.monotonically_increasing_id()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("rest", "rest_times"))
            sizes = [len(x) // 8 for x in batch.column("rest").to_pylist()]
            row = np.repeat(batch.column("row").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pairs), pa.array(times)], names=["row", "pair", "times"])

    rest = first.where(F.length("rest") > 0).select("row", "rest", "rest_times").mapInArrow(tidied(spread), "row bigint, pair bigint, times bigint")
    rest = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    total = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return first.join(rest, "row", "left").select(*kept, total("n_best", "more_best"), total("count_sum", "more_sum"))


def alignment_report(
    docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", table_pairs: int = TABLE_PAIRS
) -> DataFrame:
    """Id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every row; rows are treated as in :func:`align`."""
    linked = tables(docs.sparkSession).save(linked_pairs(docs, path_a, path_b, id_column, text_column))
    width_b = len(PieceTokens(path_b).bytes_of)
    return scored_links(linked, pair_counts(linked, width_b), table_pairs)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """How the byte-level and the piece tokens of every document fall into groups and links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_report(docs, *paths)
