"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def lines(docs, min_docs=3, min_chars=20):
    """doc_id -> (n_lines, n_dropped, kept text)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in docs.items():
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = {}
    for i, text in docs.items():
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


def contamination(docs, items, window=10):
    """doc_id -> (n_words, n_hit, sorted item ids)."""
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[i : i + size])].add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in docs.items():
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = grams.get(tuple(w[i : i + size]))
                if got:
                    hit |= set(range(i, i + size))
                    found |= got
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def repeated_words(docs, window=20):
    """doc_id -> (n_words, n_removed, kept text)."""
    first = {}
    words = {i: SPACE.findall(t or "") for i, t in docs.items()}
    for i in sorted(words):
        for at in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][at : at + window]), (i, at))
    out = {}
    for i, w in words.items():
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] != (i, at):
                gone |= set(range(at, at + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


def shingle_classes(docs, size=3, percent=90):
    """doc_id -> (number of shingles, smallest id reachable)."""
    sets = {}
    for i, text in docs.items():
        w = SPACE.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    for a, s in sets.items():
        shared = Counter(b for g in s for b in by[g] if b > a)
        for b, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
