"""Hashes of words and of runs of words, for a batch of texts at a time, without a Python object per word.

Words are what ASCII white space parts. A word's hash is a polynomial of its bytes modulo 2**64, taken
from one running sum over the batch, then mixed; so equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = 0xD6E8FEB86659FD93
#: Bytes of text hashed at once; a longer text comes alone.
BATCH = 1 << 20
#: Bytes whose products are summed while they are in the cache.
PART = 1 << 14
#: Hashes a text, on average, from which each text's are sorted by themselves.
FEW = 16

_powers: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1."""
    if len(_powers[0]) < n:
        size = max(n, BATCH + (1 << 16))
        made = []
        for b in (BASE, BASE_INVERSE):
            p = np.full(size, b, "u8")
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * BATCH:  # of one very long text: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """All words of a batch: hash, first and one past the last byte in `raw`; text i has words first[i] to first[i + 1]."""

    raw: bytes
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_at: np.ndarray  # where each text starts in raw


def words(texts: list[str | None]) -> Words:
    parts = [(t or "").encode() for t in texts]
    raw = b"\n".join(parts) + b"\n"
    b = np.frombuffer(raw, "u1")
    space = np.ones(len(b) + 1, bool)
    np.logical_or(b == 32, b - np.uint8(9) <= 4, out=space[1:])
    edge = np.flatnonzero(space[1:] != space[:-1])  # the last byte is a space, so each start has its end
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, "u8")
    for i in range(0, len(b), PART):
        own = total[i + 1 : i + 1 + PART]
        np.add(b[i : i + PART], np.uint64(1), out=own)
        np.multiply(own, power[i : i + len(own)], out=own)
        own[:1] += total[i : i + 1]
        np.cumsum(own, out=own)
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype("u8"))
    text_at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return Words(raw, h, start, end, np.searchsorted(start, text_at), text_at[:-1])


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k following items; k - 1 fewer than the items."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, "u8")
    m = 1
    for j in range(k):
        out += h[j : j + n] * np.uint64(m)
        m = m * STEP % (1 << 64)
    return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of k words inside a text; a text of fewer words has one, of all its words."""
    count = np.diff(w.first)
    text = np.repeat(np.arange(len(count)), count)
    whole = runs(w.hash, k)
    inside = text[: len(whole)] == text[k - 1 :] if len(whole) else np.zeros(0, bool)
    at, h = text[: len(whole)][inside], whole[inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.array([int(mix(runs(w.hash[w.first[i] : w.first[i + 1]], int(count[i])) + np.uint64(count[i]))[0]) for i in short], "u8")
        at, h = np.concatenate([at, short]), np.concatenate([h, own])
    return at, h


def counted(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in that order, and how often each occurs."""
    if len(at) and (at[1:] < at[:-1]).any():
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, "i8")
    if len(begin) * FEW > len(at):
        h = h[np.lexsort((h, at))]
    else:
        h = h.copy()
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(h)]):
            h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    where = np.flatnonzero(new)
    return at[where], h[where], np.diff(np.concatenate([where, [len(h)]]))


def batches(texts: list[str | None], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > most:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)
