"""Public tokenizers on whole texts, and a table of distinct words for those that drop white space.

A split at white space changes nothing there: the tokenizer's own split ends a piece at it.
Merging the bytes of Latin text is left to tiktoken, which does it several times faster with ranks
read from the same file; all else (other letters, texts with the names of special tokens or unusual
white space) goes to the tokenizers library as it is. Tests hold the two against each other.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Where the simple pattern differs from the full one, or tiktoken may differ from the library.
UNSAFE = re.compile(r"\s\s|<\||[^\t-\r\x20-\u024f]")
OTHER = re.compile(r"<\||[^\t-\r\x20-\u024f]")
WHOLE = re.compile(r"<\||[\x1c-\x1f]")
SAFE = re.compile(r"[\n\x20-\x7e\xa1-\xff]+")
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two white-space characters follow each other, and without look-ahead, so faster.
SIMPLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a word in the ranks; no UTF-8 text holds this byte.
WORD_END = b"\xff"
#: Words that a Python worker keeps encoded; beyond it the table starts anew, so memory is bounded.
TABLE_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table(dict):
    """word -> ids, by `make` where it isn't there yet."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        if len(self) > TABLE_WORDS:
            self.clear()
        self[word] = made = self.make(word)
        return made


def _model(path: str) -> tuple[dict, dict[bytes, int], bool]:
    """The model in a tokenizer's file, its ranks, and whether ids follow the order of merges, as ranks must."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, suffix = byte_letters(), model.get("end_of_word_suffix") or ""
    ranks = {}
    for token, i in model["vocab"].items():
        end = bool(suffix) and token.endswith(suffix)
        try:
            ranks[bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + (WORD_END if end else b"")] = i
        except KeyError:  # a special token
            continue
    order = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = {bytes([b]) for b in range(256)}
    return model, ranks, order == sorted(order) and single <= ranks.keys() and (not order or order[0] > max(ranks[b] for b in single))


def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class ByteEncoder:
    """Encodes whole texts with a byte-level vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = _library(path)
        _, ranks, self.fast = _model(path)
        self.full, self.simple = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (BYTE_PATTERN, SIMPLE_PATTERN))

    def text(self, text: str) -> bytes:
        if not self.fast or UNSAFE.search(text):
            if not self.fast or OTHER.search(text):
                return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return pack(self.full(text))
        return pack(self.simple(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: of the empty text), as little-endian unsigned 32-bit integers."""
        return [self.text(t) if t else b"" for t in texts]


class WordTable:
    """word -> its ids as little-endian unsigned 32-bit integers, for vocabularies that drop white space."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.tokenizer = _library(path)
        model, ranks, self.fast = _model(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.fast = self.fast and bool(self.suffix)
        self.split = regex.compile(WORD_PATTERN).findall
        self.merge = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ids = _Table(self.one)

    def one(self, word: str) -> bytes:
        """The ids of a word, encoded when it is first met; marks that follow it are words of their own."""
        if not self.fast or not SAFE.fullmatch(word):
            return pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low.isalpha():
            return pack(self.merge(low.encode() + WORD_END))
        if len(low) > 1 and low[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.ids[word[:-1]] + self.ids[word[-1]]
        return pack([i for p in self.split(low) for i in self.merge(p.encode() + WORD_END)])

    def text(self, text: str) -> bytes:
        if WHOLE.search(text):
            return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.ids.__getitem__, text.split()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: of the empty text)."""
        return [self.text(t) if t else b"" for t in texts]


_kept: dict[tuple[type, str], object] = {}


def encoder(kind: type, path: str):
    """One for each Python worker, which keeps it from task to task."""
    if (kind, path) not in _kept:
        _kept.clear()
        _kept[kind, path] = kind(path)
    return _kept[kind, path]
