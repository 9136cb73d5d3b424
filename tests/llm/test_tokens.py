import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texts import corpus, frame

from tidemark.llm import bpe, packing, recurrence
from tidemark.llm.queries import vocabulary
from tidemark.llm.tokens import ByteEncoder, WordTable

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in (BYTE, WORD)}


@pytest.fixture(scope="module")
def fast():
    return {BYTE: ByteEncoder(vocabulary(BYTE)), WORD: WordTable(vocabulary(WORD))}


def unpack(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_every_character_and_piece(library, fast, name):
    texts = [f"a{chr(c)} b {chr(c)}{chr(c)}c  d{chr(c)} {chr(c)}1" for c in range(0x3200) if not 0xD800 <= c < 0xE000]
    texts += [x for k in library[name].get_vocab() for x in (" " + k.replace("</w>", ""), k.replace("Ġ", " "))]
    want = [e.ids for e in library[name].encode_batch(texts, add_special_tokens=False)]
    assert [unpack(b) for b in fast[name].encode(texts)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1. \n\t'é!\rśÀßA²µs<|>endoftext\x1c "), max_size=60))
def test_any_text(library, fast, text):
    for name in (BYTE, WORD):
        assert unpack(fast[name].encode([text])[0]) == library[name].encode(text, add_special_tokens=False).ids


def test_special_tokens_and_nulls(library, fast):
    for name in (BYTE, WORD):
        for t in ("x <|endoftext|> y", "<|startoftext|>", "<|"):
            assert unpack(fast[name].encode([t])[0]) == library[name].encode(t, add_special_tokens=False).ids
        assert fast[name].encode([None, ""]) == [b"", b""]


def test_bpe(spark, library):
    rows, path, lib = corpus(), vocabulary(WORD), library[WORD]
    got = Counter(tuple(r) for r in bpe.digests(frame(spark, rows), path).collect())
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    enc = bpe.encode(frame(spark, rows), path)
    back = Counter(tuple(r) for r in bpe.decode(enc, path).collect())
    assert back == Counter((i, lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows)
    assert bpe.digests(frame(spark, rows).where("false"), path).count() == 0


def test_bpe_tables(spark, library, monkeypatch, tmp_path):
    """One table of words for the corpus, in many ranges and parts; from files, left where they are."""
    monkeypatch.setattr(bpe, "RANGE_BYTES", 3000)
    monkeypatch.setattr(bpe, "HELD", 200)
    path, lib = vocabulary(WORD), library[WORD]
    rows = corpus() + [(600, "a <|endoftext|> b"), (601, "x\u2003y\u00a0z\x1cw"), (602, "<|"), (603, "nothing\u2003else\u0085here"), (604, "é😀 Ünï")]
    df = frame(spark, rows)
    df.write.parquet(f"file://{tmp_path}/docs")
    files = spark.read.parquet(f"file://{tmp_path}/docs")
    want = Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for docs in (df, files):
        assert Counter((r[0], tuple(r[1])) for r in bpe.encode(docs, path).collect()) == want
    assert Counter((r[0], r[1]) for r in bpe.digests(files, path).select("doc_id", "n_tokens").collect()) == Counter((i, len(x)) for i, x in want.elements())
    scan = recurrence.in_place(files.select("doc_id", F.upper("text")), "t")
    assert "docs" in scan.inputFiles()[0] and recurrence.in_place(df, "t").inputFiles()[0] not in scan.inputFiles()
    none = spark.createDataFrame([(1, None), (2, [5, 7])], "doc_id long, ids array<int>")
    assert {r[0]: r[1] for r in bpe.decode(none, path).collect()} == {1: "", 2: lib.decode([5, 7], skip_special_tokens=False)}


def check_packed(rows, capacity):
    """Sequences without gaps or overlaps, none too long."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("rank_task", [500_000, 7])
def test_packing(spark, library, monkeypatch, rank_task):
    monkeypatch.setattr(packing, "ROWS_PER_RANK_TASK", rank_task)
    rows, lib = corpus(), library[BYTE]
    for capacity in (1024, 50):
        got = packing.pack_documents(frame(spark, rows), vocabulary(BYTE), capacity).collect()
        n = check_packed(got, capacity)
        want = Counter()
        for i, t in rows:
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
            start, size, piece = 0, (len(ids) - 1) % capacity + 1, 0
            while start < len(ids):
                want[i, piece, start, size, zlib.crc32(struct.pack(f"<{size}I", *ids[start : start + size]))] += 1
                start, size, piece = start + size, capacity, piece + 1
        assert Counter(tuple(r)[:5] for r in got) == want
        total = sum(r["length"] for r in got)
        assert n <= total / capacity * 1.1 + 2
    assert packing.pack_documents(frame(spark, rows).where("false"), vocabulary(BYTE)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=15))
def test_plan(counts):
    bins = packing.plan(counts, 40)
    placed = Counter()
    for c, items in bins:
        assert c > 0 and sum(items) <= 40
        for n in items:
            placed[n] += c
    assert placed == Counter({n: c for n, c in counts.items() if c})
    # large items alone: no packing has fewer bins
    sizes = sorted(n for n, c in counts.items() for _ in range(c) if 3 * n > 40)
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        i += i < j and sizes[i] + sizes[j] <= 40
        j -= 1
        best += 1
    assert sum(c for c, _ in packing.plan({n: c for n, c in counts.items() if 3 * n > 40}, 40)) == best


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    counts = Counter(min(1024, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20000))
    bins = sum(c for c, _ in packing.plan(counts, 1024))
    bound = max(-(-sum(n * c for n, c in counts.items()) // 1024), sum(c for n, c in counts.items() if n > 512))
    assert bins <= 1.01 * bound
    with pytest.raises(ValueError):
        packing.plan({1025: 1}, 1024)
