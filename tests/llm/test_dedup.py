import hashlib
import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import corpus, edited, frame, prose

from tidemark.llm import common, neardup, passages, recurrence, suffixes, vectors

HASH = 2**32


@pytest.fixture(scope="module")
def rows():
    return corpus()


def order(rows, spark):
    """Distinct (id, text) in the order of (id, hash of the text), nulls first."""
    t = spark.createDataFrame([(x or "",) for x in {t for _, t in rows}], "t string").distinct()
    tie = {r["t"]: r["h"] for r in t.select("t", F.hash("t").alias("h")).collect()}
    return sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))


# --- suffixes -----------------------------------------------------------------------------------


def brute_suffix(ordered, length):
    seen, out = set(), {}
    for key in ordered:
        b = key[1].encode()
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[key] = (len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, z in zip(b, mark) if not z)).hexdigest())
    return out


@pytest.mark.parametrize("settings", [{}, {"HOT": 1}, {"BROADCAST_COPIES": 0, "CHUNK": 700, "SORTED": 2000, "REMEMBER": 5}])
def test_suffix_dedup(spark, rows, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(suffixes, k, v)
    want = brute_suffix(order(rows, spark), suffixes.LENGTH)
    got = suffixes.dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for (i, t), v in want.items():
        by[i].add(v)
    for r in got:
        assert tuple(r)[1:5] in by[r["doc_id"]]
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert {tuple(r) for r in got} == {(i, *v) for (i, _), v in want.items()}


def test_suffix_dedup_keeps_the_text_and_takes_an_empty_table(spark, rows):
    df = frame(spark, rows)
    for r in suffixes.dedup(df, keep_text=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    assert suffixes.dedup(df.where("false")).count() == 0


def test_smaller_positions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 40):
        for _ in range(20):
            x, g = rng.permutation(n), np.sort(rng.integers(0, 4, n))
            for group in (None, g):
                near = lambda i, j: group is None or group[i] == group[j]
                before, after = suffixes.smaller(x, group)
                assert before.tolist() == [max((j for j in range(i) if x[j] < x[i] and near(i, j)), default=-1) for i in range(n)]
                assert after.tolist() == [min((j for j in range(i + 1, n) if x[j] < x[i] and near(i, j)), default=-1) for i in range(n)]


def test_longest_previous_factors():
    rng = random.Random(1)
    for b in (b"", b"a", b"aaaa", b"abracadabra", bytes(rng.choice(b"ab") for _ in range(60))):
        want = [max((n for n in range(len(b) - i + 1) if b.find(b[i : i + n], 0, i + n - 1) >= 0 and b.find(b[i : i + n]) < i), default=0) for i in range(len(b))]
        assert suffixes.longest_previous_factors(b).tolist() == want
        assert suffixes.suffix_array(b).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


# --- near-duplicates ----------------------------------------------------------------------------


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, similar):
    """Classes of distinct texts by weighted Jaccard similarity with exact document frequencies, and all similarities over 0.3."""
    count = Counter(t or "" for _, t in rows)
    texts = sorted(count)
    s = [shingles(t) for t in texts]
    df, n, places = Counter(), sum(count.values()), defaultdict(list)
    for i, (t, own) in enumerate(zip(texts, s)):
        for x in own:
            df[x] += count[t]
            places[x].append(i)
    idf = {x: 1 + np.log((n + 1) / (k + 1)) / np.log(n + 2) for x, k in df.items()}
    total = [sum(c * idf[x] for x, c in own.items()) for own in s]
    both = Counter()
    for x, at in places.items():
        for k, i in enumerate(at):
            for j in at[:k]:
                both[j, i] += min(s[i][x], s[j][x]) * idf[x]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = []
    for (i, j), w in both.items():
        sim = w / (total[i] + total[j] - w)
        if sim > 0.3:
            near.append((sim, texts[i], texts[j]))
        if sim >= similar:
            parent[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(texts)}, near


def expected_classes(rows, root):
    least, size = {}, Counter()
    for i, t in rows:
        c = root[t or ""]
        size[c] += 1
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return Counter((i, least.get(root[t or ""]), size[root[t or ""]]) for i, t in rows)


@pytest.mark.parametrize("settings", [{}, {"BLOCK": 3, "BROADCAST_KEYS": 0}])
def test_near_duplicates(spark, rows, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(neardup, k, v)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    root, near = brute_classes(rows, 0.8)
    assert not [x for x in near if 0.799 < x[0] < 0.801], "the corpus should leave no doubt"
    assert Counter(tuple(r) for r in got) == expected_classes(rows, root)


def test_near_duplicates_of_the_documents(spark):
    """Every link of weighted similarity 0.8 or more, by brute force over all pairs that share a shingle."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    root, _ = brute_classes(rows, 0.8)
    assert Counter(tuple(r) for r in neardup.near_duplicates(df).collect()) == expected_classes(rows, root)


def family():
    """Variants of one text around the threshold, where estimates often err, and a template with texts of their own."""
    rng = random.Random(77)
    base = prose(rng, 200)
    rows = [(i, edited(rng, base, rng.choice([2, 3, 4, 5, 6]))) for i in range(120)]
    template = prose(rng, 120)
    return rows + [(500 + i, f"{template} {prose(rng, rng.randrange(15, 40))}") for i in range(60)]


def test_families_around_the_threshold(spark):
    """A pair that fails is replaced by the next best, until no pair is left that could join two classes."""
    rows = family()
    root, near = brute_classes(rows, 0.8)
    sims = [x[0] for x in near]
    assert sum(0.7 < x < 0.8 for x in sims) > 100 and 20 < len(set(root.values())) < len(rows)
    got = Counter(tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    want = expected_classes(rows, root)
    # a link in a thousand has an estimate under LEAST_ESTIMATE or no band in common
    assert sum((got & want).values()) >= 0.98 * len(rows)


def test_buckets_larger_than_a_block_lose_no_pair(spark, monkeypatch):
    """Nodes that share one band alone, more of them than are compared at once."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(4)
    nodes = [bytes([k]) * 16 for k in range(30)]
    made = rng.integers(0, 1 << 32, (30, neardup.BANDS * neardup.ROWS), dtype="u4")
    made[:, :3] = 7
    fit, large = neardup._buckets(spark.createDataFrame(list(zip(nodes, (m.tobytes() for m in made))), "node binary, samples binary"))
    assert fit.count() == 0 and {bytes(r["node"]) for r in large.collect()} == set(nodes)
    classes = {n: nodes[0] if k < 20 else n for k, n in enumerate(nodes)}
    for of in (None, classes):
        tiles = neardup._tiles(large, of and spark.createDataFrame(list(of.items()), "node binary, component binary"))
        blocks = defaultdict(set)
        for r in tiles.collect():
            blocks[r["bucket"]].add(bytes(r["node"]))
        assert max(map(len, blocks.values())) <= 4
        met = {(a, b) for own in blocks.values() for a in own for b in own}
        assert all((a, b) in met for a in nodes for b in nodes if (of or {}).get(a, a) != (of or {}).get(b, b))
    assert len(blocks) < 15 * 14 // 2 - 40  # parts of one class don't meet


def test_workers_hand_memory_back():
    """What a process holds after a task's batches is little more than before them."""
    code = """
import pyarrow as pa
from tidemark.llm.common import small

def held():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) / 1024

def parts():
    for _ in range(4):
        yield pa.RecordBatch.from_arrays([pa.array(["x" * 2000] * 10_000)], names=["t"])

def task():
    for b in small(parts()):
        pa.RecordBatch.from_arrays([pa.array(b.column(0).to_pylist())], names=["t"])

task()
pool = pa.default_memory_pool()
after = held()
pool.release_unused()
print(after - held())
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True).stdout
    assert float(got) < 10


def test_keep_one(spark, rows):
    df = frame(spark, rows)
    for c in ("_md5", "_id", "_node", "component", "class_id"):
        df = df.withColumn(c, F.lit("kept"))
    kept = neardup.keep_one(df)
    root, _ = brute_classes(rows, 0.8)
    assert kept.columns == df.columns
    assert sorted(root[r["text"] or ""] for r in kept.collect()) == sorted(set(root.values()))
    assert neardup.keep_one(df.where("false")).count() == 0


def test_recurrence(spark, monkeypatch):
    """Counts of hashes over the corpus, told to each place, by brute force."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 400, rng.integers(0, 60)))) for _ in range(500)] + ["7 7 7"] * 50
    monkeypatch.setattr(recurrence, "RANGE", 64)
    monkeypatch.setattr(recurrence, "HELD", 300)
    table = recurrence.placed(spark.createDataFrame([(t,) for t in texts], "text string").repartition(6), "t")

    def hashes(b):
        return vectors.words(b.column(0).to_pylist()).hash

    counts = recurrence.counted(table, hashes, 10_000, "counts")
    want = Counter(int(x) for x in vectors.words(texts).hash)
    rows = table.collect()
    assert len({r["place"] for r in rows}) == 6
    for r in rows:
        h = vectors.words([r["text"]]).hash
        assert counts.count(r["place"], h).tolist() == [want[int(x)] for x in h]
    assert counts.count(12345, np.array([1], "u8")).tolist() == [1]
    # the first occurrence of each word that recurs
    for ids in ([None, *range(len(texts) - 1)], [f"d{k % 97}" if k % 5 else None for k in range(len(texts))]):
        kind = "long" if isinstance(ids[1], int) else "string"
        docs = spark.createDataFrame([(i, k % 3, t) for k, (i, t) in enumerate(zip(ids, texts))], f"id {kind}, tie int, text string").repartition(6)
        table = recurrence.placed(docs, "t")
        rows = table.collect()

        def found(b, place):
            w = vectors.words(b.column(2).to_pylist())
            text = np.repeat(np.arange(b.num_rows), np.diff(w.first))
            return w.hash, text, np.arange(len(text)) - w.first[text]

        told = recurrence.firsts(table, found, 10_000, "firsts")
        best = {}
        for r in rows:
            for p, h in enumerate(vectors.words([r["text"]]).hash.tolist()):
                here = ((r["id"] is not None, r["id"] or (0 if kind == "long" else "")), r["tie"], p)
                best[h] = min(best.get(h, here), here)
        for place in {r["place"] for r in rows}:
            known = {int(h): (i, t, p) for h, i, t, p in zip(told.of(place)[0], told.of(place)[1].to_pylist(), *told.of(place)[2:])}
            own = {int(h) for r in rows if r["place"] == place for h in vectors.words([r["text"]]).hash}
            assert {int(told.cut(np.array([h], "u8"))[0]) for h in own if want[h] > 1} == set(known)
            for h in own:
                if want[h] > 1:
                    (some, i), t, p = best[h]
                    assert known[int(told.cut(np.array([h], "u8"))[0])] == (i if some else None, t, p)
    empty = recurrence.placed(spark.createDataFrame([], "text string"), "t")
    assert recurrence.counted(empty, hashes, 0, "counts").count(1, np.zeros(0, "u8")).tolist() == []


def test_samples_agree_as_often_as_weighted_sets_do():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 2**63, 300, dtype="u8"))
    a, b = rng.uniform(0.5, 3, 300).astype("f4"), rng.uniform(0.5, 3, 300).astype("f4")
    a[:40], b[-40:] = 0, 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    at = np.concatenate([np.zeros((a > 0).sum(), "i8"), np.ones((b > 0).sum(), "i8")])
    m = neardup.samples(at, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    assert abs((m[0] == m[1]).mean() - want) < 0.04


def test_samples_of_usual_weights_are_looked_up(monkeypatch):
    rng = np.random.default_rng(4)
    at = np.repeat(np.arange(40), rng.integers(0, 60, 40))
    h = rng.integers(0, 1 << 63, len(at), dtype="u8")
    w = rng.choice([1, 2, 5], len(at), p=[0.9, 0.07, 0.03]).astype("f4")
    h[1], w[1] = h[0], w[0]  # a tie
    r_, c_, b_ = neardup.variates()
    multipliers = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 5, dtype="u8") * np.uint64(2) + np.uint64(1)
    want = np.zeros((41, 5), "u4")
    for text in set(at.tolist()):
        own = np.flatnonzero(at == text)
        for j in range(5):
            k = (h[own] * multipliers[j]) >> np.uint64(48)
            t = np.floor(np.log(w[own]) / r_[k] + b_[k])
            i = int((c_[k] - r_[k] * (t - b_[k] + 1)).argmin())
            want[text, j] = vectors.mix(h[own][i : i + 1] + (t[i : i + 1].astype("i8").astype("u8") + np.uint64(j << 32)) * np.uint64(vectors.STEP))[0] >> np.uint64(32)
    worked, ranked = [], neardup._ranked
    monkeypatch.setattr(neardup, "_ranked", lambda *a: worked.append(len(a[0])) or ranked(*a))
    assert (neardup.samples(at, h, w, 41, 5) == want).all()
    worked.clear()
    assert (neardup.samples(at, h, w, 41, 5) == want).all()
    assert sum(worked) == 5 * int((w != 1).sum()), "all shingles are worked out"


def test_most_hashes_are_not_searched(spark, monkeypatch):
    rng = np.random.default_rng(5)
    known = np.sort(rng.integers(0, 1 << 40, 1000, dtype="u8"))
    monkeypatch.setattr(recurrence, "lists", lambda *_: [(pa.scalar(recurrence.packed(known)), pa.scalar(recurrence.small_ints(np.full(1000, 3))))])
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: asked.append(len(v)) or search(a, v, *x, **y))
    h = np.concatenate([known << np.uint64(24), rng.integers(0, 1 << 63, 20_000, dtype="u8")])
    n = recurrence.Counts("nowhere", 40).count(0, h)
    assert n[:1000].tolist() == [3] * 1000 and n[1000:].tolist() == [3 if x >> 24 in set(known.tolist()) else 1 for x in h[1000:].tolist()]
    assert sum(asked) < 5000, "every hash is searched for"


def test_unlike_words_end_an_extension_at_once(monkeypatch):
    rng = random.Random(6)

    def plain(a, b):  # an extension from every place
        i = j = 0
        out = []
        while True:
            took = passages._extend(a[i:], b[j:])
            out += [(i, j, took)] * (took > 0)
            i, j = i + took, j + took
            p, q = a[i : i + passages.MOST_SHIFT + 1].tolist(), b[j : j + passages.MOST_SHIFT + 1].tolist()
            jump = min(((x + y, x) for x in range(len(p)) for y in range(len(q)) if x + y and p[x] == q[y] and passages._agree(a[i + x :], b[j + y :])), default=None)
            if jump is None:
                return out
            i, j = i + jump[1], j + jump[0] - jump[1]

    for _ in range(600):
        a = [rng.randrange(1, rng.choice([4, 40, 400])) for _ in range(rng.randrange(70))]
        b = [x if rng.random() < 0.8 else rng.randrange(1, 400) for x in a[rng.randrange(3) :]]
        a, b = np.array(a, "u4"), np.array(b, "u4")
        assert passages._extend_over(a, b) == plain(a, b)
    monkeypatch.setattr(passages, "_extend", lambda *_: pytest.fail("words without an equal one are compared"))
    assert passages._extend_over(np.arange(1, 60, dtype="u4"), np.arange(100, 160, dtype="u4")) == []


def test_lists_of_lists_as_arrow_reads_them():
    for rows in ([], [[]], [[[]], [], [[1, 2], [3]], [[], [4]]]):
        a = pa.array(rows, pa.list_(pa.list_(pa.int32())))
        for i in range(len(rows) + 1):
            assert list(passages._lists(a.slice(i))) == rows[i:]


def test_words_are_those_that_white_space_parts():
    texts = ["", None, " a  b\n", "é\tà b", "x" * 70, "a b"]
    w = vectors.words(texts)
    got = [[w.raw[s:e].decode() for s, e in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [(t or "").split() for t in texts]
    words = [x for t in texts for x in (t or "").split()]
    assert len({h: None for h in w.hash.tolist()}) == len(set(words))
    assert all((a == b) == (x == y) for a, x in zip(w.hash, words) for b, y in zip(w.hash, words))


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 1), (9, 8), (8, 7), (7, 3), *((k, k + 1) for k in range(20, 60)), *((100, k) for k in range(101, 160))]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 4: 4, 5: 4, **dict.fromkeys(range(20, 61), 20), **dict.fromkeys(range(100, 160), 100)}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder(spark):
    """What an application wrote is deleted; a cluster without a shared folder is an error."""
    at = common.shared_dir(spark).removeprefix("file://")
    assert common.materialize(spark.range(3), "t").count() == 3
    assert list(Path(at).rglob("t/*.parquet"))
    common.clean(spark)
    assert not list(Path(at).rglob("*.parquet"))

    class Local:
        class conf:
            get = staticmethod(lambda name, default: None)

        sparkContext = spark.sparkContext

    assert common.shared_dir(Local) == common.shared_dir(Local) != common.shared_dir(spark)

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)
    assert common.fresh(spark.createDataFrame([], "_ID int, __x int"), "id", "x") == ["___id", "___x"]


# --- passages -----------------------------------------------------------------------------------


def covered(rows, spark):
    """Words inside a 50-word window that an earlier document has, or this one at an earlier place."""
    first, out = {}, {}
    for i, t in order(rows, spark):
        w, own = t.split(), set()
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            if first.setdefault(x, (i, t, k)) != (i, t, k):
                own |= set(range(k, k + 50))
        out[i, t] = own
    return out


@pytest.mark.parametrize("keys", [400_000, 0])
def test_passages(spark, rows, monkeypatch, keys):
    monkeypatch.setattr(passages, "BROADCAST_KEYS", keys)
    got = defaultdict(set)
    for r in passages.passages(frame(spark, rows)).collect():
        got[r["id"], r["tie"]] |= set(range(r["start"], r["end"]))
    found = defaultdict(set)
    for (i, _), s in got.items():
        found[i] |= s
    want = covered(rows, spark)
    for (i, t), own in want.items():
        assert own <= found[i]
    clean = {i for i, _ in rows} - {i for (i, _), own in want.items() if own} - {300 + k for k in range(10)}
    assert not clean & {i for i, s in found.items() if s}


def test_fuzzy_passage(spark):
    rng = random.Random(9)
    passage = prose(rng, 90)
    fuzzy = edited(rng, passage, 5)
    docs = frame(spark, [(1, f"{prose(rng, 70)} {passage} {prose(rng, 70)}"), (2, f"{prose(rng, 50)} {fuzzy} {prose(rng, 50)}"), (3, prose(rng, 200))])
    (r,) = passages.report(docs).collect()
    assert (r["doc_id"], r["source_doc_id"], r["copy"]) == (2, 1, False)
    assert abs(r["start"] - 50) < 5 and abs(r["end"] - 140) < 5 and r["matches"] >= 80


@pytest.mark.parametrize("gap, other", [(60, 60), (60, 75), (100, 100), (100, 90), (150, 400)])
def test_passages_with_unlike_words_between(spark, gap, other):
    rng = random.Random(12)
    one, two = prose(rng, 60), prose(rng, 60)
    between = [f"own{k}" for k in range(gap)], [f"other{k}" for k in range(other)]
    docs = frame(spark, [(1, f"{one} {' '.join(between[0])} {two}"), (2, f"{prose(rng, 40)} {one} {' '.join(between[1])} {two} {prose(rng, 40)}")])
    got = sorted((r["start"], r["end"], r["source_start"], r["source_end"], r["matches"]) for r in passages.report(docs).collect())
    assert got == [(40, 100, 0, 60, 60), (100 + other, 160 + other, 60 + gap, 120 + gap, 60)]


@pytest.mark.parametrize("keys", [400_000, 0])
def test_passage_whose_halves_other_documents_have(spark, monkeypatch, keys):
    monkeypatch.setattr(passages, "BROADCAST_KEYS", keys)
    for seed in range(2):
        rng = random.Random(seed)
        words = prose(rng, 60).split()
        half, rest, whole = " ".join(words[:30]), " ".join(words[30:]), " ".join(words)
        rows = [(k, f"{prose(rng, 40)} {x} {prose(rng, 40)}") for k, x in ((1, half), (2, rest), (5, whole), (6, whole))]
        got = [(r["doc_id"], r["source_doc_id"], r["start"], r["end"]) for r in passages.report(frame(spark, rows)).collect()]
        assert got == [(6, 5, 40, 100)]


def test_passage_of_lines_that_many_documents_have(spark):
    rng = random.Random(3)
    lines = [prose(rng, 25) for _ in range(3)]
    rows = [(k, f"{prose(rng, 30)} {lines[k % 3]} {prose(rng, 30)}") for k in range(30)]
    rows += [(k, f"{prose(rng, 30)} {' '.join(lines)} {prose(rng, 30)}") for k in (50, 51)]
    got = [(r["doc_id"], r["source_doc_id"], r["start"], r["end"]) for r in passages.report(frame(spark, rows)).collect()]
    assert got == [(51, 50, 30, 105)]


def test_windows_that_recur_are_all_kept():
    rng = random.Random(8)
    passage = prose(rng, 70)
    w = vectors.words([f"{prose(rng, 33)} {passage} {prose(rng, 20)}", f"{prose(rng, 10)} {passage}"])
    at, h, pos = passages.seeds(w)
    once = np.isin(h, [x for x, n in Counter(h.tolist()).items() if n == 1])
    text, _, start = passages.windows(w, pos[once])
    got = set(zip(text.tolist(), (start - w.first[text]).tolist()))
    assert {(0, 33 + k) for k in range(21)} | {(1, 10 + k) for k in range(21)} <= got
    assert len(got) <= 42 + 60


def test_pieces_that_many_documents_have(spark):
    """Overlapping parts of a passage in eight documents, all of it in two later ones."""
    rng = random.Random(21)
    words = prose(rng, 120).split()
    rows = [(k, f"{prose(rng, 40)} {' '.join(words[12 * k : 12 * k + 30])} {prose(rng, 40)}") for k in range(8)]
    rows += [(k, f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}") for k in (100, 101)]
    got = [(r["doc_id"], r["source_doc_id"], r["start"], r["end"]) for r in passages.report(frame(spark, rows)).collect()]
    assert got == [(101, 100, 40, 160)]


def test_passage_twice_in_one_document(spark):
    rng = random.Random(22)
    passage = prose(rng, 120)
    line = "the same line again and again "
    rows = [(1, f"{prose(rng, 40)} {passage} {prose(rng, 40)} {passage}"), (2, line * 40), (3, f"{prose(rng, 10)} {passage}"), (None, passage), (None, passage)]
    df = frame(spark, rows)
    got = sorted((r["doc_id"] or 0, r["source_doc_id"] or 0, r["start"], r["end"]) for r in passages.report(df).collect())
    assert got == [(1, 0, 40, 160), (1, 0, 200, 320), (2, 2, 6, 240), (3, 0, 10, 130)]
    left = {r["doc_id"]: r["text"].split() for r in passages.remove(df).collect()}
    assert len(left[1]) == 80 and left[2] == line.split() and len(left[3]) == 10 and len(left[None]) == 120


def test_edited_passages_with_few_seeds_are_all_found(spark):
    """Every sixth word changed: runs of five words are left, and each of them is a seed."""
    rng = random.Random(66)
    rows = []
    for k in range(80):
        passage = prose(rng, 60).split()
        rows.append((k, f"{prose(rng, 20)} {' '.join(passage)} {prose(rng, 20)}"))
        rows.append((1000 + k, f"{prose(rng, 20)} {' '.join(f'new{k}x{i}' if i % 6 == 5 else x for i, x in enumerate(passage))} {prose(rng, 20)}"))
    got = {(r["doc_id"], r["source_doc_id"]) for r in passages.report(frame(spark, rows)).collect()}
    assert got == {(1000 + k, k) for k in range(80)}


@pytest.mark.parametrize("every, words, least", [(8, 120, 0.98), (7, 120, 0.97), (6, 120, 0.9), (10, 60, 0.95), (0, 80, 0.9)])
def test_recall_of_edited_passages(spark, every, words, least):
    """Passages with each `every`-th word changed, or (0) 15 % of words anywhere: share of their words found."""
    rng = random.Random(every)
    rows, where = [], {}
    for k in range(60):
        passage = prose(rng, words).split()
        rows.append((k, f"{prose(rng, 60)} {' '.join(passage)} {prose(rng, 60)}"))
        start = rng.randrange(every) if every else 0
        change = set(range(start, words, every)) if every else set(rng.sample(range(words), words * 15 // 100))
        edited_ = [f"new{rng.randrange(10**6)}" if i in change else x for i, x in enumerate(passage)]
        rows.append((1000 + k, f"{prose(rng, 60)} {' '.join(edited_)} {prose(rng, 60)}"))
        where[1000 + k] = set(range(60, 60 + words))
    found = defaultdict(set)
    for r in passages.report(frame(spark, rows)).collect():
        assert r["source_doc_id"] == r["doc_id"] - 1000 and r["matches"] >= 0.8 * (r["end"] - r["start"])
        found[r["doc_id"]] |= set(range(r["start"], r["end"]))
    share = sum(len(found[k] & w) for k, w in where.items()) / (60 * words)
    print(every, words, share)
    assert share >= least
    assert sum(len(found[k] - w) for k, w in where.items()) < 0.02 * 60 * words


def test_reach_is_never_less_than_an_extension():
    """From the bits of the words beside a seed: no less than what is aligned there, and mostly not left open."""
    rng = random.Random(31)
    told = many = 0
    for k in range(3000):
        names = [f"w{i}" for i in range(rng.choice([2, 5, 60, 2000]))]
        a, b = ([rng.choice(names) for _ in range(rng.randrange(25))] for _ in range(2))
        for x in range(0, min(len(a), len(b)), rng.randrange(1, 9)):  # some words in common, on one diagonal or another
            b[x] = a[max(0, x - k % 3)]
        texts = [f"{' '.join(a[::-1])} 1 2 3 4 5 {' '.join(a)}", f"{' '.join(b[::-1])} 1 2 3 4 5 {' '.join(b)}"]
        w = vectors.words(texts)
        at = np.array([len(a), w.first[1] + len(b)])
        (before, after), (before2, after2) = (passages._halves(passages.near(w)[at[i : i + 1]]) for i in range(2))
        x, y = (passages._short(w.hash[w.first[i] : w.first[i + 1]]) for i in range(2))
        s = passages.align([(len(a), len(b))], x, y)
        left, right = max(len(a) - s[0][0], len(b) - s[0][1]), max(s[-1][0] - len(a), s[-1][1] - len(b)) + s[-1][2] - passages.K
        for got, took in ((passages.reach(before, before2)[0], left), (passages.reach(after, after2)[0], right)):
            assert got >= min(took, passages.MIN_WORDS)
            if len(names) > 1000 and k % 3 == 0 and not set(a) & set(b):
                told, many = told + (got < passages.MIN_WORDS), many + 1
    assert many > 30 and told >= 0.8 * many


def test_phrases_in_common_are_no_pairs(spark, monkeypatch):
    """Documents that share some words only are told apart before their words are sent anywhere."""
    rng = random.Random(32)
    phrases = [prose(rng, 5 + k % 4) for k in range(30)]
    passage = prose(rng, 60).split()
    rows = [(k, " ".join(f"{prose(rng, 30)} {rng.choice(phrases)}" for _ in range(4))) for k in range(60)]
    rows += [(100, f"{prose(rng, 30)} {' '.join(passage)}"), (101, f"{' '.join('new' if i % 6 == 5 else x for i, x in enumerate(passage))} {prose(rng, 30)}")]
    sent, write = [], passages.materialize
    monkeypatch.setattr(passages, "materialize", lambda df, name: [out := write(df, name), sent.append(out.count()) if name == "pairs" else None][0])
    got = [(r["doc_id"], r["source_doc_id"]) for r in passages.report(frame(spark, rows)).collect()]
    assert got == [(101, 100)] and sent[0] <= 30


def test_shuffle_files_go_with_their_job(spark, tmp_path):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    before = files.getAllFiles().size()
    with common.tidy(spark):
        spark.range(1000).repartition(5, "id").write.parquet(f"{tmp_path}/a")
    assert files.getAllFiles().size() <= before and spark.conf.get(name, None) == setting


def test_judged_by_brute_force():
    """Equal runs of 50 are found, and something wherever a part of 50 that ends well is 80 % equal."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        a = np.arange(400)
        eq = np.concatenate([rng.random(n) < share for n, share in zip(rng.integers(10, 90, 4), rng.permutation([1, 0.9, 0.1, 0.85]))])
        a = a[: len(eq)]
        b = np.where(eq, a, -1)
        first, last = int(eq.argmax()), len(eq) - int(eq[::-1].argmax())
        got = passages.judged([(first, first, last - first)], a, b)
        inside = np.zeros(len(eq), bool)
        for s, e, _, _, same in got:
            assert e - s >= 50 and same == eq[s:e].sum() >= 0.8 * (e - s)
            inside[s:e] = True
        for s in range(len(eq)):
            for e in range(s + 50, len(eq) + 1):
                if eq[s:e].all():
                    assert inside[s:e].all()
        if not got:
            total = np.concatenate([[0], np.cumsum(eq)])
            good = [(s, e) for s in range(len(eq)) for e in range(s + 50, len(eq) + 1) if total[e] - total[s] >= 0.8 * (e - s) and passages._trimmed(eq, s, e) == (s, e)]
            assert not good


def test_remove(spark, rows):
    df = frame(spark, rows)
    for c in ("cuts", "_cuts", "_id", "_tie", "_t", "start"):
        df = df.withColumn(c, F.lit("kept"))
    out = passages.remove(df)
    assert out.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert {500, 501, 502} & {i for i, _ in left} == set()  # nothing but the passage, which document 100 has first
    for _, own in covered([x for x in left if x[1]], spark).items():
        assert len(own) == 0
    assert passages.remove(df.where("false")).count() == 0


def test_cut():
    assert passages.cut("a b  c\nd e", [(1, 3)]) == "a d e"
    assert passages.cut("a b", [(0, 1), (1, 2)]) == "" and passages.cut(" a b ", [(0, 1)]) == " b "


def test_chains_by_brute_force():
    rng = random.Random(4)
    for _ in range(50):
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 9))})
        pts = [p for k, p in enumerate(pts) if k == 0 or p[0] != pts[k - 1][0]]

        def score(c):
            return passages.K * len(c) - passages.GAP * sum(x2 - x1 + y2 - y1 for (x1, y1), (x2, y2) in zip(c, c[1:]))

        best = max(score(c) for m in range(1, 1 << len(pts)) for c in [[p for k, p in enumerate(pts) if m >> k & 1]] if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:])))
        got = passages.chains(pts)
        assert score(got[0]) == pytest.approx(best) and sorted(p for c in got for p in c) == pts
