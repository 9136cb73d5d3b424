"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: frequency in the document times
1 + log(N / df) / log(N), where df counts all documents with the shingle, exactly (`recurrence`).
Samples (Ioffe, 2010) agree with the probability of weighted Jaccard similarity; bands of them give
buckets. Equal texts are one node. Within a bucket the samples of nodes of different classes are
compared, the most similar pairs verified on the whole texts, and so again with the pairs that are
left, until none could join two classes: a pair that fails is replaced by the next best. Components of
verified links are the classes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import recurrence, vectors
from .common import components, fresh, materialize, small, wide_rows

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 3
#: Samples, of 8 bits each, by which similarities of nodes that share a bucket are estimated.
SIGNS = 128
#: Entries of the table of random variates.
VARIATES = 1 << 16
#: Nodes compared at once. A larger bucket is dealt into parts of half as many, of which each two are compared.
BLOCK = 4096
#: Estimates below this aren't verified: at similarity 0.8, 3.7 standard deviations less.
LEAST_ESTIMATE = 86 / 128
#: Partners of each node besides those of the spanning forest in the first round; four times as many in each further one.
PARTNERS = 2
#: Keys up to which a key table is broadcast (16 bytes each and as much again); beyond it both sides are shuffled.
BROADCAST_KEYS = 500_000


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 2)).astype("f4")


def _shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, frequency in the text), in that order, each pair once."""
    return vectors.counted(*vectors.shingles(vectors.words(texts), WORDS))


def _frequencies(placed: DataFrame) -> tuple[recurrence.Counts, int]:
    """Documents of each shingle, and all documents."""
    n, size = placed.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    at = placed.columns.index("text")

    def hashes(b: pa.RecordBatch) -> np.ndarray:
        texts = b.column(at).to_pylist()
        return np.concatenate([_shingles(texts[i:j])[1] for i, j in vectors.batches(texts)])

    # words have some seven bytes
    return recurrence.counted(placed, hashes, (size or 0) // 7, "frequencies"), n


_variates: dict[int, tuple[np.ndarray, ...]] = {}


def variates(size: int = VARIATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and log c of Gamma(2, 1), beta uniform: drawn from a fixed seed, so alike in every task."""
    if size not in _variates:
        g = np.random.Generator(np.random.PCG64(20240101))
        _variates[size] = tuple(x.astype("f4") for x in (g.gamma(2, 1, size), np.log(g.gamma(2, 1, size)), g.random(size)))
    return _variates[size]


@lru_cache(maxsize=4)
def _ranks(log_w: np.float32) -> np.ndarray:
    """`_ranked` of each variate at this weight."""
    return _ranked(*variates(), log_w)


def _ranked(r: np.ndarray, c: np.ndarray, b: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """What is least of a text's shingles is its sample, as 64-bit integers in the same order whose lower half is 0."""
    a = (c - r * (np.floor(log_w / r + b) - b + 1) + np.float32(0)).view("i4")  # no -0, which isn't less than 0
    return (a ^ ((a >> 31) & 0x7FFFFFFF)).astype("i8") << 32


def samples(at: np.ndarray, h: np.ndarray, w: np.ndarray, texts: int, count: int = BANDS * ROWS) -> np.ndarray:
    """`count` samples of each text as 32-bit hashes of (shingle, t); zeros for a text without shingles. `at` ascends;
    ties go to a text's first shingle.

    Most shingles have one weight, as they occur once: what a variate makes of it is looked up, not worked out again."""
    out = np.zeros((texts, count), "u4")
    if not len(h):
        return out
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    variate, log_w = variates(), np.log(w).astype("f4")
    some, n = np.unique(log_w[:: max(1, len(h) >> 12)], return_counts=True)
    usual = some[n.argmax()]
    rank, rest = _ranks(usual), np.flatnonzero(log_w != usual)
    log_rest, row = log_w[rest], np.arange(len(h))
    multipliers = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, count, dtype="u8") * np.uint64(2) + np.uint64(1)
    least, k, own = np.empty((count, len(begin)), "i8"), np.empty(len(h), "u8"), np.empty(len(h), "i8")
    for j in range(count):
        np.right_shift(np.multiply(h, multipliers[j], out=k), np.uint64(48), out=k)
        np.take(rank, k.view("i8"), out=own, mode="clip")
        if len(rest):
            at_rest = k.view("i8")[rest]
            own[rest] = _ranked(*(v[at_rest] for v in variate), log_rest)
        np.minimum.reduceat(np.bitwise_or(own, row, out=own), begin, out=least[j])
    hit = least & 0xFFFFFFFF
    at_hit = ((h[hit] * multipliers[:, None]) >> np.uint64(48)).view("i8")
    t = np.floor(log_w[hit] / variate[0][at_hit] + variate[2][at_hit]).astype("i8").astype("u8")
    j = np.arange(count, dtype="u8")[:, None] << np.uint64(32)
    out[at[begin]] = (vectors.mix(h[hit] + (t + j) * np.uint64(vectors.STEP)) >> np.uint64(32)).astype("u4").T
    return out


def _sketches(placed: DataFrame, counts: recurrence.Counts, n: int) -> DataFrame:
    """(node, samples, df) of texts with words; `node` is the MD5 of the text, df the document frequencies of its
    distinct shingles in the order of their hashes."""

    def run(parts):
        for b in small(parts):
            nodes, texts, place = b.column(0), b.column(1).to_pylist(), b.column(2).to_numpy()
            for s, e in recurrence.runs_of(place):
                for i, j in vectors.batches(texts[s:e]):
                    i, j = i + s, j + s
                    at, h, tf = _shingles(texts[i:j])
                    if not len(at):
                        continue
                    df = counts.count(int(place[i]), h)
                    made = samples(at, h, tf.astype("f4") * idf(df, n), j - i)
                    ends = np.searchsorted(at, np.arange(j - i + 1))
                    some = np.flatnonzero(ends[1:] > ends[:-1])
                    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(some + i)), pa.array([made[k].tobytes() for k in some], pa.binary()), pa.array([recurrence.small_ints(df[ends[k] : ends[k + 1]]) for k in some], pa.binary())], names=["node", "samples", "df"])

    return placed.select("node", "text", "place").mapInArrow(run, "node binary, samples binary, df binary")


def _signs(texts: DataFrame, n: int) -> DataFrame:
    """(node, signs): SIGNS samples of a byte each, other ones than those of the bands."""

    def run(parts):
        for b in small(parts):
            nodes, texts, dfs = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in vectors.batches(texts):
                at, h, w = _weighted(list(zip(texts[i:j], dfs[i:j])), n)
                made = (samples(at, vectors.mix(h), w, j - i, SIGNS) >> np.uint32(24)).astype("u1")
                yield pa.RecordBatch.from_arrays([nodes.slice(i, j - i), pa.array([x.tobytes() for x in made], pa.binary())], names=["node", "signs"])

    return texts.select("node", "text", "df").mapInArrow(run, "node binary, signs binary")


def _buckets(sketches: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, node) of the bands that up to BLOCK nodes share, and (bucket, part, node) of larger ones, if there are
    any: parts of BLOCK nodes in the order of the samples. Of buckets with the same nodes there is one."""
    bands = [F.xxhash64(F.lit(i), F.substring("samples", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]
    rows = sketches.select("node", "samples", F.explode(F.array(*bands)).alias("bucket"))
    sizes = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("same")).where("n > 1"), "buckets")
    sizes = sizes.groupBy("n", "same").agg(F.min("bucket").alias("_bucket"))
    on = F.col("bucket") == F.col("_bucket")
    fit = rows.select("bucket", "node").join(sizes.where(F.col("n") <= BLOCK).select("_bucket"), on, "left_semi")
    large = sizes.where(F.col("n") > BLOCK).select("_bucket")
    if large.isEmpty():
        return fit, None
    large = rows.join(large if large.count() > BROADCAST_KEYS else F.broadcast(large), on, "left_semi")
    return fit, materialize(large.select("bucket", _part(BLOCK, "samples", "node"), "node"), "large")


def _part(size: int, *order: str) -> Column:
    """Number of each node's part of its bucket: `size` nodes each, in that order."""
    at = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return F.floor((at - 1) / size).alias("part")


def _tiles(large: DataFrame, classes_: DataFrame | None) -> DataFrame:
    """(bucket, node): of the larger buckets, each two parts that hold nodes of different classes, so every such pair of
    nodes meets. Nodes are dealt in the order of their classes: two parts of one class needn't meet."""
    rows = _classed(large.select("bucket", "node"), classes_)
    dealt = materialize(rows.select("bucket", _part(max(1, BLOCK // 2), "component", "node"), "node", "component"), "dealt")
    ends = dealt.groupBy("bucket", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    other = ends.select(F.col("bucket").alias("_bucket"), F.col("part").alias("other"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    both = ends.join(other, (F.col("bucket") == F.col("_bucket")) & (F.col("part") < F.col("other"))).where("least(low, _low) <> greatest(high, _high)")
    both = both.select(F.col("bucket").alias("_bucket"), F.xxhash64("bucket", "part", "other").alias("tile"), F.explode(F.array("part", "other")).alias("_part"))
    return dealt.join(both, (F.col("bucket") == F.col("_bucket")) & (F.col("part") == F.col("_part"))).select(F.col("tile").alias("bucket"), "node")


def _classed(rows: DataFrame, classes_: DataFrame | None) -> DataFrame:
    """(bucket, node, component)"""
    if classes_ is None:
        return rows.withColumn("component", F.col("node"))
    rows = rows.join(classes_.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left")
    return rows.select("bucket", "node", F.coalesce("component", "node").alias("component"))


def _pairs(m: np.ndarray, group: np.ndarray, failed: list[tuple[int, int]], partners: int, forest: bool) -> set[tuple[int, int]]:
    """Pairs of rows of different groups to verify: each row's best partners by estimate and, if asked for, a spanning forest."""
    n, least = len(m), int(np.ceil(LEAST_ESTIMATE * m.shape[1] - 1e-9))
    if n == 2:
        return {(0, 1)} if group[0] != group[1] and not failed and int((m[0] == m[1]).sum()) >= least else set()
    same = np.zeros((n, n), "u1")
    for j in range(m.shape[1]):
        same += m[:, None, j] == m[None, :, j]
    same[group[:, None] == group[None, :]] = 0
    for i, j in failed:
        same[i, j] = same[j, i] = 0
    out: set[tuple[int, int]] = set()
    k = min(partners, n - 1)
    for first in range(0, n, 256):
        best = np.argpartition(same[first : first + 256], n - k, axis=1)[:, n - k :]
        at = np.repeat(np.arange(first, first + len(best)), k)
        good = same[at, best.ravel()] >= least
        out.update((min(i, j), max(i, j)) for i, j in zip(at[good].tolist(), best.ravel()[good].tolist()))
    if forest:  # Prim's algorithm on estimates
        left, near, from_, i = np.ones(n, bool), np.full(n, -1, "i2"), np.zeros(n, "i8"), 0
        for _ in range(n - 1):
            left[i] = False
            near[i] = -2
            better = left & (same[i] > near)
            near[better], from_[better] = same[i][better], i
            i = int(np.argmax(np.where(left, near, -3)))
            if near[i] >= least:
                j = int(from_[i])
                out.add((min(i, j), max(i, j)))
    return out


def _candidates(buckets: DataFrame, signs: DataFrame, turn: int, classes_: DataFrame | None, failed: DataFrame | None) -> DataFrame:
    """Distinct (a, b) nodes to verify in a round: of different classes, not verified before."""
    rows = _classed(buckets, classes_)
    none = F.lit(None).cast("binary")
    if classes_ is not None:
        open_ = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("bucket").alias("_bucket"))
        rows = rows.join(open_, F.col("bucket") == F.col("_bucket"), "left_semi")
    rows = rows.join(signs.select(F.col("node").alias("_node"), "signs"), F.col("node") == F.col("_node")).drop("_node")
    if failed is None:
        rows = rows.withColumn("failed", F.array().cast("array<binary>"))
    else:
        own = failed.groupBy("a").agg(F.collect_list("b").alias("failed"))
        rows = rows.join(own, F.col("node") == F.col("a"), "left").drop("a")
    rows = rows.select("bucket", "signs", "node", F.when(F.col("component") != F.col("node"), F.col("component")).otherwise(none).alias("component"), "failed")

    def run(parts):
        a: list[bytes] = []
        b: list[bytes] = []

        def work(block):
            if len(block) < 2:
                return
            m = np.frombuffer(b"".join(r[0] for r in block), "u1").reshape(len(block), -1)
            at = {r[1]: i for i, r in enumerate(block)}
            names: dict[bytes, int] = {}
            group = np.array([names.setdefault(r[2] or r[1], len(names)) for r in block])
            tried = [(i, at[x]) for i, r in enumerate(block) for x in r[3] or () if x in at]
            for x, y in _pairs(m, group, tried, PARTNERS * 4**turn, turn == 0):
                x, y = block[x][1], block[y][1]
                a.append(min(x, y))
                b.append(max(x, y))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a.clear(), b.clear()
            return made

        key, block = None, []
        for p in small(parts):
            for k, *r in zip(*(c.to_pylist() for c in p.columns)):
                if k != key:
                    work(block)
                    block = []
                key = k
                block.append(r)
                if len(a) > 100_000:
                    yield batch()
        work(block)
        yield batch()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a binary, b binary").distinct()


def _weighted(side: list[tuple[str, bytes]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of (text, document frequencies)."""
    at, h, tf = _shingles([t for t, _ in side])
    ends = np.searchsorted(at, np.arange(len(side) + 1))
    df = [recurrence.ints(d, int(e - s)) for (_, d), s, e in zip(side, ends[:-1], ends[1:])]
    return at, h, tf.astype("f4") * idf(np.concatenate(df), n)


def similarities(left: list[tuple[str, bytes]], right: list[tuple[str, bytes]], n: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of (text, document frequencies); of two without words: 1."""

    at, h, w = (np.concatenate(x) for x in zip(_weighted(left, n), _weighted(right, n)))
    order = np.lexsort((h, at))
    at, h, w = at[order], h[order], w[order].astype("f8")
    twice = np.flatnonzero((h[1:] == h[:-1]) & (at[1:] == at[:-1]))
    both = np.bincount(at[twice], np.minimum(w[twice], w[twice + 1]), len(left))
    total = np.bincount(at, w, len(left))
    return np.where(total > 0, both / np.maximum(total - both, 1e-300), 1.0)


def _texts_of(placed: DataFrame, sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, df) of the distinct `nodes`, each once, written. Few nodes are broadcast, many shuffled."""
    if nodes.count() <= BROADCAST_KEYS:
        nodes = F.broadcast(nodes)
    found = placed.select("node", "text").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return materialize(found.join(sketches.select(F.col("node").alias("_node"), "df"), F.col("node") == F.col("_node")).drop("_node"), "texts")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    for name in ("a", "b"):
        own = texts.select(F.col("node").alias(f"_{name}"), F.struct("text", "df").alias(f"text_{name}"))
        pairs = pairs.join(own, F.col(name) == F.col(f"_{name}")).drop(f"_{name}")
    return pairs


def _verified(pairs: DataFrame, n: int) -> DataFrame:
    """(a, b, ok)"""

    def run(parts):
        for p in small(parts, 4 << 20):
            a, b = ([(x["text"], x["df"]) for x in p.column(c).to_pylist()] for c in (2, 3))
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(similarities(a, b, n) >= SIMILAR - 1e-6)], names=["a", "b", "ok"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, ok boolean")


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def links(placed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Verified pairs (a, b, ok) of nodes of a `placed` table (node, text), and the classes (node, component) of those linked."""
    spark = placed.sparkSession
    counts, n = _frequencies(placed)
    sketches = materialize(_sketches(placed, counts, n).dropDuplicates(["node"]), "sketches")
    fit, large = _buckets(sketches)
    members = fit if large is None else fit.union(large.select(F.xxhash64("bucket", "part").alias("bucket"), "node"))
    members = materialize(members, "members")
    texts = _texts_of(placed, sketches, members.select("node").distinct())
    signs = materialize(_signs(texts, n), "signs")
    found, parts = _rounds(members, signs, texts, n, None, None)
    if large is not None:
        found, parts = _rounds(materialize(_tiles(large, parts), "tiles"), signs, texts, n, found, parts)
    return spark.createDataFrame([], "a binary, b binary, ok boolean") if found is None else found, parts


def _rounds(buckets: DataFrame, signs: DataFrame, texts: DataFrame, n: int, found: DataFrame | None, parts: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified pairs and classes, after those of `buckets` were verified until none is left that could join two classes."""
    turn = 0
    while True:
        failed = None if found is None else found.where("not ok")
        pairs = materialize(_candidates(buckets, signs, turn, parts, failed), "pairs")
        if pairs.isEmpty():
            return found, parts
        with wide_rows(buckets.sparkSession):
            now = materialize(_verified(_with_texts(pairs, texts), n), "verified")
        found = now if found is None else found.union(now)
        new = now.where("ok").select("a", "b")
        if not new.isEmpty():
            parts = _joined(new, parts)
        turn += 1


def _joined(new: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The classes after new links between nodes of different ones."""
    if parts is None:
        return materialize(components(new), "parts")
    for side in ("a", "b"):
        own = parts.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        new = new.join(own, F.col(side) == F.col("_node"), "left").withColumn(side, F.coalesce("_component", side)).drop("_node", "_component")
    over = materialize(components(new), "over").select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    old = parts.join(over, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component"))
    return materialize(old.union(over.join(parts, F.col("_node") == F.col("node"), "left_anti").select(F.col("_node").alias("node"), F.col("_component").alias("component"))), "parts")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component, class_id, n_docs) of each distinct text: class_id is the least id of the class, n_docs its rows."""
    placed = recurrence.placed(nodes(docs, id_col, text_col), "placed")
    _, parts = links(placed)
    own = placed.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    if parts is None:
        own = own.withColumn("component", F.col("node"))
    else:
        parts = parts.withColumnRenamed("node", "_node")
        own = own.join(parts, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node")).drop("_node")
    every = own.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("rows").alias("n_docs"))
    return own.select("node", "component").join(every, "component").select("node", "component", "class_id", "n_docs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (the least id of its class) and n_docs (rows of the class).

    Null texts count as empty; texts without words are like each other only if equal. Ids may be null
    (a class of none but nulls has a null class_id) or repeat. Other columns are left out.
    """
    found = materialize(classes(docs, id_col, text_col), "classes").withColumnRenamed("node", "_node")
    src = nodes(docs, id_col, text_col).select("id", "node")
    return src.join(found, F.col("node") == F.col("_node")).select(F.col("id").alias(id_col), "class_id", "n_docs")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `docs`, one row of each class: the one of least id (of equal ids, the text of least MD5).

    A null id is the least only where a class has no other; of rows equal in id and text one stays. A null text
    counts as empty and stays null. An empty table gives no rows.
    """
    found = materialize(classes(docs, id_col, text_col), "classes")
    md5, id_, node = fresh(docs, "md5", "id", "node")
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = docs.withColumn(md5, F.unhex(F.md5(text.cast("binary"))))
    at = tagged.select(F.col(id_col).alias(id_), F.col(md5).alias(node)).join(found, F.col(node) == F.col("node")).where(F.col(id_).eqNullSafe(F.col("class_id")))
    first = materialize(at.groupBy("component").agg(F.min(node).alias(node), F.first("class_id").alias(id_)).select(id_, node), "first")
    if first.count() <= BROADCAST_KEYS:
        first = F.broadcast(first)
    kept = tagged.join(first, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(md5) == F.col(node)), "left_semi")
    # rows equal in id and text: one of them
    again = not tagged.groupBy(id_col, md5).count().where("count > 1").isEmpty()
    return (kept.dropDuplicates([id_col, md5]) if again else kept).select(*docs.columns)
