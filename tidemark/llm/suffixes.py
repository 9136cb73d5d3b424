"""Suffix-array dedup of byte strings: removes later copies of strings of LENGTH bytes, keeps the first.

A suffix's longest previous factor reaches LENGTH bytes just if the previous or the next smaller
position in suffix order shares LENGTH bytes with it. One suffix array of all texts can't be held, so
suffixes are sorted in groups that hold every suffix with the same first LENGTH bytes: each window of
LENGTH bytes goes by the least hash of its GRAM-byte strings (its minimiser), and following windows with
one minimiser travel as one segment. Minimisers that occur once hold no repeats; which do not is counted
over the corpus and told to each block of the texts (`recurrence`), so the rest stays at home, and the
work grows with the corpus and no faster.

Exact copies of texts are found first. A task drops segments that it has sent before, which keeps hot
passages small; and windows of minimisers with more than HOT occurrences are not sorted but grouped by
their bytes, one by one, with map-side combining: the least place of a group is its first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrence, vectors
from .common import materialize, small

LENGTH, GRAM = 100, 32
#: A minimiser with more occurrences is hot. So many segments of at most 168 bytes are sorted at once.
HOT = 20_000
#: Bytes handled at once, and of the segments sorted at once.
CHUNK, SORTED = 900_000, 2 << 20
#: Sent segments that a task remembers.
REMEMBER = 300_000
#: Exact copies (40 bytes each) up to which they are broadcast; beyond that both sides are shuffled.
BROADCAST_COPIES = 400_000


# --- one text in memory -------------------------------------------------------------------------


def suffix_array(b: bytes) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    n = len(b)
    rank = np.frombuffer(b, "u1").astype("i8")
    order, k = np.argsort(rank, kind="stable"), 1
    while n > 1:
        second = np.full(n, -1, "i8")
        second[:-k] = rank[k:] if k < n else second[:-k]
        order = np.lexsort((second, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(n, "i8")
        rank[order] = np.cumsum(new) - 1
        if new.all() or k >= n:
            break
        k *= 2
    return order


def smaller(position: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next smaller value of each (-1: none), inside its group if groups are given.

    A candidate that isn't smaller hands over its own candidate: all between the two are larger.
    """

    def before(position, group):
        n = len(position)
        at = np.arange(n) - 1
        open_ = np.arange(n)
        while len(open_):
            to = at[open_]
            open_ = open_[to >= 0]
            to = to[to >= 0]
            if group is not None:
                other = group[to] != group[open_]
                at[open_[other]] = -1
                open_, to = open_[~other], to[~other]
            worse = position[to] > position[open_]
            open_ = open_[worse]
            at[open_] = at[to[worse]]
        return at

    last = len(position) - 1
    after = before(position[::-1], None if group is None else group[::-1])[::-1]
    return before(position, group), np.where(after < 0, -1, last - after)


def longest_previous_factors(b: bytes) -> np.ndarray:
    """For each position the longest string that starts there and at an earlier one."""
    order = suffix_array(b)
    before, after = smaller(order)

    def common(i: int, j: int) -> int:
        n = 0
        while i + n < len(b) and j + n < len(b) and b[i + n] == b[j + n]:
            n += 1
        return n

    out = np.zeros(len(b), "i8")
    for k, i in enumerate(order):
        out[i] = max([common(int(order[j]), int(i)) for j in (before[k], after[k]) if j >= 0], default=0)
    return out


# --- minimisers ---------------------------------------------------------------------------------


def segments(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each run of windows with one minimiser. `ends[i]` is where the text
    around byte i ends; windows that reach beyond it are none. At most 2**20 bytes."""
    n = len(b) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    power, inverse = vectors.powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum((b.astype("u8") + np.uint64(1)) * power[: len(b)], dtype="u8")])
    g = vectors.mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(total) - GRAM])
    key = (g & ~np.uint64((1 << 20) - 1)) | np.arange(len(g), dtype="u8")
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
    at = (key[:n] & np.uint64((1 << 20) - 1)).astype("i8")
    valid = np.arange(n) + LENGTH <= ends[:n]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (ends[1:n] != ends[: n - 1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [n]]))
    keep = valid[first]
    first, size = first[keep], size[keep]
    return g[at[first]], first, size


def chunks(raw: list[bytes]):
    """(bytes, ends, text of each byte's start, offset) of about CHUNK bytes: short texts together, a long one in
    parts that overlap so that each window is in one part."""
    group: list[int] = []
    size = 0
    for i, r in enumerate(raw):
        if len(r) < LENGTH:
            continue
        if size + len(r) > CHUNK and group:
            yield _joined(raw, group)
            group, size = [], 0
        if len(r) > CHUNK:
            for at in range(0, len(r) - LENGTH + 1, CHUNK):
                part = np.frombuffer(r, "u1")[at : at + CHUNK + LENGTH - 1]
                yield part, np.full(len(part), len(part)), np.array([0]), np.array([i]), np.array([at])
            continue
        group.append(i)
        size += len(r)
    if group:
        yield _joined(raw, group)


def _joined(raw: list[bytes], group: list[int]):
    sizes = np.array([len(raw[i]) for i in group])
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(raw[i] for i in group), "u1"), np.repeat(ends, sizes), ends - sizes, np.array(group), np.zeros(len(group), "i8")


# --- the corpus ---------------------------------------------------------------------------------


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.hash(text).alias("tie"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def _counts(placed: DataFrame) -> recurrence.Counts:
    """Occurrences of each minimiser, one for each of its segments."""
    size = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    column = placed.columns.index("text")

    def hashes(b: pa.RecordBatch) -> np.ndarray:
        found = [segments(c[0], c[1])[0] for c in chunks([t.encode() for t in b.column(column).to_pylist()])]
        return np.concatenate(found) if found else np.zeros(0, "u8")

    # a segment has some (LENGTH - GRAM) / 2 windows
    return recurrence.counted(placed, hashes, 2 * size // (LENGTH - GRAM), "minimisers")


def _sent(placed: DataFrame, counts: recurrence.Counts) -> DataFrame:
    """Rows (hash, id, tie, start, windows, bytes): segments to sort; without bytes, spans known already;
    with a negative count of windows, one window of a hot minimiser, by a hash of its own."""
    kind = dict(placed.dtypes)["id"]

    def run(parts):
        seen: dict[int, tuple] = {}
        for b in (p.slice(i, j - i) for p in small(parts) for i, j in recurrence.runs_of(p.column(3).to_numpy())):
            place = b.column(3)[0].as_py()
            ids, ties, raw = b.column(0).to_pylist(), b.column(1).to_pylist(), [t.encode() for t in b.column(2).to_pylist()]
            h_, row_, start_, windows_, bytes_ = [], [], [], [], []
            for c, ends, begin, texts, offset in chunks(raw):
                h, first, size = segments(c, ends)
                n_ = counts.count(place, h)
                ok = n_ > 1
                is_hot = n_[ok] > HOT
                h, first, size = h[ok], first[ok], size[ok]
                k = np.searchsorted(begin, first, "right") - 1
                text, start = texts[k], first - begin[k] + offset[k]
                data = c.tobytes()
                for hh, f, n, t, s, w in zip(h.view("i8").tolist(), first.tolist(), size.tolist(), text.tolist(), start.tolist(), is_hot.tolist()):
                    seg = data[f : f + n + LENGTH - 1]
                    mark = xxhash.xxh3_128_intdigest(seg)
                    own = (ids[t] is not None, ids[t] if ids[t] is not None else 0, ties[t], s)
                    other = seen.get(mark)
                    h_.append(hh)
                    row_.append(t)
                    start_.append(s)
                    if other is not None and other < own:
                        windows_.append(n)
                        bytes_.append(None)
                        continue
                    if len(seen) > REMEMBER:
                        seen.clear()
                    seen[mark] = own
                    if not w:
                        windows_.append(n)
                        bytes_.append(seg)
                        continue
                    h_.pop(), row_.pop(), start_.pop()
                    for j in range(n):
                        string = seg[j : j + LENGTH]
                        h_.append(int.from_bytes(xxhash.xxh3_64_digest(string), "big", signed=True))
                        row_.append(t)
                        start_.append(s + j)
                        windows_.append(-1)
                        bytes_.append(string)
            if h_:
                rows = pa.array(row_, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h_, pa.int64()), b.column(0).take(rows), b.column(1).take(rows), pa.array(start_, pa.int32()), pa.array(windows_, pa.int32()), pa.array(bytes_, pa.binary())], names=["hash", "id", "tie", "start", "windows", "bytes"])

    return placed.select("id", "tie", "text", "place").mapInArrow(run, f"hash long, id {kind}, tie int, start int, windows int, bytes binary")


def repeated(group: np.ndarray, segs: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of the windows whose longest previous factor reaches LENGTH.

    Segments come in the order of their places in the corpus, groups in a row. Suffixes alone with the
    hash of their first LENGTH bytes can have no such factor and aren't sorted.
    """
    b = np.frombuffer(b"".join(segs), "u1")
    lengths = sizes + LENGTH - 1
    at = np.cumsum(lengths) - lengths
    seg = np.repeat(np.arange(len(segs)), sizes)
    window = np.arange(len(seg)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pos = at[seg] + window
    power, inverse = vectors.powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum((b.astype("u8") + np.uint64(1)) * power[: len(b)], dtype="u8")])
    h = vectors.mix((total[pos + LENGTH] - total[pos]) * inverse[pos]) ^ vectors.mix(group[seg].astype("u8"))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    i = np.flatnonzero(twice)
    if not len(i):
        return i, i
    # suffix order by the first LENGTH bytes, then by place, as the index grows with the place
    padded = np.concatenate([b, np.zeros(8, "u1")])
    view = np.ndarray((len(b),), ">u8", padded.tobytes(), strides=(1,))
    offsets = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    keys = [view[pos[i] + o].astype("u8") for o in offsets]
    order = np.lexsort((*reversed(keys), group[seg[i]]))
    differs = group[seg[i]][order][1:] != group[seg[i]][order][:-1]
    for key in keys:
        k = key[order]
        differs |= k[1:] != k[:-1]
    # the longest previous factor reaches LENGTH where the previous or the next smaller position is in the same run of
    # suffixes that share LENGTH bytes
    place = i[order]
    before, after = smaller(place, np.concatenate([[0], np.cumsum(differs)]))
    later = place[(before >= 0) | (after >= 0)]
    return seg[later], window[later]


def _sorted(sent: DataFrame) -> DataFrame:
    """Spans (id, tie, start, end) of the sent segments."""
    kind = dict(sent.dtypes)["id"]

    def run(parts):
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def work(t: pa.Table):
            t = t.combine_chunks()
            known = t.column("bytes").is_null().to_numpy(zero_copy_only=False)
            start, n = t.column("start").to_numpy(), t.column("windows").to_numpy()
            rows, begins, ends = [np.flatnonzero(known)], [start[known]], [start[known] + n[known] + LENGTH - 1]
            # rows that repeat id and text send each segment again, next to the first
            codes = t.column("id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            h, tie = t.column("hash").to_numpy(), t.column("tie").to_numpy()
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (codes[1:] == codes[:-1]) & (tie[1:] == tie[:-1]) & (start[1:] == start[:-1])
            at = np.flatnonzero(~known & ~again)
            if len(at):
                h = h[at]
                g = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
                alone = np.bincount(g)[g] == 1
                only = alone & (n[at] < 2)  # a segment of one window, alone in its group
                at, g = at[~only], g[~only]
                if len(at):
                    seg, window = repeated(g, t.column("bytes").take(pa.array(at)).to_pylist(), n[at].astype("i8"))
                    o = np.lexsort((window, seg))
                    seg, window = seg[o], window[o]
                    if len(seg):
                        new = np.ones(len(seg), bool)
                        new[1:] = (seg[1:] != seg[:-1]) | (window[1:] != window[:-1] + 1)
                        f = np.flatnonzero(new)
                        e = np.concatenate([f[1:], [len(seg)]]) - 1
                        rows.append(at[seg[f]])
                        begins.append(start[at[seg[f]]] + window[f])
                        ends.append(start[at[seg[f]]] + window[e] + LENGTH)
            rows_ = pa.array(np.concatenate(rows))
            made = [t.column("id").take(rows_), t.column("tie").take(rows_), pa.array(np.concatenate(begins).astype("i4")), pa.array(np.concatenate(ends).astype("i4"))]
            yield from pa.table(made, names=["id", "tie", "start", "end"]).to_batches()

        for b in small(parts, SORTED):
            h = b.column(0).to_numpy()
            if held and size > SORTED:
                # the groups before the last one are whole
                t = pa.Table.from_batches([*held, b])
                h = t.column("hash").to_numpy()
                cut = int(np.searchsorted(h, h[-1], "left")) if h[0] != h[-1] else 0
                if cut:
                    yield from work(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
                    continue
            held.append(b)
            size += b.nbytes
        if held:
            yield from work(pa.Table.from_batches(held))

    rows = sent.repartition("hash").sortWithinPartitions("hash", "id", "tie", "start")
    return rows.mapInArrow(run, f"id {kind}, tie int, start int, end int")


def spans(firsts: DataFrame) -> DataFrame:
    """(id, tie, start, end): bytes of each text that a string of LENGTH bytes covers which starts earlier too."""
    placed = recurrence.placed(firsts.select("id", "tie", "text"), "firsts")
    sent = materialize(_sent(placed, _counts(placed)), "sent")
    window = sent.where("windows < 0")
    first = window.groupBy("hash", "bytes").agg(F.min(F.struct("id", "tie", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").select("hash", "bytes", "f")
    same = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("tie") == F.col("f.tie")) & (F.col("start") == F.col("f.start"))
    return _sorted(sent.where("windows > 0")).union(window.join(first, ["hash", "bytes"]).where(~same).select("id", "tie", "start", (F.col("start") + LENGTH).alias("end")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes left.

    Earlier means a smaller id, or an earlier start in the same document; a null id is the least, and of rows
    that repeat an id the text of least hash comes first. Rows equal in id and text are one document and get
    the same result. Null texts are empty. Other columns are left out; an empty table gives no rows.
    """
    src = _source(docs, id_col, text_col)
    copies = materialize(src.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.count("id").alias("ids")).where("n > 1"), "copies")
    copies = copies.select(F.col("node").alias("_node"), F.when(F.col("ids") == F.col("n"), F.col("first")).alias("first"))
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    marked = src.join(copies, F.col("node") == F.col("_node"), "left")
    marked = marked.select("id", "tie", "text", (F.col("_node").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("copy"))
    firsts = marked.where(~F.col("copy"))
    cuts = spans(firsts).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    cuts = materialize(cuts.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "cuts"), "cuts")
    out = marked.join(cuts, ~F.col("copy") & F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    kind = dict(src.dtypes)["id"]
    schema = f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(parts):
        for b in small(parts):
            rows = []
            for text, copy, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                raw = text.encode()
                merged: list[list[int]] = []
                if copy and len(raw) >= LENGTH:
                    merged = [[0, len(raw)]]
                for s, e in sorted((x["start"], x["end"]) for x in own or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                left, at = [], 0
                for s, e in merged:
                    left.append(raw[at:s])
                    at = e
                left.append(raw[at:])
                kept = b"".join(left)
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows))[: 5 if keep_text else 4]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=[x.split()[0] for x in schema.split(", ")])

    return out.select("id", "text", "copy", "cuts").mapInArrow(run, schema)


#: Strings are compared as hexadecimal; for tables without repeated ids.
SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM h WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS e FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pe FROM s),
k AS (SELECT doc_id, string_agg(substr(h, 2 * pe + 1, 2 * (a - pe)), '' ORDER BY a) AS head, max(e) AS le, count(*) AS n, sum(e - a) AS removed FROM c JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, (length(h.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h.h ELSE head || substr(h.h, 2 * le + 1) END)) AS kept_sha256
FROM h LEFT JOIN k ON h.doc_id = k.doc_id
"""
