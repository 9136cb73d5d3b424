"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Large items (over a third of the capacity) fit at most twice in a bin, so greedy matching of the
largest with the largest partner that fits is optimal for them; smaller items then go, longest
first, into the tightest gap that holds them. A length has at most `capacity` values, so the plan
is made on the driver from that many counts whatever the corpus, and pieces find their place by
their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .tokens import ByteEncoder, encoder

#: Pieces that one task of the ranking sorts, about.
ROWS_PER_RANK_TASK = 500_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(bins, lengths in each of them): every counted length is placed exactly once."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    gaps: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect_left(large, capacity - n + 1) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        if k < 0:
            gaps[capacity - n].append((left[n], (n,)))
            left[n] = 0
        elif large[k] == n:
            if left[n] > 1:
                gaps[capacity - 2 * n].append((left[n] // 2, (n, n)))
                left[n] %= 2
            else:
                left[n] = 0
                lower = next((m for m in reversed(large[:k]) if left[m]), None)
                if lower is None:
                    gaps[capacity - n].append((1, (n,)))
                else:
                    left[lower] -= 1
                    gaps[capacity - n - lower].append((1, (n, lower)))
        else:
            m = large[k]
            c = min(left[n], left[m])
            gaps[capacity - n - m].append((c, (n, m)))
            left[n] -= c
            left[m] -= c
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c, g = left[n], n
        while c:
            while g <= capacity and not gaps[g]:
                g += 1
            if g > capacity:
                each = capacity // n
                if c >= each:
                    gaps[capacity - each * n].append((c // each, (n,) * each))
                if c % each:
                    gaps[capacity - c % each * n].append((1, (n,) * (c % each)))
                break
            bins, items = gaps[g].pop()
            each = g // n
            full = min(bins, c // each)
            if full:
                gaps[g - each * n].append((full, items + (n,) * each))
                c -= full * each
                bins -= full
            if bins and 0 < c < each:
                gaps[g - c * n].append((1, items + (n,) * c))
                c = 0
                bins -= 1
            if bins:
                gaps[g].append((bins, items))
    return [x for part in gaps for x in part]


def intervals(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank, first sequence and offset of each run of places."""
    made: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for count, items in bins:
        at = 0
        for n in items:
            made.setdefault(n, []).append((rank.get(n, 0), sequence, at))
            rank[n] = rank.get(n, 0) + count
            at += n
        sequence += count
    return {n: tuple(np.array(x, "i8") for x in zip(*rows)) for n, rows in made.items()}


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized pieces of at most `capacity` ids: all but a document's first are full."""

    def fn(ids, texts):
        rows = []
        for key, b in zip(ids, encoder(ByteEncoder, path).encode(texts)):
            b += end_id.to_bytes(4, "little")
            n = len(b) // 4
            start, length = 0, (n - 1) % capacity + 1
            piece = 0
            while start < n:
                rows.append((key, piece, start, length, zlib.crc32(b[4 * start : 4 * (start + length)])))
                piece, start, length = piece + 1, start + length, capacity
        return dict(zip((id_col, "piece", "start", "length", "ids_crc32"), zip(*rows)))

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long", fn, [id_col, text_col])


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset. `pieces` has the id, piece and length; it is read several times,
    so it should be a written table. No rows give no rows; repeated rows are placed one by one."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    at = intervals(plan(counts, capacity))
    salts = max(1, sum(counts.values()) // ROWS_PER_RANK_TASK)
    df = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    df = df.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start", "ids_crc32")) - 1)
    sizes = pieces.groupBy("length", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).alias("_salt")).count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    df = df.join(sizes, ["length", "_salt"]) if salts > 1 else df.withColumn("_before", F.lit(0))
    df = df.withColumn("sequence_id", F.col("_rank") + F.col("_before")).withColumn("offset", F.lit(0).cast("long")).drop("_salt", "_rank", "_before")
    df = df.withColumn("sequence_id", F.col("sequence_id").cast("long"))
    names = df.columns
    li, si, oi = (names.index(x) for x in ("length", "sequence_id", "offset"))

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column(li).to_numpy(), b.column(si).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                m = length == n
                first, seq, off = at[int(n)]
                k = np.searchsorted(first, rank[m], "right") - 1
                sequence[m] = seq[k] + rank[m] - first[k]
                offset[m] = off[k]
            cols = list(b.columns)
            cols[si], cols[oi] = pa.array(sequence), pa.array(offset)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return df.mapInArrow(place, df.schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset. A null text counts as empty
    (its end id alone); ids may be null or repeat; other columns are left out; an empty table gives no rows."""
    return pack(materialize(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity, id_col).select(
        id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
