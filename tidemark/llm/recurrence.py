"""How often a hash occurs in the whole corpus, told to each part of it without moving its texts.

A table is read by places: what one task wrote, or so many rows of a file. A first pass takes
the hashes of each place, each once with its count, in order, as differences: a few bytes a hash. They meet
by ranges of the hash, whose number grows with the corpus, so that a range has one size; ranges send to
each place those of its hashes that occur more than once, with their counts. These lists are written by
place, and a later pass over the same table opens the list of the place that it reads. A hash held by
every text is one entry of each place, so no key is hot.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_dir, small

#: Hashes of a range, on average, and hashes of a place that are put in order at once.
RANGE, HELD = 1 << 20, 1 << 21
#: Rows of a place in a table that is left where it is.
PLACE_ROWS = 8192
#: Hashes are cut to so many bits more than it takes to number them all: one in 2**20 is taken for another.
SPARE_BITS = 20
#: Bits at most by which hashes of a place are first looked up.
MARK_BITS = 24


def placed(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back with `place`, the number of the task that wrote a row. It stands
    in the files, so it is the same at each reading, however they are split then."""
    return materialize(df.withColumn("place", F.spark_partition_id().cast("long")), name)


def in_place(df: DataFrame, name: str) -> DataFrame:
    """As `placed`, but a Parquet table read with nothing but projections and filters is left where it is: a place is
    then PLACE_ROWS rows of a file, by their number in it."""
    tree = df._jdf.queryExecution().optimizedPlan()
    while tree.children().size() == 1 and tree.nodeName() in ("Project", "Filter"):
        tree = tree.children().head()
    if tree.children().size() or not tree.nodeName().startswith("LogicalRelation") or "parquet" not in tree.toString().lower():
        return placed(df, name)
    return df.withColumn("place", F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / PLACE_ROWS)))


def packed(h: np.ndarray) -> bytes:
    """Ascending hashes as their first one, then differences in the fewest bytes that hold them all."""
    d = np.diff(h)
    kind = np.min_scalar_type(int(d.max())) if len(d) else np.dtype("u1")
    return struct.pack("<BQ", kind.itemsize, int(h[0])) + d.astype(kind).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    size, first = struct.unpack_from("<BQ", b)
    return np.cumsum(np.concatenate([np.array([first], "u8"), np.frombuffer(b, f"<u{size}", offset=9)]), dtype="u8")


def small_ints(n: np.ndarray) -> bytes:
    """Counts in the fewest bytes each; nothing at all if every one is 1."""
    most = int(n.max()) if len(n) else 1
    if most == 1:
        return b""
    kind = np.min_scalar_type(most)
    return bytes([kind.itemsize]) + n.astype(kind).tobytes()


def ints(b: bytes, length: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype("i8") if b else np.ones(length, "i8")


def runs_of(place: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with one place."""
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    yield from zip(at[:-1].tolist(), at[1:].tolist())


def lists(path: str, place: int, columns: list[str]) -> Iterator[tuple]:
    """Rows of the lists written for a place."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    for info in where.get_file_info(fs.FileSelector(f"{name}/place={place}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                yield from zip(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pq.ParquetFile(f).read(columns).columns))


@dataclass
class Counts:
    """The written lists: hashes that occur more than once, by place. Used in the workers."""

    path: str
    bits: int
    _place: int | None = None
    _held: tuple[np.ndarray, np.ndarray] | None = None
    #: By the low bits of a hash, whether any of those of the place has them: most hashes asked for are not among them.
    _marks: np.ndarray | None = None

    def __getstate__(self):
        return {"path": self.path, "bits": self.bits, "_place": None, "_held": None, "_marks": None}

    def of(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ascending and cut to `bits`; how often each occurs in the corpus) of a place's recurring hashes."""
        if self._place != place or self._held is None:
            h, n = [np.zeros(0, "u8")], [np.zeros(0, "i8")]
            for x, c in lists(self.path, place, ["hashes", "counts"]):
                h.append(unpacked(x.as_py()))
                n.append(ints(c.as_py(), len(h[-1])))
            h_, n_ = np.concatenate(h), np.concatenate(n)
            order = np.argsort(h_, kind="stable")
            self._place, self._held = place, (h_[order], n_[order])
            self._marks = np.zeros(1 << min(MARK_BITS, len(h_).bit_length() + 3), bool)
            self._marks[h_ & np.uint64(len(self._marks) - 1)] = True
        return self._held

    def count(self, place: int, h: np.ndarray) -> np.ndarray:
        """How often each of these hashes of a place occurs in the corpus."""
        known, n = self.of(place)
        if not len(known):
            return np.ones(len(h), "i8")
        cut = h >> np.uint64(64 - self.bits)
        out = np.ones(len(h), "i8")
        may = np.flatnonzero(self._marks[(cut & np.uint64(len(self._marks) - 1)).view("i8")])
        cut = cut[may]
        at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
        out[may] = np.where(known[at] == cut, n[at], 1)
        return out


def _sizes(expected: int) -> tuple[int, int]:
    """Bits that are used of each hash, and the logarithm of the number of ranges."""
    return min(64, max(32, max(1, expected).bit_length() + SPARE_BITS)), max(0, (max(1, expected) // RANGE).bit_length())


def _ranges(h: np.ndarray, bits: int, log_ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of ascending hashes."""
    cut = np.searchsorted(h >> np.uint64(bits - log_ranges), np.arange((1 << log_ranges) + 1, dtype="u8")) if log_ranges else np.array([0, len(h)])
    return ((k, i, j) for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if i < j)


def counted(table: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], expected: int, name: str) -> Counts:
    """Counts of `hashes(batch)`, one for each occurrence, over all rows of a `placed` table.

    `expected` is about how many there are; it sets sizes, not results. An empty table has no lists.
    """
    bits, log_ranges = _sizes(expected)
    column = table.columns.index("place")

    def first(parts):
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            rows = []
            for place, found in held.items():
                h, n = np.unique(np.concatenate(found) >> np.uint64(64 - bits), return_counts=True)
                rows += [(k, place, packed(h[i:j]), small_ints(n[i:j])) for k, i, j in _ranges(h, bits, log_ranges)]
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "place", "hashes", "counts"])

        for b in small(parts):
            for i, j in runs_of(b.column(column).to_numpy()):
                part = b.slice(i, j - i)
                found = hashes(part)
                held.setdefault(part.column(column)[0].as_py(), []).append(found)
                size += len(found)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    def second(parts):
        def work(rows):
            each = [unpacked(h) for _, h, _ in rows]
            owner = np.repeat(np.arange(len(each)), [len(h) for h in each])
            h, n = np.concatenate(each), np.concatenate([ints(c, len(x)) for (_, _, c), x in zip(rows, each)])
            order = np.argsort(h, kind="stable")
            h, n, owner = h[order], n[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(h))))
            at = np.flatnonzero(total > 1)
            at = at[np.argsort(owner[at], kind="stable")]
            h, total, owner = h[at], total[at], owner[at]
            out: dict[int, list] = {}
            for i, j in runs_of(owner) if len(owner) else ():
                out.setdefault(rows[owner[i]][0], []).append((h[i:j], total[i:j]))
            made = []
            for place, found in out.items():
                # of what a place sent in parts, each hash once
                x, k = np.unique(np.concatenate([f for f, _ in found]), return_index=True)
                made.append((place, packed(x), small_ints(np.concatenate([c for _, c in found])[k])))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.binary(), pa.binary()))], names=["place", "hashes", "counts"])

        key, rows = None, []
        for b in small(parts):
            for k, *r in zip(*(c.to_pylist() for c in b.columns)):
                if k != key and rows:
                    yield from work(rows)
                    rows = []
                key = k
                rows.append(r)
        if rows:
            yield from work(rows)

    sent = table.mapInArrow(first, "range long, place long, hashes binary, counts binary")
    found = sent.repartition("range").sortWithinPartitions("range").mapInArrow(second, "place long, hashes binary, counts binary")
    path = new_dir(table.sparkSession, name)
    found.repartition("place").write.partitionBy("place").option("compression", "zstd").parquet(path)
    return Counts(path, bits)


def ranks(ids: pa.Array) -> np.ndarray:
    """Integers in the order of `ids`, a null least. Within one array only, unless ids are integers."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(-(1 << 63) if ids.type == pa.int64() else np.iinfo(ids.type.to_pandas_dtype()).min).to_numpy(zero_copy_only=False).astype("i8")
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype("i8")


@dataclass
class Firsts:
    """The written lists of `firsts`. Used in the workers."""

    path: str
    bits: int
    near: bool = False

    def of(self, place: int) -> tuple | None:
        """(hashes, ascending and cut to `bits`; id, tie and position of the first occurrence, and with `near` its number)
        of a place's recurring hashes."""
        h, ids, rest = [], [], []
        for x, i, *r in lists(self.path, place, ["hashes", "ids", "ties", "pos", "near"][: 4 + self.near]):
            h.append(unpacked(x.as_py()))
            ids.append(i.values)
            rest.append([c.values.to_numpy() for c in r])
        if not h:
            return None
        h_ = np.concatenate(h)
        order = np.argsort(h_, kind="stable")
        return h_[order], pa.chunked_array(ids).combine_chunks().take(pa.array(order)), *(np.concatenate(c)[order] for c in zip(*rest))

    def cut(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)


def firsts(table: DataFrame, found: Callable[[pa.RecordBatch, int], tuple[np.ndarray, ...]], expected: int, name: str, near: bool = False) -> Firsts:
    """The first occurrence in the corpus of each hash that recurs, by (id, tie, position), told to each place that has it.

    `table` is `placed` and begins with the columns id and tie; `found(batch, place)` gives hash, row and position of
    each occurrence, and with `near` a 64-bit number, which is told with the first one. Each place sends one occurrence
    of a hash, its first.
    """
    bits, log_ranges = _sizes(expected)
    column = table.columns.index("place")
    kind = dict(table.dtypes)["id"]
    own = ["ids", "ties", "pos", "near"][: 3 + near]

    def batch(rows, first_names):
        """rows: (*ints, packed hashes, counts or none, ids, ties, pos, with `near` the numbers)"""
        if not rows:
            return
        ints_ = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(first_names))]
        sizes = np.cumsum([0, *(len(r[-1]) for r in rows)])
        offsets = pa.array(sizes, pa.int32())
        begin = len(rows[0]) - len(own)
        lists = [pa.ListArray.from_arrays(offsets, pa.chunked_array([r[begin] for r in rows]).combine_chunks()), *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[begin + i] for r in rows]).astype(t))) for i, t in zip(range(1, len(own)), ("i4", "i4", "i8")))]
        texts = [pa.array([r[i] for r in rows], pa.binary()) for i in range(len(first_names), begin)]
        yield pa.RecordBatch.from_arrays([*ints_, *texts, *lists], names=[*first_names, "hashes", *["counts"] * (len(texts) - 1), *own])

    def first(parts):
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush():
            rows = []
            for place, sent in held.items():
                h = np.concatenate([x[0] for x in sent]) >> np.uint64(64 - bits)
                pos = np.concatenate([x[2] for x in sent])
                base = np.cumsum([0, *(len(x[3]) for x in sent)])
                doc = np.concatenate([x[1] + k for x, k in zip(sent, base)])
                ids, ties = pa.chunked_array([x[3] for x in sent]).combine_chunks(), np.concatenate([x[4] for x in sent])
                more = [np.concatenate([x[5] for x in sent])] if near else []
                r = ranks(ids)
                by = np.lexsort((ties, r))
                rank = np.empty(len(by), "i8")
                # rows that repeat id and tie are one document
                rank[by] = np.cumsum(np.concatenate([[0], (r[by][1:] != r[by][:-1]) | (ties[by][1:] != ties[by][:-1])]))[: len(by)]
                order = np.lexsort((pos, rank[doc], h))
                h, pos, doc = h[order], pos[order], doc[order]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, "i8")
                n = np.diff(np.append(start, len(h)))
                h, pos, doc, more = h[start], pos[start], doc[start], [m[order][start] for m in more]
                rows += [(k, place, packed(h[i:j]), small_ints(n[i:j]), ids.take(pa.array(doc[i:j])), ties[doc[i:j]], pos[i:j], *(m[i:j] for m in more)) for k, i, j in _ranges(h, bits, log_ranges)]
            held.clear()
            yield from batch(rows, ["range", "place"])

        for b in small(parts):
            for i, j in runs_of(b.column(column).to_numpy()):
                part = b.slice(i, j - i)
                place = part.column(column)[0].as_py()
                h, doc, pos, *more = found(part, place)
                held.setdefault(place, []).append((h, doc, pos, part.column(0), part.column(1).to_numpy(), *more))
                size += len(h)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    def second(parts):
        def work(rows):
            each = [unpacked(r[1].as_py()) for r in rows]
            owner = np.repeat(np.arange(len(each)), [len(h) for h in each])
            h, n = np.concatenate(each), np.concatenate([ints(r[2].as_py(), len(x)) for r, x in zip(rows, each)])
            ids = pa.chunked_array([r[3].values for r in rows]).combine_chunks()
            ties, pos, *more = (np.concatenate([r[k].values.to_numpy() for r in rows]) for k in range(4, 3 + len(own)))
            order = np.lexsort((pos, ties, ranks(ids), h))
            h, n, owner = h[order], n[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(start, len(h)))
            again = np.repeat(np.add.reduceat(n, start), sizes) > 1
            best = np.repeat(order[start], sizes)
            at = np.flatnonzero(again)
            at = at[np.argsort(owner[at], kind="stable")]
            made = []
            for i, j in runs_of(owner[at]) if len(at) else ():
                k = at[i:j]
                # of what a place sent in parts, each hash once is enough
                made.append((rows[owner[k[0]]][0].as_py(), packed(h[k]), ids.take(pa.array(best[k])), ties[best[k]], pos[best[k]], *(m[best[k]] for m in more)))
            yield from batch(made, ["place"])

        key, rows = None, []
        for b in small(parts):
            for k, *r in zip(b.column(0).to_pylist(), *b.columns[1:]):
                if k != key and rows:
                    yield from work(rows)
                    rows = []
                key = k
                rows.append(r)
        if rows:
            yield from work(rows)

    lists = f"ids array<{kind}>, ties array<int>, pos array<int>" + ", near array<long>" * near
    sent = table.mapInArrow(first, f"range long, place long, hashes binary, counts binary, {lists}")
    told = sent.repartition("range").sortWithinPartitions("range").mapInArrow(second, f"place long, hashes binary, {lists}")
    path = new_dir(table.sparkSession, name)
    told.repartition("place").write.partitionBy("place").option("compression", "zstd").parquet(path)
    return Firsts(path, bits, near)
