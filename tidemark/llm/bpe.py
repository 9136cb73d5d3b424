"""BPE encoding and decoding with one table of distinct words for the corpus.

Spark splits texts into words. Each place (a block of the table's files, see `recurrence`) sends its distinct
words once; they meet by ranges of their hash, where each distinct word of the corpus is encoded once, and
go back to the places that sent them with their ids. A place joins words to ids by hash in Arrow and so puts
the ids in order of position; no position is ever shuffled. Decoding joins ids to the vocabulary's
id-to-piece table, which has the size of the vocabulary whatever the corpus, in Arrow too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrence
from .common import map_rows, new_dir, small
from .tokens import WordTable, encoder

#: White space of any script; texts that hold names of special tokens or separators aren't split.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
WHOLE = r"<\||[\x1c-\x1f]"
#: Bytes of text for each range of words, and distinct words of a place that are held at once.
RANGE_BYTES, HELD = 32 << 20, 400_000


def _ints(n: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each that hold them all."""
    kind = np.min_scalar_type(int(n.max())) if len(n) else np.dtype("u1")
    return bytes([kind.itemsize]) + n.astype(kind).tobytes()


def _from_ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def _stored(words: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of words."""
    return _ints(pc.binary_length(words).to_numpy(zero_copy_only=False)), b"".join(w.as_buffer().to_pybytes() for w in words.cast(pa.binary()))


def _restored(lengths: bytes, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(_from_ints(lengths), dtype="i8")]).astype("<i8")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)).cast(pa.string())


def _range_of(words: list[str], ranges: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), "u8", len(words)) % np.uint64(ranges)


def _word_table(places: DataFrame, path: str, size: int) -> str:
    """The folder with the ids of each place's distinct words; from (id, words, place)."""
    ranges = 1 << max(0, (size // RANGE_BYTES).bit_length())

    def first(parts):
        held: list[pa.Array] = []
        place, count = None, 0

        def flush():
            words = pa.chunked_array(held).unique()
            held.clear()
            by = _range_of(words.to_pylist(), ranges)
            order = np.argsort(by, kind="stable")
            ends = np.searchsorted(by[order], np.arange(ranges + 1))
            rows = [(k, place, *_stored(words.take(pa.array(order[i:j])))) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if i < j]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "place", "lengths", "words"])

        for b in small(parts):
            for i, j in recurrence.runs_of(b.column(1).to_numpy()):
                part = b.slice(i, j - i)
                if held and (part.column(1)[0].as_py() != place or count > HELD):
                    yield from flush()
                    count = 0
                place = part.column(1)[0].as_py()
                held.append(part.column(0).flatten().unique())
                count += len(held[-1])
                if count > HELD and len(held) > 1:
                    held[:] = [pa.chunked_array(held).unique()]
                    count = len(held[0])
        if held:
            yield from flush()

    def second(parts):
        def work(rows):
            each = [_restored(r[1], r[2]) for r in rows]
            words = pa.chunked_array(each).unique()
            text = encoder(WordTable, path).text
            codes = [text(w) for w in words.to_pylist()]
            sizes = np.array([len(c) // 4 for c in codes], "i8")
            codes = np.array(codes, object)
            for (place, lengths, data), own in zip(rows, each):
                at = pc.index_in(own, words).to_numpy()
                yield place, lengths, data, _ints(sizes[at]), _ints(np.frombuffer(b"".join(codes[at]), "<u4"))

        def batch(made):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), *[pa.binary()] * 4))], names=["place", "lengths", "words", "counts", "ids"])

        key, rows = None, []
        for b in small(parts):
            for k, *r in zip(*(c.to_pylist() for c in b.columns)):
                if k != key and rows:
                    yield from (batch([x]) for x in work(rows))
                    rows = []
                key = k
                rows.append(r)
        if rows:
            yield from (batch([x]) for x in work(rows))

    sent = places.select("words", "place").mapInArrow(first, "range long, place long, lengths binary, words binary")
    told = sent.repartition("range").sortWithinPartitions("range").mapInArrow(second, "place long, lengths binary, words binary, counts binary, ids binary")
    at = new_dir(places.sparkSession, "words")
    told.repartition("place").write.partitionBy("place").option("compression", "zstd").parquet(at)
    return at


def _load(at: str, place: int) -> tuple[pa.Array, pa.ListArray]:
    """Distinct words of a place and their ids."""
    words, counts, ids = [pa.array([], pa.string())], [], []
    for lengths, data, n, codes in recurrence.lists(at, place, ["lengths", "words", "counts", "ids"]):
        words.append(_restored(lengths.as_py(), data.as_py()))
        counts.append(_from_ints(n.as_py()).astype("i4"))
        ids.append(_from_ints(codes.as_py()).astype("i4"))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype("i4")
    return pa.chunked_array(words).combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, "i4")))


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, made: Callable[[pa.Array, pa.ListArray], pa.RecordBatch]) -> DataFrame:
    """`made` takes ids of rows and lists of token ids, a batch at a time."""
    places = recurrence.in_place(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "texts")
    size = places.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = F.when(F.col("text").rlike(WHOLE), F.array("text")).otherwise(F.filter(F.split("text", SPACE), lambda w: w != ""))
    places = places.select("id", words.alias("words"), "place")
    at = _word_table(places, path, size)

    def run(parts):
        place, table, codes = None, None, None
        for b in small(parts):
            for i, j in recurrence.runs_of(b.column(2).to_numpy()):
                part = b.slice(i, j - i)
                if part.column(2)[0].as_py() != place:
                    place = part.column(2)[0].as_py()
                    table, codes = _load(at, place)
                own = part.column(1)
                flat = own.flatten()
                found = codes.take(pc.index_in(flat, table)) if len(flat) else codes.slice(0, 0)
                starts = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))])
                offsets = found.offsets.to_numpy()[starts] - (found.offsets[0].as_py() if len(found) else 0)
                yield made(part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), found.flatten()))

    return places.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array of int) for each row. Null and empty texts give no ids; ids may be null or repeat; an empty
    table gives no rows. Other columns are left out."""
    kind = dict(docs.dtypes)[id_col]
    return _encoded(docs, path, id_col, text_col, f"{id_col} {kind}, ids array<int>", lambda ids, lists: pa.RecordBatch.from_arrays([ids, lists], names=[id_col, "ids"]))


_pieces: dict[str, pa.Array] = {}


def pieces(path: str) -> pa.Array:
    """The id-to-piece table: as long as the vocabulary, whatever the corpus."""
    if path not in _pieces:
        t = encoder(WordTable, path).tokenizer
        _pieces[path] = pa.array([t.id_to_token(i) for i in range(t.get_vocab_size())], pa.string())
    return _pieces[path]


def decoded(lists: pa.ListArray, path: str) -> pa.Array:
    """The text of each list of ids, its pieces joined as the library's decode joins them; a null list is empty."""
    joined = pa.ListArray.from_arrays(lists.offsets, pieces(path).take(lists.values)) if not lists.null_count else pa.array([[pieces(path)[i].as_py() for i in x or ()] for x in lists.to_pylist()], pa.list_(pa.string()))
    return pc.binary_join(joined, " ")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) with the pieces of each row's ids, as the library's decode joins them. Null ids: empty text; an empty
    table gives no rows."""
    kind = dict(encoded.dtypes)[id_col]
    return map_rows(encoded, f"{id_col} {kind}, text string", lambda ids, lists: {id_col: ids, "text": decoded(pa.array(lists, pa.list_(pa.int32())), path).to_pylist()}, [id_col, ids_col])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, ids_sha256, decoded_sha256; ids and decoded text never leave the task.

    Null texts are empty: no tokens, digests of nothing. Rows that repeat each get their result, an empty table gives
    no rows. Other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]

    def made(ids, lists):
        raw, ends = lists.values.to_numpy().astype("<u4").tobytes(), 4 * lists.offsets.to_numpy()
        sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(ends[:-1], ends[1:])]
        text = [hashlib.sha256(t.as_buffer()).hexdigest() for t in decoded(lists, path).cast(pa.binary())]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends) // 4, pa.int64()), pa.array(sha), pa.array(text)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, path, id_col, text_col, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", made)
