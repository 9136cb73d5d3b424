"""Quality rules: repetition inside a document, and lines that many documents of a host share.

Lines are normalised (lower case, digits as 0, single spaces) and hashed; the distinct documents of
each (host, line) are counted over the whole table, lines above the limit are removed, and documents
left with too little are rejected. Only hashes and counts are shuffled, never text; counting combines
on the map side, so a host or line that holds a third of all rows costs one row a task.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

SYMBOLS = "#*$%&|<>"
DIGITS = re.compile(rb"[0-9]+")
#: A line in more documents of one host than this is boilerplate.
MAX_DOCS = 50
#: A document that keeps fewer words, or a smaller share of them, is depleted.
MIN_WORDS, MIN_SHARE = 10, 0.5

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 5-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, count, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            count += i + 5 - max(i, end)
            end = i + 5
    return count


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """The five statistics, then the hash and the words of each line that has a word."""
    raw = (text or "").encode()
    words = raw.split()
    chars = len(text or "") - (len(raw) - sum(map(len, words)))
    seen, dup, hashes, sizes = set(), 0, [], []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            norm = DIGITS.sub(b"0", b" ".join(own).decode().lower().encode())
            hashes.append(xxhash.xxh3_64_intdigest(norm) - (1 << 63))
            sizes.append(len(own))
    return len(words), chars, sum(map(raw.count, (s.encode() for s in SYMBOLS))), dup, repeat_words(words), hashes, sizes


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """Per row: id, the five statistics, base_failed, removed_words (in lines above the limit) and kept.

    Null text counts as empty and fails; a null host is a host of its own; ids may be null or repeat, as
    each row is a document; other columns are left out; an empty table gives no rows.
    """

    def fn(ids, hosts, texts):
        m = [measure(t) for t in texts]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line", "words")
        return {id_col: ids, "host": hosts} | {n: [r[i] for r in m] for i, n in enumerate(names)}

    kinds = dict(docs.dtypes)
    base = map_rows(docs, f"{id_col} {kinds[id_col]}, host {kinds[host_col]}, {STATS}, line array<long>, words array<int>", fn, [id_col, host_col, text_col])
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "lines")
    often = base.select("host", F.explode(F.array_distinct("line")).alias("line")).groupBy("host", "line").count().where(F.col("count") > max_docs)
    often = often.select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    lines = base.select("row", "host", F.explode(F.arrays_zip("line", "words")).alias("x")).select("row", "host", "x.line", "x.words")
    cut = lines.join(often, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line"))).groupBy("row").agg(F.sum("words").alias("removed_words"))
    out = base.drop("line", "words", "host").join(cut, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    kept = ~failed & (left >= MIN_WORDS) & (left >= MIN_SHARE * F.col("n_words"))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_words", kept.alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
v AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM v) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
l AS (SELECT r, source, j, ls[j] AS line, len(regexp_extract_all(ls[j], '[^\x20\x09-\x0D]+')) AS n,
        regexp_replace(lower(array_to_string(regexp_extract_all(ls[j], '[^\x20\x09-\x0D]+'), ' ')), '[0-9]+', '0', 'g') AS norm
      FROM (SELECT r, source, ls, unnest(range(1, len(ls) + 1)) AS j FROM (SELECT r, source, string_split(t, chr(10)) AS ls FROM w))),
ll AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ll GROUP BY r),
often AS (SELECT source, norm FROM ll GROUP BY source, norm HAVING count(DISTINCT r) > 50),
cut AS (SELECT r, sum(n) AS n FROM ll JOIN often ON ll.norm = often.norm AND ll.source IS NOT DISTINCT FROM often.source GROUP BY r),
a AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(cut.n, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, removed_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.5 * n_words AS kept
FROM a
"""
