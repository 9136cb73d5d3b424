"""Bottom-k sketches of shingle hashes, in DataFrame expressions only.

The sketch of a text is the k least distinct hashes of its shingles of five words (fewer words: one
shingle of them all; none: an empty sketch), ascending. Sketches merge by union. All hashes up to the
lesser of two full sketches' last ones are known of both sets, so resemblance and containment are
estimated from those; where neither sketch is full, they are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

K, WORDS = 128, 5
LAST = (1 << 63) - 1


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint>; null text counts as empty. Words are what white space parts."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return let(split, lambda w: sketch_words(w, k, words))


def sketch_words(split: Column, k: int = K, words: int = WORDS) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(split) - (words - 1)))
    hashes = F.when(F.size(split) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(F.slice(split, i, words))))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _limit(a: Column, k: int) -> Column:
    return F.when(F.size(a) >= k, F.element_at(a, -1)).otherwise(F.lit(LAST))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shingles in both among those in either; two empty sketches are alike (1)."""

    def share(top: Column) -> Column:
        both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= top))
        every = F.size(F.filter(F.array_union(a, b), lambda x: x <= top))
        return F.when(every == 0, F.lit(1.0)).otherwise(both / every)

    return let(F.least(_limit(a, k), _limit(b, k)), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; of an empty a: 1."""

    def share(top: Column) -> Column:
        both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= top))
        own = F.size(F.filter(a, lambda x: x <= top))
        return F.when(own == 0, F.lit(1.0)).otherwise(both / own)

    return let(F.least(_limit(a, k), _limit(b, k)), share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for sketches that aren't full."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each key. The k least are taken in salted parts first, so a hot key is no single task's."""
    rows = parts.select(*keys, F.explode(sketch_col).alias("h")).distinct().withColumn("_s", F.pmod("h", F.lit(salts)))
    for by in ([*keys, "_s"], keys):
        w = Window.partitionBy(*by).orderBy("h")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))


def text_of(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ",")


KEY = ["z", "k", "tie"]


def _next(keys: DataFrame) -> DataFrame:
    """For each distinct key the following one in that order, the first after the last, without one global sort task."""
    at = materialize(keys.distinct().repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "order")
    own = F.struct(*KEY)
    firsts = at.groupBy("part").agg(F.min(own).alias("first"))  # as many rows as there are partitions
    every = Window.orderBy("part")
    start = F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(every), start).alias("after"))
    lead = F.lead(own).over(Window.partitionBy("part").orderBy(*KEY))
    return at.withColumn("next", lead).join(firsts, "part").select(*KEY, "n", F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the start of the next document's, in the order of
    (id, hash of the text), nulls first. Rows equal in both count as one document and get the same result.
    A null text counts as empty. An only document is its own next. Other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    blank = F.lit("" if kind == "string" else 0).cast(kind)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # keys without nulls, so that joins and windows agree on one partitioning; nulls come first
    src = src.select(F.col("id").isNotNull().alias("z"), F.coalesce("id", blank).alias("k"), F.xxhash64("text").alias("tie"), "text")
    nexts = _next(src.select(*KEY, F.char_length("text").alias("n")))
    wants = nexts.select(*[F.col(f"next.{c}").alias(c) for c in KEY], *[F.col(c).alias(f"to_{c}") for c in KEY], F.floor(F.col("n") / 4).cast("int").alias("m"))
    # both joins read the texts by the same key, and all of it, so they are shuffled once
    gives = src.join(wants, KEY).select(*[F.col(f"to_{c}").alias(c) for c in KEY], F.expr("substring(text, 1, m)").alias("head"), sketch(F.col("text"), k).alias("next_sketch"))
    gives = gives.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("head"))).where("_n = 1").drop("_n")
    out = src.join(gives, KEY)
    out = out.select(
        F.when(F.col("z"), F.col("k")).alias("id"),
        F.char_length("text").alias("n_chars"),
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.col("head")).alias("edited"),
        sketch(F.col("text"), k).alias("a"),
        "next_sketch",
    ).withColumn("b", sketch(F.col("edited"), k))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        text_of(F.col("a")).alias("fingerprint"),
        text_of(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("next_sketch"), k).alias("near_next"),
    )
