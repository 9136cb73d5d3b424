"""Language identification by Bayesian evidence fusion.

Text likelihoods (character trigrams, letters only) are combined with the declared markup language,
the address suffix and a prior for the host that is smoothed towards its domain and the whole corpus.
The trigram model is fitted on a bounded sample of labelled rows (`SAMPLE_ROWS`, `SAMPLE_CHARS`);
every count behind the other evidence is a grouped aggregation over all rows. Besides the sampled
languages there is the class `und`, of equally likely trigrams, which takes what is no language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType

from . import vectors
from .common import map_rows, materialize

#: Labelled rows of the sample, and characters used of each.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 5000
BUCKETS = 1 << 16
#: Characters whose trigrams are held at once, at some 40 bytes each; a longer text comes alone.
HELD = 1 << 20
#: Trigrams of one text depend on each other; their joint log likelihood counts this much.
TEMPER = 0.3
#: The class `und` spreads evenly over so many trigrams, and has this prior.
UND_TRIGRAMS, UND_PRIOR = 30**3, 0.01
#: Pseudo-counts of the parent at each level of the prior, and of any value of the other evidence.
SMOOTH = 20.0


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram that starts at a letter, all texts in a row, and how many each text has."""
    lower = [f" {(t or '').lower()} " for t in texts]
    joined = "".join(lower)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((c >= 97) & (c <= 122)) | ((c >= 192) & (c != 215) & (c != 247) & ~((c >= 0x2000) & (c < 0x2C00)))
    c = np.where(letter, c, 32)
    h = (c[:-2] * np.uint32(2654435761) ^ c[1:-1] * np.uint32(40503) ^ (c[2:] + np.uint32(7)) * np.uint32(2246822519)) >> np.uint32(16)
    use = letter[:-2] | letter[1:-1]
    ends = np.cumsum([len(t) for t in lower])
    use[np.minimum(np.concatenate([ends[:-1] - 1, ends[:-1] - 2]), len(use) - 1)] = False  # none reaches into the next text
    total = np.concatenate([[0], np.cumsum(use)])
    n = np.diff(np.concatenate([[0], total[np.minimum(ends, len(use))]]))
    return h[use], n


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language), from the `rows` labelled rows of least hash.

    Rows with a null label or text don't count; rows equal in id and text count once. A threshold on the hash, from a
    count of all labelled rows, lets about 5/4 of `rows` pass, and only those are sorted: what reaches the driver has one
    bound at every size. Without labelled rows there are no languages, and `identify` calls everything `und`.
    """
    at = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    at = at.select(F.col(label_col).alias("l"), F.substring(text_col, 1, chars).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    total = at.count()
    share = min(1.0, (1.25 * rows + 200) / max(total, 1))
    # hashes are spread evenly over 64 bits
    few = at.where(F.col("h") <= min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else F.lit(True))
    got = few.groupBy("h").agg(F.min(F.struct("t", "l")).alias("r")).orderBy("h").limit(rows).select("r.l", "r.t").collect()
    langs = sorted({r["l"] for r in got})
    table = np.empty((BUCKETS, len(langs)), "f4")
    for k, lang in enumerate(langs):
        h, _ = trigrams([r["t"] for r in got if r["l"] == lang])
        counts = np.bincount(h, minlength=BUCKETS) + 0.05
        table[:, k] = np.log(counts / counts.sum())
    return langs, table


def likelihoods(table: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text in each language and under `und` (last), and its trigrams."""
    out, every = np.zeros((len(texts), table.shape[1] + 1)), np.zeros(len(texts), "i8")
    for i, j in vectors.batches(texts, HELD):
        h, n = trigrams(texts[i:j])
        ends = np.cumsum(n)
        for k in range(table.shape[1]):
            s = np.concatenate([[0.0], np.cumsum(table[h, k], dtype="f8")])
            out[i:j, k] = s[ends] - s[ends - n]
        every[i:j] = n
    out[:, -1] = -np.log(UND_TRIGRAMS) * every
    return out, every


def _counts(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows of each text-only language as an array, by `keys`; combined on the map side."""
    each = [F.sum((F.col("guess") == k).cast("double")).alias(f"n{k}") for k in range(size)]
    return df.groupBy(*keys).agg(*each).select(*keys, F.array(*[f"n{k}" for k in range(size)]).alias("n"))


def _join(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return df.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])


def _smooth(n: str, parent: Column) -> Column:
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(F.col(n), parent, lambda x, p: (x + SMOOTH * p) / (total + SMOOTH))


def identify(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray],
    text_col: str = "text",
    host: Column | None = None,
    declared: Column | None = None,
    address: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns `carry` (all, if None) with language, posterior, text_language, n_trigrams and kept.

    `host`, `declared` (a language tag) and `address` (a host name, whose last label is the suffix) may
    be None or null: then that evidence is silent. Null and empty texts, and texts without letters, are
    `und` and not kept. Ties go to the language first in the alphabet. An empty table gives no rows; a model
    without languages makes every row `und`, with posterior 1.
    """
    langs, table = model
    size = len(langs)
    carry = list(docs.columns) if carry is None else carry
    none = F.lit(None).cast("string")
    inside = text_col in carry  # then the text travels once, in the row
    src = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        *([] if inside else [F.col(text_col).alias("text")]),
        (none if host is None else host).alias("host"),
        F.lower(F.regexp_extract(none if declared is None else declared, "^[A-Za-z]{2,3}", 0)).alias("declared"),
        F.lower(none if address is None else address).alias("address"),
    )
    src = src.withColumn("suffix", F.regexp_extract("address", r"\.([a-z]+)$", 1)).withColumn("domain", F.coalesce(F.nullif(F.regexp_extract("address", r"([^.]+\.[a-z]+)$", 1), F.lit("")), F.col("host")))
    names = ["row", *([] if inside else ["text"]), "host", "declared", "suffix", "domain"]
    schema = src.select(names).schema.add("ll", ArrayType(DoubleType())).add("n_trigrams", LongType()).add("guess", IntegerType())

    def run(batches):
        import pyarrow as pa

        from .common import small

        for b in small(batches):
            ll, n = likelihoods(table, (b.column(0).field(text_col) if inside else b.column(1)).to_pylist())
            guess = np.where(n > 0, ll.argmax(axis=1), size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(ll), pa.list_(pa.float64())), pa.array(n.astype("i8")), pa.array(guess.astype("i4"))], names=[*names, "ll", "n_trigrams", "guess"])

    base = src.select(names).mapInArrow(run, schema)
    base = materialize(base.drop("text"), "likelihoods")

    if not size:
        und = F.lit("und")
        return base.select("row.*", und.alias("language"), F.lit(1.0).alias("posterior"), und.alias("text_language"), "n_trigrams", F.lit(False).alias("kept"))
    seen = base.where(F.col("guess") < size)
    uniform = F.array(*[F.lit(1.0 / size)] * size)
    glob = _counts(seen, [], size).select(_smooth("n", uniform).alias("g"))
    domain = _counts(seen, ["domain"], size).crossJoin(F.broadcast(glob)).select("domain", _smooth("n", F.col("g")).alias("pd"))  # glob is one row
    hosts = _join(_counts(seen, ["domain", "host"], size), domain, ["domain"])
    hosts = hosts.select("domain", "host", _smooth("n", F.col("pd")).alias("prior"))

    def given(name: str) -> DataFrame:
        """log P(value | language) by value, smoothed towards P(value)."""
        got = _counts(seen.where(F.coalesce(F.col(name), F.lit("")) != ""), [name], size)
        every = got.agg(*[F.sum(F.col("n")[k]).alias(f"t{k}") for k in range(size)])
        share = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / sum((F.col(f"t{k}") for k in range(1, size)), F.col("t0"))
        each = [F.log((F.col("n")[k] + SMOOTH * share) / (F.col(f"t{k}") + SMOOTH)) for k in range(size)]
        return got.crossJoin(F.broadcast(every)).select(name, F.array(*each).alias(f"l_{name}"))  # every is one row

    out = _join(_join(_join(base, hosts, ["domain", "host"]), given("declared"), ["declared"]), given("suffix"), ["suffix"])
    zero = F.array(*[F.lit(0.0)] * size)
    prior = F.coalesce("prior", uniform)
    score = [F.log(prior[k] * (1 - UND_PRIOR)) + F.coalesce("l_declared", zero)[k] + F.coalesce("l_suffix", zero)[k] + TEMPER * F.col("ll")[k] for k in range(size)]
    # a language other than `und` explains the tags as well as the best one does, so that they never speak for `und`
    most = F.greatest(*[F.coalesce("l_declared", zero)[k] for k in range(size)]) if size > 1 else F.coalesce("l_declared", zero)[0]
    most2 = F.greatest(*[F.coalesce("l_suffix", zero)[k] for k in range(size)]) if size > 1 else F.coalesce("l_suffix", zero)[0]
    score.append(F.log(F.lit(UND_PRIOR)) + most + most2 + TEMPER * F.col("ll")[size])
    out = out.withColumn("s", F.array(*score)).withColumn("top", F.array_max("s"))
    best = F.when(F.col("n_trigrams") == 0, size + 1).otherwise(F.array_position("s", F.col("top")))
    posterior = F.when(F.col("n_trigrams") == 0, 1.0).otherwise(1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    tags = F.array(*[F.lit(x) for x in [*langs, "und"]])
    language = F.element_at(tags, best.cast("int"))
    return out.select("row.*", language.alias("language"), F.round(posterior, 6).alias("posterior"), F.element_at(tags, F.col("guess") + 1).alias("text_language"), "n_trigrams", (language != "und").alias("kept"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, address) of the pages whose address names a document; the last page wins."""
    at = pages.select(
        F.try_to_number(F.regexp_extract("url", r"/(\d{1,18})(?:[/?#]|$)", 1), F.lit("9" * 18)).cast("long").alias("doc_id"),
        "page_id",
        F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1).alias("address"),
    )
    return at.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("page_id", "declared", "address")).alias("p")).select("doc_id", "p.declared", "p.address")
