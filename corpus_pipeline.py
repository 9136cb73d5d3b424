"""From documents to packed training sequences: language, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's documents. All but the last return the columns of `documents`; further columns, whatever
their names, are left out. A stage deletes what the one before left in the shared folder, as that one's result is
written by then. Every stage takes an empty table, which gives no rows. Ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, neardup, packing, passages, secrets
from tidemark.llm.common import materialize, step, table
from tidemark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages; others (`und`) go.

    Null and empty texts and texts without letters are `und`. A null label or source is no evidence; in a table
    without labels nothing can be told to be in a language, so all rows go. Repeated rows are decided alike.
    """
    with step(spark, docs):
        docs = docs.select(*COLUMNS)
        model = language.fit(docs, "doc_id", "text", "lang")
        return language.identify(docs, model, host=F.col("source")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of least id; null texts are empty, and all empty ones are one class."""
    with step(spark, docs):
        return neardup.keep_one(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are cut out, in other documents or in the same one; documents of nothing else go.
    Null and empty texts stay as they are."""
    with step(spark, docs):
        return _measured(passages.remove(docs.select(*COLUMNS)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes. Null texts stay null, with a null n_chars."""
    with step(spark, docs):
        return _measured(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; a null text is its end id alone."""
    with step(spark, docs, last=True):
        return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack),
]

#: Models, sampling and tokenizers aren't SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
