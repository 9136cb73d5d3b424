"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, fingerprints, language, neardup, packing, passages, quality, secrets, suffixes, warc
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return passages.report(table(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


def op5_minhash_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality.rules(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = language.fit(docs, "doc_id", "text", "lang")
    found = language.page_evidence(table(spark, sf_dir, "pages")).withColumnRenamed("doc_id", "page_doc")
    docs = docs.join(found, F.col("doc_id") == F.col("page_doc"), "left")
    return language.identify(docs, model, host=F.coalesce("address", "source"), declared=F.col("declared"), address=F.col("address"), carry=["doc_id"])


def queries():
    return {f.__name__: f for f in (op1_suffix_dedup, op2_best_fit_packing, op3_secret_scan, op4_warc, op5_minhash_near_duplicates, op6_quality_rules, op7_language_id, op8_fingerprints, op9_substring_dedup, op10_bpe)}


def oracle_sql():
    return {"op1_suffix_dedup": suffixes.SQL, "op4_warc": warc.SQL, "op6_quality_rules": quality.SQL}
