"""The pipeline on a few documents, each stage's decisions worked out by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from texts import prose

import corpus_pipeline as C
from tidemark.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(12)
    passage = prose(rng, 90)
    base = [prose(rng, 150) for _ in range(12)]
    rows = list(enumerate(base))
    rows += [(20, base[0]), (21, base[1] + " one more word")]  # an exact and a near copy
    rows += [(30, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"), (31, f"{prose(rng, 80)} {passage} {prose(rng, 80)}")]
    rows += [(40, prose(rng, 60) + " password = hunter22hunter " + prose(rng, 60))]
    rows += [(50, "12345 ### 6789"), (51, ""), (52, None)]
    return rows


def test_stages(spark, tmp_path, documents):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "documents.parquet")
    df.repartition(3).write.parquet(path)
    seen, docs = {}, spark.read.parquet(path)
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "secret_scan", "best_fit_packing"]
    for name, stage in C.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
    ids = {n: sorted(r["doc_id"] for r in d.collect()) for n, d in seen.items() if n != "best_fit_packing"}
    assert ids["language_id"] == sorted(i for i, _ in documents if i < 50)
    assert ids["near_duplicates"] == [i for i in ids["language_id"] if i not in (20, 21)]
    assert ids["substring_dedup"] == ids["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in seen["substring_dedup"].collect()}
    given = dict(documents)
    assert {i for i in texts if texts[i] != given[i]} == {31} and len(texts[31].split()) <= 165
    last = {r["doc_id"]: r for r in seen["secret_scan"].collect()}
    assert "[SECRET]" in last[40]["text"] and "hunter22" not in last[40]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in last.values())
    from tokenizers import Tokenizer

    from tidemark.llm.queries import vocabulary

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sizes = Counter()
    for r in seen["best_fit_packing"].collect():
        sizes[r["doc_id"]] += r["length"]
    assert sizes == Counter({i: len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in last.items()})
    assert not (left := [p for p in common._given if "tidemark" in p and p in sum(common._last_step.values(), [])]), left
    key = lambda d: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in d.collect())
    assert key(C.run(spark, str(tmp_path))) == key(seen["best_fit_packing"])


def test_stages_take_empty_and_awkward_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b c", None, "s", 5)]
    for k, data in enumerate(([], rows)):
        base = spark.createDataFrame(data, schema)
        for c in ("node", "found", "cuts", "row"):
            base = base.withColumn(c, F.lit("x"))
        base.write.parquet(str(tmp_path / f"{k}"))
        for name, stage in C.STAGES:
            out = stage(spark, spark.read.parquet(str(tmp_path / f"{k}")), str(tmp_path))
            assert out.columns == COLUMNS or name == "best_fit_packing"
            n = out.count()
            assert n == 0 if not data or name == "language_id" else n in (2, 4), name
