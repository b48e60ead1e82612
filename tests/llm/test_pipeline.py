"""The stages of the pipeline, each against what it promises."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice(["ba", "ne", "ti", "ro", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item = words(14)
    texts = [words(rng.randint(20, 90)) for _ in range(160)] + [" ".join(x for w in words(50).split() for x in ([w, "nitwit"] if rng.random() < 0.15 else [w])) for _ in range(90)]
    texts += [texts[3], texts[3] + " tail", f"{words(5)} {item.upper()} {words(5)}", 'token = "abcdef0123456789abcdef01"', None, "", texts[5]]
    docs = spark.createDataFrame([(i if i != 200 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(160 <= i < 250)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_stages(spark, tables):
    path, texts = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["toxicity"](spark, docs, path)
    assert kept.columns == COLUMNS
    left = [r.text for r in kept.collect()]
    assert sum("nitwit" in (t or "") for t in left) <= 9
    assert sum("nitwit" not in (t or "") for t in left) >= sum("nitwit" not in (t or "") for t in texts) - 3

    kept = stage["near_duplicates"](spark, docs, path)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert {3, 5} <= ids and not ids & {250, 251, 256} and {254, 255} <= ids
    assert kept.count() == len(texts) - 3

    kept = stage["decontamination"](spark, docs, path)
    assert kept.columns == COLUMNS and kept.count() == len(texts) - 1 and kept.where("doc_id = 252").count() == 0

    kept = stage["secrets"](spark, docs, path)
    assert kept.columns == COLUMNS and kept.count() == len(texts)
    r = kept.where("doc_id = 253").first()
    assert r.text == "[SECRET]" or "abcdef0123456789" not in r.text
    assert r.n_chars == len(r.text) and kept.where("text is null").count() == 1

    assert stage["bpe"](spark, docs, path).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_extra_columns_and_empty_tables(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(30).withColumn("row_number", F.lit(1)).withColumn("row", F.lit("x")).withColumn("a b", F.lit(2))
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, path).columns == docs.columns, name
        assert f(spark, docs.limit(0), path).count() == 0, name


def test_run(spark, tables):
    path, texts = tables
    out = corpus_pipeline.run(spark, path)
    assert 0 < out.count() < len(texts) - 4 and corpus_pipeline.ORACLE_SQL is None
