"""A corpus pipeline: each stage works on all that its predecessor kept, and all but the last return the columns of documents.

toxicity drops documents that are judged toxic, near_duplicates keeps one document of each group of linked ones,
decontamination drops documents that hold passages of the benchmark, secrets replaces secrets in texts, and bpe encodes
and decodes what is left. Extra columns stay as they are, whatever their names; null texts and ids are kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, decontamination, jaccard_join, queries, secret_scan, toxicity
from recordloom.llm.common import bounded, free_name, map_steps, materialize, prepared, scratch_path, spread, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches 0.7. Without labelled rows nothing is dropped."""
    return toxicity.clean(spread(docs), toxicity.train(docs, table(prepared(spark), sf_dir, "labels")), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id (null only where all are), of each component of documents linked by Jaccard similarity."""
    prepared(spark)
    name = free_name("row_number", docs.columns)
    rows = jaccard_join.numbered(spread(docs), name)  # a number means the same row in all that follows
    joined = jaccard_join.join(rows, row_col=name)
    kept = joined.groupBy("component_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    gone = materialize(joined.join(kept, "row", "left_anti").select(F.col("row").alias(name)), "dropped")
    return rows.join(bounded(gone), name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return decontamination.clean(spread(docs), table(prepared(spark), sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text by [SECRET]; n_chars, where there is such a column, follows the text."""
    prepared(spark)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        clean = pa.array([secret_scan.redact(t) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([clean if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    out = map_steps(spread(docs), kernel, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    prepared(spark)
    return bpe.digest(bpe.round_trip(spread(docs), *queries.tokenizer_files()))


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", contaminated_documents),
    ("secrets", secrets),
    ("bpe", encode_and_decode),
]

#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
