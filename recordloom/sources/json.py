"""JSON in and out: whole files, lines with three ways to treat bad ones, and the size report."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """One JSON document (a record or a list of records) in each file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_lines(spark: SparkSession, path: str, schema: StructType, mode: str = "FAILFAST") -> DataFrame:
    """A record on each line; blank lines are passed over. mode: FAILFAST, DROPMALFORMED or PERMISSIVE."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def well_formed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that hold JSON."""
    return lines.where((F.trim(F.col(column)) != "") & F.try_parse_json(column).isNotNull())


def write_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def pretty(df: DataFrame) -> DataFrame:
    """Each record as indented JSON without its nulls."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def size_report(df: DataFrame, packed: DataFrame) -> DataFrame:
    """Bytes of the records as JSON, of these with gzip, and of the packed batches, and the ratios."""
    lines = df.select(F.to_json(F.struct("*")).alias("j"))

    def zipped(batches):
        for b in batches:
            raw = "\n".join(b.column("j").to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array([len(raw)]), pa.array([len(gzip.compress(raw, 6))])], names=["json", "gzip"])

    a = lines.mapInArrow(zipped, "json long, gzip long").select("json", "gzip", F.lit(0).cast("long").alias("packed"))
    b = packed.select(F.lit(0).cast("long").alias("json"), F.lit(0).cast("long").alias("gzip"), F.length("payload").cast("long").alias("packed"))
    sums = a.unionAll(b).agg(*(F.sum(c).alias(f"{c}_bytes") for c in ("json", "gzip", "packed")))
    return sums.withColumn("gzip_ratio", F.col("json_bytes") / F.col("gzip_bytes")).withColumn("packed_ratio", F.col("json_bytes") / F.col("packed_bytes"))
