"""Encode, decode and measure files: python -m recordloom.cli encode|decode IN OUT [--stats] [--pretty] [--no-compress].

IN and OUT are paths that Spark reads. Encoding takes JSON lines, or with --document one JSON document a file; its
schema is stored beside the batches, so decoding needs none.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import packing
from .session import ship
from .sources import json as json_source


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="recordloom", description=__doc__)
    p.add_argument("action", choices=["encode", "decode"])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--document", action="store_true", help="one JSON document in each file")
    p.add_argument("--no-compress", action="store_true")
    p.add_argument("--pretty", action="store_true", help="decode to indented JSON")
    p.add_argument("--stats", action="store_true", help="print bytes as JSON, with gzip, and packed")
    a = p.parse_args(argv)
    spark = ship(SparkSession.builder.appName("recordloom").getOrCreate())
    if a.action == "encode":
        df = json_source.read_json(spark, a.source) if a.document else spark.read.option("mode", "FAILFAST").json(a.source)
        packing.pack(df, [], compress="none" if a.no_compress else "zlib").write.mode("overwrite").parquet(a.target)
        if a.stats:
            json_source.size_report(df, spark.read.parquet(a.target)).show(truncate=False)
        return
    packed = spark.read.parquet(a.source)
    first = packed.select("schema").first()
    if first is None:
        packed.select(F.lit("").alias("value")).write.mode("overwrite").text(a.target)
        return
    df = packing.unpack(packed, StructType.fromJson(json.loads(first.schema)))
    if a.pretty:
        json_source.pretty(df).write.mode("overwrite").text(a.target)
    else:
        json_source.write_lines(df, a.target, "overwrite")


if __name__ == "__main__":
    main()
