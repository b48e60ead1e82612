"""Column profiles and the choice of an encoding, as aggregates with partial sums on the map side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import bits


def profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per group and column: n, n_valid, has_nulls, all_null, constant, numeric, least and most (as text).

    One scan and one aggregate for all columns; the long form comes from stack() afterwards.
    """
    kinds = dict(df.dtypes)
    aggs, parts = [F.count(F.lit(1)).alias("n")], []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__v"), F.min(c).cast("string").alias(f"{c}__lo"), F.max(c).cast("string").alias(f"{c}__hi"), (F.min(c) == F.max(c)).alias(f"{c}__one")]
        numeric = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        parts.append(f"'{c}', `{c}__v`, `{c}__lo`, `{c}__hi`, `{c}__one`, {str(numeric).lower()}")
    wide = df.groupBy(*keys).agg(*aggs)
    long = wide.selectExpr(*(f"`{k}`" for k in keys), "n", f"stack({len(parts)}, {', '.join(parts)}) as (column_name, n_valid, least, most, one, numeric)")
    return long.select(*keys, "column_name", "n", "n_valid", (F.col("n_valid") < F.col("n")).alias("has_nulls"), (F.col("n_valid") == 0).alias("all_null"), ((F.col("n_valid") == F.col("n")) & F.coalesce("one", F.lit(False))).alias("constant"), "numeric", "least", "most")


def most_frequent(df: DataFrame, value: str, keys: Sequence[str], share: tuple[int, int] = (6, 10), least: int = 8) -> DataFrame:
    """Per group of at least `least` non-null values, the value that makes up at least that share of them, with its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("uses"))
    total = Window.partitionBy(*keys)
    return counts.withColumn("n", F.sum("uses").over(total)).where((F.col("n") >= least) & (F.col("uses") * share[1] >= F.col("n") * share[0]))


def exceptions(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the groups that have a most frequent value, and do not hold it: keys, at (place in the group), value."""
    top = most_frequent(df, value, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_top"))
    rows = df.where(F.col(value).isNotNull()).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(top, cond).where(F.col(value) != F.col("_top")).select(*keys, "at", F.col(value).alias("value"))


def bitmap_bytes(df: DataFrame, valid: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Validity bitmaps, least bit first, one row for each byte: keys, byte_at, byte. One shuffle for place and sum."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.select(*keys, valid.alias("valid"), at.alias("at"))
    bit = F.when(F.col("valid"), F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).otherwise(0)
    return rows.groupBy(*keys, F.floor(F.col("at") / 8).alias("byte_at")).agg(F.sum(bit).alias("byte"))


def bitmap_hex(df: DataFrame, valid: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole bitmaps as hex. A group's bitmap has an eighth of a byte for each row; groups are batches of bounded size."""
    by = bitmap_bytes(df, valid, keys, order)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("byte_at", "byte"))), lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")
    return by.groupBy(*keys).agg(joined.alias("bitmap"))


def is_set(bitmap: Column, at: Column) -> Column:
    """Bit of a bitmap in hex."""
    byte = F.conv(F.substring(bitmap, (F.floor(at / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def nibbles(df: DataFrame, d: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Small deltas two to a byte, the first in the high half, as hex; an odd tail has a zero low half."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.select(*keys, (F.col(d) + 8).alias("half"), at.alias("at"))
    byte = rows.groupBy(*keys, F.floor(F.col("at") / 2).alias("i")).agg(F.sum(F.col("half") * F.when(F.col("at") % 2 == 0, 16).otherwise(1)).alias("b"))
    return byte.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda x: F.lpad(F.hex(x["b"]), 2, "0")), "").alias("packed"))


def long_form(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, at (place in the group), column_name, v: columns of integers under each other, from one scan, shuffle and sort.

    What is grouped by keys and column_name afterwards stays where it is.
    """
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.select(*keys, at.alias("at"), *(F.col(c).cast("long").alias(f"_{c}") for c in columns))
    return rows.selectExpr(*(f"`{k}`" for k in keys), "at", f"stack({len(columns)}, {', '.join(f"'{c}', `_{c}`" for c in columns)}) as (column_name, v)")


def costs(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per sequence all that a choice of encoding needs.

    n (deltas), all_small, top (largest |delta|), bitpack_bytes, rle_bytes, rice_k, rice_bytes, token_bytes, codec. Deltas
    are bit-packed if all are small and runs are not clearly shorter, else Rice-coded if at least ten are below 1024 and
    take under 1.5 bytes each, else written as tokens with runs of zeros.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, (F.col(value) - F.lag(value).over(w)).cast("long").alias("d")).where("d is not null")
    rows = rows.withColumn("u", bits.zigzag(F.col("d")))
    zero = F.col("d") == 0
    change = F.when(zero & F.coalesce(F.lag("d").over(w) == 0, F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("c", change).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    by_run = rows.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("len"), F.first(F.col("d") == 0).alias("zero"), F.max(F.abs("d")).alias("top"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum(bits.delta_bytes(F.col("d"))).alias("tokens"), *(F.sum(F.call_function("shiftrightunsigned", F.col("u"), F.lit(k))).alias(f"q{k}") for k in range(8)))
    long_run = F.col("zero") & (F.col("len") > 3)
    sums = by_run.groupBy(*keys).agg(
        F.sum("len").alias("n"), ((F.min("lo") >= -8) & (F.max("hi") <= 7)).alias("all_small"), F.max("top").alias("top"),
        F.sum(F.when(long_run, 2 + (F.col("len") > 127).cast("int")).when(F.col("zero"), F.col("len")).otherwise(1)).alias("rle_bytes"),
        F.sum(F.when(long_run, 1 + bits.varint_length(F.col("len"))).otherwise(F.col("tokens"))).alias("token_bytes"), *(F.sum(f"q{k}").alias(f"q{k}") for k in range(8)),
    )
    sums = sums.withColumn("bitpack_bytes", F.floor(F.col("n") / 2) + 5).withColumn("rice_k", bits.rice_parameter(F.col("top")))
    # Quotients were summed for every k at once, so the deltas are looked at once.
    quotients = F.element_at(F.array(*(F.col(f"q{k}") for k in range(8))), F.col("rice_k") + 1)
    out = sums.withColumn("rice_bytes", F.ceil((quotients + F.col("n") * (1 + F.col("rice_k"))) / 8) + 1)
    codec = F.when(F.col("all_small") & ~(F.col("rle_bytes") < 0.8 * (F.col("n") / 2 + 5)), "bitpack").when((F.col("n") >= 10) & (F.col("top") < 1024) & (F.col("rice_bytes") < 1.5 * F.col("n")), "rice").otherwise("tokens")
    return out.select(*keys, "n", "all_small", "top", "bitpack_bytes", "rle_bytes", "rice_k", "rice_bytes", "token_bytes", codec.alias("codec"))


def rice_stream(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rice codes of each sequence's deltas, as text of zeros and ones: keys, rice_k, bit_text."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, (F.col(value) - F.lag(value).over(w)).cast("long").alias("d")).withColumn("at", F.row_number().over(w)).where("d is not null")
    rows = rows.select(*keys, "at", "d", bits.zigzag(F.col("d")).alias("u"))
    k = rows.groupBy(*keys).agg(bits.rice_parameter(F.max(F.abs("d"))).alias("rice_k"))
    coded = rows.join(k, list(keys)).select(*keys, "rice_k", F.struct("at", bits.rice_code(F.col("u"), F.col("rice_k")).alias("code")).alias("c"))
    return coded.groupBy(*keys, "rice_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["code"]), "").alias("bit_text"))


def fill_forward(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "filled") -> DataFrame:
    """Nulls take the value before; leading ones the first that is there."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.coalesce(before, F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def fill_first(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "filled") -> DataFrame:
    """Nulls take the first value that is there: an aggregate and a join on the keys, no sort of whole groups."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    return df.join(first, list(keys), "left").withColumn(out, F.coalesce(F.col(value), F.col("_first"))).drop("_first")


def fill_default(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become 0, 0.0, false or the empty text."""
    kinds = dict(df.dtypes)
    default = lambda c: F.lit("" if kinds[c] == "string" else False if kinds[c] == "boolean" else 0).cast(kinds[c])
    return df.select(*(F.coalesce(F.col(c), default(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def byte_histogram(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Bytes of UTF-8 texts by value: keys, byte, n. Each Arrow batch is counted as a whole; only counts are shuffled."""
    kinds = {f.name: f for f in df.schema}
    schema = StructType([kinds[k] for k in keys]).add("byte", "integer").add("n", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            found = t.group_by(list(keys), use_threads=False).aggregate([("_text", "list")])
            for i, texts in enumerate(found.column("_text_list").combine_chunks()):
                n = np.bincount(np.frombuffer(b"".join(x for x in texts.values.to_pylist() if x), np.uint8), minlength=256)
                some = np.flatnonzero(n)
                same = [pa.array([found.column(k)[i].as_py()] * len(some), b.schema.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=schema.names)

    counts = df.select(*keys, F.encode(F.col(text), "UTF-8").alias("_text")).mapInArrow(count, schema)
    return counts.groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def entropy_gate(df: DataFrame, text: str, keys: Sequence[str], sample: int = 1024, limit: float = 0.80) -> DataFrame:
    """Per row, distinct bytes over bytes of the first KiB, and whether that says to store it as it is (the gate's own rule)."""
    h = F.hex(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    pairs = F.regexp_extract_all(F.substring(h, 1, 2 * sample), F.lit("(..)"), 1)
    out = df.select(*keys, F.size(F.array_distinct(pairs)).alias("kinds"), F.size(pairs).alias("looked_at"))
    return out.withColumn("stored", (F.col("looked_at") > 0) & (F.col("kinds") / F.col("looked_at") > limit))


def schema_union(df: DataFrame, json: str, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """All keys of JSON objects in order of first appearance: keys, field, field_at."""
    names = df.select(*keys, F.struct(*order).alias("o"), F.posexplode(F.json_object_keys(F.col(json))).alias("pos", "field"))
    firsts = names.groupBy(*keys, "field").agg(F.min(F.struct("o", "pos")).alias("first"))
    return firsts.select(*keys, "field", (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).alias("field_at"))
