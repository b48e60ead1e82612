"""Packing DataFrames into batches of the packed format and back.

Rows are range-partitioned by the requested order and cut into batches inside each partition, so there is no global
order to wait for, no batch outgrows batch_rows, and unpacking needs no shuffle at all.
"""

from __future__ import annotations

import json as js
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..codec import transforms, wire

PACKED = "part int, batch long, n int, raw_bytes long, payload binary, crc long, schema string"


def columns_of(batch: pa.RecordBatch | pa.Table) -> list[tuple[str, object, np.ndarray | None]]:
    """A batch's columns as the encoder takes them."""
    out = []
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
        kind = column.type
        if pa.types.is_timestamp(kind) or pa.types.is_duration(kind) or pa.types.is_time64(kind):
            column, kind = column.cast(pa.int64()), pa.int64()
        elif pa.types.is_date32(kind) or pa.types.is_time32(kind):
            column, kind = column.cast(pa.int32()), pa.int32()
        if pa.types.is_integer(kind):
            values = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_floating(kind):
            values = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        elif pa.types.is_decimal(kind):
            values = [None if x is None else str(x) for x in column.to_pylist()]
        else:
            values = [_plain(x) for x in column.to_pylist()]
        out.append((name, values, valid))
    return out


def _plain(x):
    """Nested values as the format has them; times inside stay exact as text."""
    if x is None or isinstance(x, (bool, int, float, str, bytes)):
        return x
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return str(x)


def array_of(column, kind: pa.DataType) -> pa.Array:
    """A decoded column in the type that its schema says."""
    values, valid = column
    mask = None if valid is None else ~valid
    if isinstance(values, np.ndarray):
        made = pa.array(values, mask=mask)
        if pa.types.is_timestamp(kind) or pa.types.is_duration(kind) or pa.types.is_time64(kind):
            return made.cast(pa.int64()).cast(kind)
        if pa.types.is_date32(kind) or pa.types.is_time32(kind):
            return made.cast(pa.int32()).cast(kind)
        return made.cast(kind)
    values = wire.as_list(column)
    if pa.types.is_decimal(kind):
        return pa.array(values, pa.string()).cast(kind)
    if pa.types.is_timestamp(kind) or pa.types.is_duration(kind) or pa.types.is_time64(kind):
        return pa.array(values, pa.int64()).cast(kind)
    if pa.types.is_date32(kind) or pa.types.is_time32(kind):
        return pa.array(values, pa.int32()).cast(kind)
    return pa.array(values, kind)


def pack(df: DataFrame, order_by: Sequence[str], batch_rows: int = 4096, compress: str = "zlib", layout: str = "batch") -> DataFrame:
    """df as packed batches: part, batch, n, raw_bytes, payload, crc, schema (JSON).

    Records keep their order within a batch; batches are ordered by part, then batch. layout 'rows' writes every record
    as an object. Every batch has dictionaries of its own, so each can be read alone.
    """
    schema = df.schema.json()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, rows = 0, [], 0

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            part = t.column("_part")[0].as_py()
            t = t.drop_columns(["_part"])
            e = wire.Encoder()
            if layout == "rows":
                items = b"".join(e.value({k: v for k, v in zip(t.schema.names, r, strict=True) if v is not None}) for r in zip(*(wire.as_list((c[1], c[2])) for c in columns_of(t)), strict=True))
            else:
                items = e.batch(columns_of(t), t.num_rows)
            unit = wire.pack_unit(e.frame(items), compress)
            number += 1
            return pa.RecordBatch.from_pylist([{"part": part, "batch": number - 1, "n": t.num_rows, "raw_bytes": t.nbytes, "payload": unit, "crc": zlib.crc32(unit), "schema": schema}], pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("n", pa.int32()), ("raw_bytes", pa.int64()), ("payload", pa.binary()), ("crc", pa.int64()), ("schema", pa.string())]))

        for b in batches:
            waiting.append(b)
            rows += b.num_rows
            while rows >= batch_rows:
                t = pa.Table.from_batches(waiting)
                yield emit(t.slice(0, batch_rows))
                rest = t.slice(batch_rows)
                waiting, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield emit(pa.Table.from_batches(waiting))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by) if order_by else df
    return ordered.withColumn("_part", F.spark_partition_id()).mapInArrow(run, PACKED)


def unpack(packed: DataFrame, schema: StructType, columns: Sequence[str] | None = None, verify: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Records of packed batches, in their batches' order. PERMISSIVE passes over batches that cannot be read."""
    wanted = StructType([f for f in schema.fields if columns is None or f.name in columns])
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit in b.column("payload").to_pylist():
                try:
                    items = wire.Decoder().items(wire.parse_frame(wire.unpack_unit(unit), verify)[1])
                    for x in _merged(items):
                        have = dict(zip(x.names, x.columns, strict=True))
                        yield pa.RecordBatch.from_arrays([array_of(have[f.name], f.type) if f.name in have else pa.nulls(x.n, f.type) for f in arrow], schema=arrow)
                except (ValueError, zlib.error):
                    if mode == "FAILFAST":
                        raise

    return packed.select("payload").mapInArrow(run, wanted)


def _merged(items: list) -> Iterator[wire.Batch]:
    """Batches as they are, and single records together as one."""
    alone: list[dict] = []
    for x in items:
        if isinstance(x, wire.Batch):
            yield x
        elif isinstance(x, list):
            yield from _merged(x)
        else:
            alone.append(x)
    if alone:
        names = list(dict.fromkeys(k for r in alone for k in r))
        yield wire.Batch(len(alone), names, [([r.get(k) for r in alone], None) for k in names])


#: Single steps besides the kinds of transforms.transform(), and their inverses.
STEPS = {"rle": (transforms.rle_encode, transforms.rle_decode), "zero_rle": (transforms.zero_rle_encode, transforms.zero_rle_decode), "mtf_step": (transforms.mtf_encode, transforms.mtf_decode)}


def framed(df: DataFrame, json: str, keys: Sequence[str]) -> DataFrame:
    """keys and payload: each JSON value as a frame of its own, by an encoder that starts afresh."""
    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), "payload binary"])

    def run(batches):
        for b in batches:
            out = [None if x is None else wire.encode(js.loads(x)) for x in b.column("_json").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "payload"])

    return df.select(*keys, F.col(json).alias("_json")).mapInArrow(run, schema)


def header(payload: Column, at: int) -> Column:
    """A byte of a frame's header, by place: 4 version, 5 flags, 6 the first of the symbol count (all of it below 128)."""
    return F.conv(F.hex(F.substring(payload, at + 1, 1)), 16, 10).cast("int")


def transformed(df: DataFrame, text: str, kind: str, keys: Sequence[str]) -> DataFrame:
    """keys and the transform (or single step) of a text's UTF-8 bytes; a null text gives null."""
    do = STEPS[kind][0] if kind in STEPS else lambda x: transforms.transform(x, kind)
    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), "payload binary"])

    def run(batches):
        for b in batches:
            out = [None if x is None else do(x) for x in b.column("_raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "payload"])

    return df.select(*keys, F.encode(F.col(text), "UTF-8").alias("_raw")).mapInArrow(run, schema)


def untransformed(df: DataFrame, keys: Sequence[str], step: str | None = None) -> DataFrame:
    """The other way: keys and text. A single step has to be named, as nothing in its bytes tells it."""
    undo = STEPS[step][1] if step else transforms.untransform
    schema = ", ".join([*(f"`{k}` {dict(df.dtypes)[k]}" for k in keys), "text string"])

    def run(batches):
        for b in batches:
            out = [None if x is None else undo(x).decode() for x in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.string())], names=[*keys, "text"])

    return df.select(*keys, "payload").mapInArrow(run, schema)


def huffman_table(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Code lengths and canonical codes from byte counts (keys, byte, n): keys, byte, bits, code (as text).

    A group has 256 rows at most. Lengths come from package-merge; a code is a window sum over the Kraft shares before it.
    """
    kinds = dict(histogram.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "byte int, bits int"])

    def lengths(t: pa.Table) -> pa.Table:
        found = transforms.code_lengths(dict(zip(t.column("byte").to_pylist(), t.column("n").to_pylist(), strict=True)))
        same = {k: pa.array([t.column(k)[0].as_py()] * len(found), t.schema.field(k).type) for k in keys}
        return pa.table({**same, "byte": pa.array(list(found), pa.int32()), "bits": pa.array(list(found.values()), pa.int32())})

    by = histogram.select(*keys, "byte", "n").groupBy(*keys).applyInArrow(lengths, schema)
    w = Window.partitionBy(*keys).orderBy("bits", "byte").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), 15 - F.col("bits"))).over(w), F.lit(0).cast("long"))
    code = F.call_function("shiftright", share, 15 - F.col("bits"))
    return by.select(*keys, "byte", "bits", F.lpad(F.bin(code), F.col("bits"), "0").alias("code"))
