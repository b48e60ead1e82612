"""Operators on ordered records: deltas, runs, dictionaries. Every one takes its partition keys and a total order.

Order is never global: sequences are partitioned by a key, so a cluster works on many at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..codec import wire

Q16 = 65536.0


def _window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def delta(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "delta") -> DataFrame:
    """Difference from the value before; null for the first of a sequence."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(_window(keys, order)))


def undelta(df: DataFrame, first: str, change: str, keys: Sequence[str], order: Sequence[str], out: str = "value") -> DataFrame:
    """Values from deltas: the first one, then running sums."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.coalesce(F.col(change), F.col(first))).over(w))


def quantised_delta(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "delta") -> DataFrame:
    """Deltas of values on a grid of 1/65536 around the first value of the sequence (telescoped, half-even)."""
    w = _window(keys, order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("_grid", F.rint((F.col(value) - first) * Q16))
    return df.withColumn(out, F.col("_grid") - F.lag("_grid").over(w)).drop("_grid")


def viability(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per sequence, whether the grid of 1/65536 reproduces every value within tolerance and no delta leaves 32 bits."""
    w = _window(keys, order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.select(*keys, *order, F.col(value).alias("v"), first.alias("v0")).withColumn("g", F.rint((F.col("v") - F.col("v0")) * Q16))
    df = df.withColumn("d", F.abs(F.col("g") - F.lag("g").over(w)))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("v0") + F.col("g") / Q16 - F.col("v"))).alias("worst"), (F.max("d") < 2147483648.0).alias("fits")).withColumn("viable", F.coalesce((F.col("worst") <= tolerance) & F.coalesce(F.col("fits"), F.lit(True)), F.lit(False)))


def runs(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Maximal runs of equal values (nulls are equal): keys, run (from 0), value, length, start (rows before the run)."""
    w = _window(keys, order)
    df = df.select(*keys, *order, value.alias("value")).withColumn("at", F.row_number().over(w) - 1)
    change = F.when((F.col("at") == 0) | ~F.col("value").eqNullSafe(F.lag("value").over(w)), 1).otherwise(0)
    df = df.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return df.groupBy(*keys, "run").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("length"), F.min("at").alias("start"))


def expand_runs(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of runs(): keys, at, value."""
    return found.select(*keys, F.col("value"), F.explode(F.sequence(F.col("start").cast("long"), F.col("start") + F.col("length") - 1)).alias("at"))


def zero_runs(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], least: int = 4) -> DataFrame:
    """Runs of zero deltas that are long enough to be written as one token."""
    found = runs(delta(df, value, keys, order, "d").where("d is not null"), F.col("d") == 0, keys, order)
    return found.where(F.col("value") & (F.col("length") >= least)).drop("value")


def first_seen(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Slots of a dictionary that is never full: each distinct value's rank by first appearance, from 0."""
    at = F.row_number().over(_window(keys, order)) - 1
    firsts = df.select(*keys, F.col(value).alias("value"), at.alias("at")).groupBy(*keys, "value").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("uses"))
    return firsts.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy("first_at")) - 1)


def _passed(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable, kept: Sequence[str], made: StructType) -> DataFrame:
    """One pass over each sequence in order: kept columns, and what step(state, row) makes of each row. A state is all that is held."""
    kinds = {f.name: f for f in df.schema}
    schema = StructType([kinds[c] for c in kept] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                own = tuple(r[k] for k in keys)
                if state is None or own != key:
                    key, state = own, start()
                out.append(step(state, r))
            columns = [pa.array([x[i] for x in out], to_arrow_type(f.dataType)) for i, f in enumerate(made.fields)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], names=schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def lru_slots(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], slots: int = 64) -> DataFrame:
    """What a dictionary of so many slots, the least recently used replaced, does with each value: keys, at, value, hit, slot.

    One ordered pass with the dictionary as its state; sequences run side by side.
    """

    class Held:
        def __init__(self):
            self.at, self.slots = -1, wire.Slots(slots)

    def step(held: Held, row: dict) -> tuple[int, bool, int]:
        held.at += 1
        slot, new = held.slots.get_or_add(row["_value"])
        return held.at, not new, slot

    made = StructType().add("at", "long").add("hit", "boolean").add("slot", "integer")
    rows = df.select(*keys, F.col(value).alias("_value"), *(o for o in order if o not in keys))
    out = _passed(rows, keys, order, Held, step, [*keys, "_value"], made)
    return out.select(*keys, "at", F.col("_value").alias("value"), "hit", "slot")


def lru_hits(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], slots: int = 64) -> DataFrame:
    """Whether such a dictionary still holds each value: keys, at, value, hit."""
    return lru_slots(df, value, keys, order, slots).drop("slot")


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = 128) -> DataFrame:
    """Number of the partial batch that a record of a stream goes to, by the rule on rows."""
    return df.withColumn("chunk", F.floor((F.row_number().over(_window(keys, order)) - 1) / rows).cast("long"))


def byte_chunks(df: DataFrame, size: Column, keys: Sequence[str], order: Sequence[str], rows: int = 128, most: int = 4096) -> DataFrame:
    """As chunks(), but a batch also ends with the record that brings its payload to `most` bytes. keys, order, chunk. One ordered pass."""

    def step(held: list[int], row: dict) -> tuple[int]:
        chunk, n, used = held[0], held[1] + 1, held[2] + (row["_size"] or 0)
        held[:] = [chunk + 1, 0, 0] if n >= rows or used >= most else [chunk, n, used]
        return (chunk,)

    sized = df.select(*keys, *order, size.cast("long").alias("_size"))
    return _passed(sized, keys, order, lambda: [0, 0, 0], step, [*keys, *order], StructType().add("chunk", "long"))


def field_deltas(df: DataFrame, field: str, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The stand-alone coder per field: kind of token and stored number for each value.

    The first value of a field is absolute: as 8.8 fixed point within -128 to 127, else as 16.16. Later ones are open-loop
    deltas on the 8.8 grid, small (-8 to 7) or large. Of a column of integers the first one is stored as it is (int), and
    deltas are plain differences.
    """
    w = Window.partitionBy(*keys, field).orderBy(*order)
    before = F.lag(value).over(w)
    if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint"):
        d = F.col(value).cast("long") - before
        kind = F.when(before.isNull(), "int").when(d.between(-8, 7), "small").otherwise("large")
        return df.withColumn("kind", kind).withColumn("stored", F.when(before.isNull(), F.col(value)).otherwise(d).cast("long"))
    d = F.rint((F.col(value) - before) * 256)
    absolute16 = F.col(value).between(-128, 127)
    kind = F.when(before.isNull(), F.when(absolute16, "fixed16").otherwise("fixed32")).when(d.between(-8, 7), "small").otherwise("large")
    stored = F.when(before.isNull(), F.when(absolute16, F.rint(F.col(value) * 256)).otherwise(F.rint(F.col(value) * 65536))).otherwise(d)
    return df.withColumn("kind", kind).withColumn("stored", stored.cast("long"))


def field_values(df: DataFrame, field: str, order: Sequence[str], keys: Sequence[str] = (), integers: bool = False, out: str = "value") -> DataFrame:
    """Values of field_deltas()' rows, longs for integers and else doubles: an absolute one, and running sums of deltas up to the next.

    Deltas of doubles are open-loop, so a value is as far off as the roundings since its absolute one add up to.
    """
    w = Window.partitionBy(*keys, field).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scale = F.when(F.col("kind") == "fixed32", Q16).otherwise(256.0)
    first = F.col("kind").isin("int", "fixed16", "fixed32")
    df = df.withColumn("_step", F.col("stored") if integers else F.col("stored") / scale).withColumn("_run", F.sum(first.cast("long")).over(w))
    w = Window.partitionBy(*keys, field, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.when(F.col("stored").isNotNull(), F.sum("_step").over(w))).drop("_step", "_run")
