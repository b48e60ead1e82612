"""What the operators share: tables, the shared scratch folder, size-checked broadcasts and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize, scratch_path, ship, spread  # noqa: F401

#: A side of a join is broadcast up to so many bytes; what a row of it takes beside its columns.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 24
#: Text bytes that one step of a numpy kernel takes at once; a longer text is a step by itself.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """The package on all workers, and fewer rows in an Arrow batch than by default: a row may hold a long text.

    Queries and stages ask for this; operators by themselves leave the session's settings alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship(spark)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, of fixed-width columns, marked for broadcast if its rows take at most so many bytes in a hash table; else df itself, which is then joined by a shuffle."""
    assert all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema), "only columns of fixed width have a known size"
    return F.broadcast(df) if df.count() * (ROW_BYTES + 8 * len(df.columns)) <= most else df


def free_name(base: str, taken: Iterable[str]) -> str:
    """A column name that does not clash, case aside, with those taken."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base += "_"
    return base


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most limit bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = np.nan_to_num(np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), dtype=float))
    at, n = 0, len(lengths)
    sums = np.cumsum(lengths)
    while at < n:
        before = sums[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(sums, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_steps(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", key: object = None) -> DataFrame:
    """mapInArrow with a kernel that sees a bounded number of text bytes at a time. key: of what the kernel asks held() for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for(key)
        for batch in batches:
            for piece in steps(batch, text):
                out = kernel(piece)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that a task has freed goes back to the system: a worker waits for other stages' tasks, maybe for long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


_HELD: list[tuple[object, object]] = []


def held_for(key: object) -> None:
    """Let go of what this Python process keeps under other keys.

    Workers serve one stage after another; what an earlier stage remembered must not add to what a later one needs.
    """
    if _HELD and _HELD[0][0] != key:
        _HELD.clear()


def held(key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept in this Python process until another key is asked for."""
    held_for(key)
    if not _HELD:
        _HELD.append((key, make()))
    return _HELD[0][1]


def is_training_row(doc_id) -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def lower(text: str) -> str:
    """A-Z become a-z, nothing else changes, so offsets stay: bytes know no other letters."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
