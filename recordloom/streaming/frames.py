"""Continuous encoding and decoding: dictionaries, and the bytes of an unfinished frame, live in keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..codec import transforms, wire

_STATE = "state binary"


def _load(state: GroupState, make):
    return pickle.loads(state.get[0]) if state.exists else make()


def read_pieces(spark: SparkSession, path: str, schema: str | StructType, files: int = 64) -> DataFrame:
    """Streaming: Parquet files of a folder, at most so many in a micro-batch. That bounds what a key's step holds at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def cuts(sizes: Sequence[int], resets: Sequence[bool], rows: int, most: int) -> list[tuple[int, int, bool]]:
    """Frames of a run of records: start, end, and whether dictionaries start afresh there.

    A frame ends with the record that fills it, by number or by bytes, before one that asks for a reset, and with the
    last record: nothing waits for the next micro-batch.
    """
    out, start, held, fresh = [], 0, 0, False
    for i, (size, reset) in enumerate(zip(sizes, resets, strict=True)):
        if reset and i > start:
            out.append((start, i, fresh))
            start, held, fresh = i, 0, False
        fresh |= reset
        held += size
        if i + 1 - start >= rows or held >= most:
            out.append((start, i + 1, fresh))
            start, held, fresh = i + 1, 0, False
    return out + [(start, len(sizes), fresh)] * (start < len(sizes))


def encode_stream(records: DataFrame, stream: str, order: str, json: str = "json", reset: str | None = None, rows: int = 128, most: int = 4096) -> DataFrame:
    """Streaming: records (JSON objects) of each stream become frames of at most `rows` records: stream, seq, n, payload.

    A frame also ends with the record that brings its JSON to `most` bytes, and with the micro-batch. Dictionaries go on
    from frame to frame; before a row in which the column `reset` is true they start afresh, on both sides: the frame
    that begins with it carries the flag.
    """
    import json as js

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        encoder, seq = _load(state, lambda: (wire.Encoder(), 0))
        held = pd.concat(list(frames)).sort_values("_order")
        texts = held["_json"].tolist()
        numbers, payloads = [], []
        for start, end, fresh in cuts([len(x.encode()) for x in texts], held["_reset"].fillna(False).astype(bool).tolist(), rows, most):
            if fresh:
                encoder.restart()
            numbers.append(end - start)
            payloads.append(wire.encode_records([js.loads(x) for x in texts[start:end]], encoder))
        state.update((pickle.dumps((encoder, seq + len(numbers))),))
        yield pd.DataFrame({"stream": [key[0]] * len(numbers), "seq": range(seq, seq + len(numbers)), "n": numbers, "payload": payloads})

    r = F.col(reset) if reset else F.lit(False)
    rows_ = records.select(F.col(stream).cast("string").alias("_key"), F.col(order).cast("long").alias("_order"), F.col(json).alias("_json"), r.alias("_reset"))
    return rows_.groupBy("_key").applyInPandasWithState(step, "stream string, seq long, n long, payload binary", _STATE, "append", GroupStateTimeout.NoTimeout)


def decode_stream(units: DataFrame) -> DataFrame:
    """Streaming: pieces of bytes (stream, seq, payload) become records: stream, at, json.

    Pieces need not end where frames do: what is left of one waits in the state for the next. A frame that says that
    dictionaries start afresh is read so.
    """
    import json as js

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder, tail, at = _load(state, lambda: (wire.Decoder(), b"", 0))
        rows = pd.concat(list(frames)).sort_values("seq")
        blob = tail + b"".join(bytes(x) for x in rows["payload"])
        found, used = wire.split_frames(blob)
        out = [r for f in found for r in wire.decode(f, decoder)]
        state.update((pickle.dumps((decoder, blob[used:], at + len(out))),))
        yield pd.DataFrame({"stream": [key[0]] * len(out), "at": range(at, at + len(out)), "json": [js.dumps(r, ensure_ascii=False) for r in out]})

    return units.select("stream", "seq", "payload").groupBy("stream").applyInPandasWithState(step, "stream string, at long, json string", _STATE, "append", GroupStateTimeout.NoTimeout)


def _windowed(pieces: DataFrame, direction: str) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = _load(state, transforms.LzWindow)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [getattr(window, direction)(bytes(x)) for x in rows["payload"]]
        state.update((pickle.dumps(window),))
        yield pd.DataFrame({"stream": [key[0]] * len(out), "seq": rows["seq"].tolist(), "payload": out})

    return pieces.select("stream", "seq", "payload").groupBy("stream").applyInPandasWithState(step, "stream string, seq long, payload binary", _STATE, "append", GroupStateTimeout.NoTimeout)


def compress_stream(pieces: DataFrame) -> DataFrame:
    """Streaming: pieces (stream, seq, payload) compressed with a window that goes on from piece to piece."""
    return _windowed(pieces, "compress")


def decompress_stream(pieces: DataFrame) -> DataFrame:
    """Streaming: the other way."""
    return _windowed(pieces, "decompress")
