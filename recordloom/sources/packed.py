"""Packed files as a Spark data source: spark.read.format("recordloom") and df.write.format("recordloom").

A file is a row of units, each behind its length. Behind the last one stand a zero and an index: how many bytes each
unit takes with its length, the index's own length and a mark. So a reader cuts files into ranges of whole units and
holds one unit at a time; a file without an index is read as one range. Paths are plain or URIs that Arrow's file
systems know (file, hdfs, s3, gs), so a folder need not be on a disk that machines share.
Options: path, compress, batch_rows, split_bytes, mode; the schema is given to the reader, as for any source that does
not infer one, and only its columns are built.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..codec import wire
from ..operators.packing import _merged, array_of, columns_of

_MARK = b"LOOMIDX1"
#: Bytes of a range of units that one task reads, unless the reader asks for others.
SPLIT_BYTES = 32 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Range(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int = 0):
        super().__init__((path, start, end))


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.compress, self.rows, self.overwrite = options["path"], options.get("compress", "zlib"), int(options.get("batch_rows", 4096)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        at, sizes = posixpath.join(folder, f".{uuid.uuid4().hex}.tmp"), []
        with fs.open_output_stream(at) as f:
            for b in iterator:
                for i in range(0, b.num_rows, self.rows):
                    t = b.slice(i, self.rows)
                    e = wire.Encoder()
                    unit = wire.pack_unit(e.frame(e.batch(columns_of(t), t.num_rows)), self.compress)
                    head = wire.varint(len(unit))
                    f.write(head + unit)
                    sizes.append(len(head) + len(unit))
            index = b"".join(map(wire.varint, sizes))
            f.write(b"\x00" + index + len(index).to_bytes(8, "little") + _MARK)
        return _Written(at)

    def commit(self, messages: list) -> None:
        """Files of finished tasks get their names; those of lost attempts stay hidden and go with abort or overwrite."""
        fs, folder = file_system(self.path)
        kept = {m.path for m in messages if m}
        if self.overwrite:
            for old in _files(fs, folder):
                fs.delete_file(old)
        for p in kept:
            fs.move(p, posixpath.join(folder, f"{posixpath.basename(p)[1:-4]}.loom"))

    def abort(self, messages: list) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m and fs.get_file_info(m.path).type == pafs.FileType.File:
                fs.delete_file(m.path)


def _files(fs: pafs.FileSystem, folder: str) -> list[str]:
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".loom"))


def ranges(f: pa.NativeFile, most: int) -> list[tuple[int, int]]:
    """Starts and ends of runs of whole units of at most so many bytes, or of one unit, by the file's index; from the last bytes alone."""
    size = f.size()
    if size < 17:
        return [(0, size)] if size else []
    f.seek(size - 16)
    tail = f.read(16)
    if tail[8:] != _MARK:
        return [(0, size)]
    n = int.from_bytes(tail[:8], "little")
    f.seek(size - 16 - n)
    index, at, out, start, end = f.read(n), 0, [], 0, 0
    while at < n:
        unit, at = wire.read_varint(index, at)
        if end > start and end + unit - start > most:
            out.append((start, end))
            start = end
        end += unit
    return out + [(start, end)] * (end > start)


def units(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Units from start to end, one at a time."""
    f.seek(start)
    while start < end:
        head = f.read(min(10, end - start))
        n, used = wire.read_varint(head, 0)
        if n == 0:  # the index follows
            return
        f.seek(start + used)
        unit = f.read(n)
        if len(unit) < n:
            raise wire.FormatError("data end early")
        yield unit
        start += used + n


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.path, self.permissive = schema, options["path"], options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.most = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        files = [path] if fs.get_file_info(path).type == pafs.FileType.File else _files(fs, path)
        out = []
        for p in files:
            with fs.open_input_file(p) as f:
                out += [_Range(p, a, b) for a, b in ranges(f, self.most)]
        return out or [_Range("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        if not path:
            return
        arrow = to_arrow_schema(self.schema)
        with file_system(self.path)[0].open_input_file(path) as f:
            for unit in units(f, start, end):
                try:
                    for x in _merged(wire.Decoder().items(wire.parse_frame(wire.unpack_unit(unit))[1])):
                        have = dict(zip(x.names, x.columns, strict=True))
                        yield pa.RecordBatch.from_arrays([array_of(have[c.name], c.type) if c.name in have else pa.nulls(x.n, c.type) for c in arrow], schema=arrow)
                except ValueError:
                    if not self.permissive:
                        raise


class PackedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordloom"

    def schema(self):
        raise ValueError("give the reader a schema")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool):
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PackedSource)
    return spark
