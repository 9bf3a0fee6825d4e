"""Files of fixed-width records as a Spark data source: read by byte ranges, written by tasks at known offsets.

Reading: the driver looks at headers and sizes only; tasks get ranges of whole records of any file and read them in blocks.
Writing: rows carry their `index`; a task writes the records of each run of indexes, either into a part file of its own or
at their offset in one file. The driver learns (first, count) of each run, checks that they cover 0, 1, .. without a gap,
writes the header and puts the result in its place; rows never pass through it. Until then nothing is to be seen under the
path, a task that is run again writes the same bytes, and a failed job leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from turnlattice.sources.shared import range_partitions

#: Records of a block that a task holds at a time, and bytes of a range.
BLOCK, SPLIT_BYTES = 20_000, 32 << 20
HEADER, PARTS = "_header", "part-"
_KINDS = {"u1": T.IntegerType(), "i1": T.IntegerType(), "u2": T.IntegerType(), "i2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "i8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
_WIDE = {T.IntegerType: np.int32, T.LongType: np.int64, T.FloatType: np.float32, T.DoubleType: np.float64}
_ARROW = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}


@dataclass(frozen=True)
class Layout:
    """Header and fields of a format.

    header: its bytes with a zero count; the count of records goes to `count_at`, little-endian in `count_size` bytes. The
    first `checked` bytes have to agree, the others may differ from file to file. fields: name and numpy type of each, a
    third item is the length of an array; S and V with a length are text (NUL-padded) and bytes.
    """

    header: bytes
    fields: tuple[tuple, ...]
    count_at: int = 12
    count_size: int = 4
    checked: int | None = None

    @property
    def record(self) -> np.dtype:
        return np.dtype([tuple(f) if len(f) < 3 else (f[0], f[1], (f[2],)) for f in self.fields])

    def headed(self, count: int) -> bytes:
        if count >= 1 << 8 * self.count_size:
            raise ValueError("too many records for the header's count")
        return self.header[: self.count_at] + struct.pack("<Q", count)[: self.count_size] + self.header[self.count_at + self.count_size :]

    def count(self, head: bytes, name: str = "") -> int:
        """The count of a header; fails on that of another format."""
        count = int.from_bytes(head[self.count_at : self.count_at + self.count_size], "little")
        upto = len(self.header) if self.checked is None else self.checked
        if len(head) < len(self.header) or head[:upto] != self.headed(count)[:upto]:
            raise ValueError(f"{name}: not a file of this format")
        return count

    def schema(self) -> T.StructType:
        kinds = [T.StringType() if f[1][0] == "S" else T.BinaryType() if f[1][0] == "V" else _KINDS[f[1].lstrip("<|")] for f in self.fields]
        kinds = [T.ArrayType(k) if len(f) > 2 else k for k, f in zip(kinds, self.fields, strict=True)]
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("index", T.LongType()), *(T.StructField(f[0], k) for f, k in zip(self.fields, kinds, strict=True))])

    def to_json(self) -> str:
        return json.dumps([self.header.hex(), self.fields, self.count_at, self.count_size, self.checked])

    @staticmethod
    def from_json(text: str) -> Layout:
        header, fields, *rest = json.loads(text)
        return Layout(bytes.fromhex(header), tuple(map(tuple, fields)), *rest)


def decoded(records: np.ndarray, schema: T.StructType) -> list[pa.Array]:
    """The fields in `schema` of an array of records, as Arrow columns."""
    out = []
    for field in schema:
        values = records[field.name]
        if isinstance(field.dataType, T.StringType):
            out.append(pa.array([v.decode() for v in values.tolist()], pa.string()))
        elif isinstance(field.dataType, T.BinaryType):
            out.append(pa.array([v.tobytes() for v in values], pa.binary()))
        elif isinstance(field.dataType, T.ArrayType):
            kind = type(field.dataType.elementType)
            flat = np.ascontiguousarray(values).astype(_WIDE[kind]).ravel()
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(flat, _ARROW[kind])))
        else:
            out.append(pa.array(np.ascontiguousarray(values).astype(_WIDE[type(field.dataType)])))
    return out


def encoded(batch: pa.RecordBatch, layout: Layout) -> np.ndarray:
    """A batch as records; fails on nulls, on texts and bytes of a wrong length and on numbers that a field can't hold."""
    out = np.zeros(batch.num_rows, layout.record)
    for name, kind, *length in layout.fields:
        column = batch.column(name)
        if column.null_count:
            raise ValueError(f"{name}: null in a fixed-width record")
        if kind[0] in "SV":
            values = [v.encode() if isinstance(v, str) else v for v in column.to_pylist()]
            size = int(kind[1:])
            if any(len(v) > size or (kind[0] == "V" and len(v) != size) or (kind[0] == "S" and v[-1:] == b"\0") for v in values):
                raise ValueError(f"{name}: a value doesn't fit {size} bytes")
            out[name] = np.array(values, f"S{size}") if kind[0] == "S" else np.frombuffer(b"".join(values), f"V{size}")
            continue
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if length else column.to_numpy(zero_copy_only=False)
        if length and values.shape[1] != length[0] and batch.num_rows:
            raise ValueError(f"{name}: an array doesn't have {length[0]} items")
        if kind.lstrip("<|")[0] in "ui" and len(values) and (values.min() < np.iinfo(kind).min or values.max() > np.iinfo(kind).max):
            raise ValueError(f"{name}: a number doesn't fit {kind}")
        out[name] = values
    return out


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Range(InputPartition):
    """`count` records of a file from byte `offset` on; the first has the number `first`."""

    file: str
    offset: int
    count: int
    first: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.layout, self.path, self.wanted = Layout.from_json(options["layout"]), options["path"], schema
        self.split = max(1, int(options.get("splitbytes", SPLIT_BYTES)) // self.layout.record.itemsize)

    def partitions(self) -> list[Range]:
        files, root = _open(self.path)
        info = files.get_file_info(root)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise ValueError(f"{self.path}: no such file")
        if info.type == pyarrow.fs.FileType.File:
            return self._whole(files, info)
        found = {f.base_name: f for f in files.get_file_info(pyarrow.fs.FileSelector(root)) if f.type == pyarrow.fs.FileType.File}
        if HEADER in found:
            return self._parts(files, found)
        names = sorted(n for n in found if not n.startswith(("_", ".")))
        return [r for n in names for r in self._whole(files, found[n])]

    def _head(self, files: pyarrow.fs.FileSystem, path: str) -> int:
        with files.open_input_file(path) as f:
            return self.layout.count(f.read(len(self.layout.header)), path)

    def _whole(self, files: pyarrow.fs.FileSystem, info: pyarrow.fs.FileInfo) -> list[Range]:
        count = self._head(files, info.path)
        if info.size != len(self.layout.header) + count * self.layout.record.itemsize:
            raise ValueError(f"{info.path}: cut off, or longer than its header tells")
        return self._ranges(info.path, len(self.layout.header), count, 0)

    def _parts(self, files: pyarrow.fs.FileSystem, found: dict) -> list[Range]:
        total, at, out = self._head(files, found[HEADER].path), 0, []
        for name in sorted(n for n in found if n.startswith(PARTS)):
            count, rest = divmod(found[name].size, self.layout.record.itemsize)
            if int(name.removeprefix(PARTS)) != at or rest:
                raise ValueError(f"{found[name].path}: a part is missing or cut off before it")
            out += self._ranges(found[name].path, 0, count, at)
            at += count
        if at != total:
            raise ValueError(f"{self.path}: {at} records, the header tells {total}")
        return out

    def _ranges(self, path: str, offset: int, count: int, first: int) -> list[Range]:
        size = self.layout.record.itemsize
        return [Range(path, offset + size * k, min(self.split, count - k), first + k) for k in range(0, count, self.split)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no records at all
            return
        files, _ = _open(self.path)
        record, own = self.layout.record, T.StructType([f for f in self.wanted if f.name not in ("file", "index")])
        with files.open_input_file(partition.file) as f:
            f.seek(partition.offset)
            for at in range(0, partition.count, BLOCK):
                n = min(BLOCK, partition.count - at)
                data = f.read(n * record.itemsize)
                if len(data) != n * record.itemsize:
                    raise ValueError(f"{partition.file}: cut off while it was read")
                columns = dict(zip(own.names, decoded(np.frombuffer(data, record), own), strict=True))
                columns["file"] = pa.array([partition.file] * n)
                columns["index"] = pa.array(np.arange(partition.first + at, partition.first + at + n))
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.wanted], self.wanted.names)


@dataclass
class Written(WriterCommitMessage):
    """The runs (first index, count, file) that a task has written."""

    runs: list[tuple[int, int, str]]


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.layout, self.path, self.single = Layout.from_json(options["layout"]), options["path"], options.get("single") == "true"
        self.overwrite, attempt = overwrite, uuid.uuid4().hex
        files, root = _open(self.path)
        if not overwrite and files.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")
        self.place = f"{root.rstrip('/')}._{attempt}"  # beside the result
        if self.single:
            if not isinstance(files, pyarrow.fs.LocalFileSystem):
                raise ValueError("one file at known offsets needs a shared folder that is mounted; use parts elsewhere")
            open(self.place, "xb").close()  # tasks don't make it: one that outlives an aborted job finds nothing to write to
        else:
            files.create_dir(self.place)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _ = _open(self.path)
        size, head, runs = self.layout.record.itemsize, len(self.layout.header), []
        target = os.open(self.place, os.O_WRONLY) if self.single else None
        try:
            for batch in iterator:
                index = batch.column("index").to_numpy(zero_copy_only=False)
                data = encoded(batch, self.layout)
                edges = [0, *(np.flatnonzero(np.diff(index) != 1) + 1).tolist(), len(index)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    first, count = int(index[a]), b - a
                    if runs and runs[-1][0] + runs[-1][1] == first:
                        runs[-1][1] += count
                    else:
                        if not self.single and target is not None:
                            target.close()
                        name = self.place if self.single else f"{self.place}/{first:020d}-{uuid.uuid4().hex}"
                        target = target if self.single else files.open_output_stream(name)
                        runs.append([first, count, name])
                    if self.single:
                        _put(target, data[a:b].tobytes(), head + first * size)
                    else:
                        target.write(data[a:b].tobytes())
        finally:
            if self.single:
                os.close(target)
            elif target is not None:
                target.close()
        return Written([tuple(r) for r in runs])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        runs = sorted(r for m in messages if m for r in m.runs)
        total = 0
        for first, count, _ in runs:
            if first != total:
                self.abort(messages)
                raise ValueError(f"index has a gap or a repeat at {min(first, total)}")
            total += count
        head = self.layout.headed(total)
        if self.single:
            target = os.open(self.place, os.O_WRONLY)
            _put(target, head, 0)
            os.truncate(target, len(head) + total * self.layout.record.itemsize)
            os.fsync(target)
            os.close(target)
            os.replace(self.place, root)
            return
        kept = set()
        for first, _, name in runs:
            kept.add(final := f"{self.place}/{PARTS}{first:020d}")
            files.move(name, final)
        for left in files.get_file_info(pyarrow.fs.FileSelector(self.place)):  # of tasks that were run twice
            if left.path not in kept:
                files.delete_file(left.path)
        with files.open_output_stream(f"{self.place}/{HEADER}") as f:
            f.write(head)
        there = files.get_file_info(root).type
        if there != pyarrow.fs.FileType.NotFound:
            (files.delete_dir if there == pyarrow.fs.FileType.Directory else files.delete_file)(root)
        files.move(self.place, root)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _open(self.path)
        there = files.get_file_info(self.place).type
        if there == pyarrow.fs.FileType.Directory:
            files.delete_dir(self.place)
        elif there == pyarrow.fs.FileType.File:
            files.delete_file(self.place)


def _put(target: int, data: bytes, offset: int) -> None:
    while data:
        done = os.pwrite(target, data, offset)
        data, offset = data[done:], offset + done


class RecordSource(DataSource):
    """Options: layout (Layout.to_json), path; reading: splitbytes, columns (by commas); writing: single."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> T.StructType:
        whole = Layout.from_json(self.options["layout"]).schema()
        wanted = self.options.get("columns")
        return T.StructType([whole[c] for c in wanted.split(",")]) if wanted else whole

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def read_records(spark: SparkSession, path: str, layout: Layout, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a file, of a folder of files, or of written parts: file, index (from 0 in each file) and the fields.

    `columns`: those that are made of the records. A file whose header is of another format or whose length doesn't fit it fails.
    """
    spark.dataSource.register(RecordSource)
    reader = spark.read.format(RecordSource.name()).option("layout", layout.to_json()).option("splitbytes", str(split_bytes))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write_records(frame: DataFrame, path: str, layout: Layout, single: bool = False, overwrite: bool = False) -> None:
    """Writes the rows of `frame`, which has `index` 0, 1, .. and the fields of the layout, in order of index.

    single: one file with its header, in a shared folder that is mounted; else a folder of parts. `selection.numbered` gives
    any table such an index. Fails, and leaves nothing, on a gap or a repeat in index and on values that a field can't hold.
    """
    frame.sparkSession.dataSource.register(RecordSource)
    rows = frame.select(F.col("index").cast("long").alias("index"), *[f[0] for f in layout.fields])
    ordered = rows.repartitionByRange(range_partitions(rows), "index").sortWithinPartitions("index")
    writer = ordered.write.format(RecordSource.name()).option("layout", layout.to_json()).option("single", str(single).lower())
    writer.mode("overwrite" if overwrite else "append").save(path)
