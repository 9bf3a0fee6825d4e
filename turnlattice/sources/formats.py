"""Audit of exported files: one scan over JSON lines, CSV and record files that tells each fault with its file and offset.

Files are read in byte ranges, whatever their size. A line belongs to the range in which it begins; the range's task reads on
until the line ends. What is wrong with a file as a whole (no line at all, a wrong header, a cut-off end) is told at offset 0
or at the end.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.sources.records import Layout, _open

RANGE_BYTES, PIECE = 16 << 20, 1 << 16
FAULTS = "file string, offset long, fault string"


def _lines(f, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its newline) of the lines that begin in [begin, end)."""
    f.seek(max(begin - 1, 0))
    at, data, ended = max(begin - 1, 0), b"", False
    if begin:  # the line that the range before has
        while b"\n" not in data:
            piece = f.read(PIECE)
            if not piece:
                return
            at, data = (at + len(data), piece) if b"\n" not in data else (at, data)
        cut = data.index(b"\n") + 1
        at, data = at + cut, data[cut:]
    while at < end:
        cut = data.find(b"\n")
        while cut < 0 and not ended:
            piece = f.read(PIECE)
            ended = not piece
            cut = piece.find(b"\n")
            cut = len(data) + cut if cut >= 0 else -1
            data += piece
        if cut < 0:
            if data:
                yield at, data
            return
        yield at, data[:cut]
        at, data = at + cut + 1, data[cut + 1 :]


def _unpaired(text: str) -> bool:
    """If quotes don't close in a line of CSV, or stand within a field without being doubled."""
    try:
        next(csv.reader([text], strict=True), None)
    except csv.Error:
        return True
    return False


def _json_fault(line: bytes) -> str | None:
    try:
        value = json.loads(line.decode(), parse_constant=lambda word: (_ for _ in ()).throw(ValueError(word)))
    except UnicodeDecodeError:
        return "not UTF-8"
    except ValueError:
        return "not JSON"
    return None if isinstance(value, dict) else "no object"


def _csv_fault(line: bytes, columns: int) -> str | None:
    try:
        text = line.decode().removesuffix("\r")
    except UnicodeDecodeError:
        return "not UTF-8"
    if _unpaired(text):
        return "quotes"
    return None if len(next(csv.reader([text]), [])) == columns else "columns"


def audited(spark: SparkSession, files: DataFrame, layouts: dict[str, Layout] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, offset and fault of all faults in `files` (file, format: jsonl, csv or a key of `layouts`); sound files have none.

    JSON lines: each line an object in UTF-8 with finite numbers. CSV: the columns of its first line in all others, quotes
    paired, a record a line. Records: header, and a length that fits it. A file that isn't there, is empty or has an unknown
    format is a fault, too. The driver reads the names only; lists of files and ranges are rows.
    """
    layouts = layouts or {}
    texts = {k: v.to_json() for k, v in layouts.items()}

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, kind in zip(batch.column("file").to_pylist(), batch.column("format").to_pylist(), strict=True):
                store, place = _open(file)
                info, columns, fault, at = store.get_file_info(place), 0, None, 0
                if info.type != pyarrow.fs.FileType.File:
                    fault = "missing"
                elif kind not in ("jsonl", "csv", *texts):
                    fault = "unknown format"
                elif not info.size:
                    fault = "empty"
                elif kind in texts:
                    layout = Layout.from_json(texts[kind])
                    with store.open_input_file(place) as f:
                        head = f.read(len(layout.header))
                    try:
                        whole = len(layout.header) + layout.count(head, file) * layout.record.itemsize
                        if info.size != whole:
                            fault, at = ("cut off" if info.size < whole else "longer than its header tells"), min(info.size, whole)
                    except ValueError:
                        fault = "header"
                else:
                    if kind == "csv":
                        with store.open_input_file(place) as f:
                            first = next(_lines(f, 0, 1, info.size))[1]
                        columns = len(next(csv.reader([first.decode(errors="replace").removesuffix("\r")]), []))
                    out += [(file, kind, k, min(k + range_bytes, info.size), info.size, columns, None, None) for k in range(0, info.size, range_bytes)]
                if fault:
                    out.append((file, kind, None, None, None, None, at, fault))
            names = ["file", "format", "begin", "end", "size", "columns", "offset", "fault"]
            values = list(zip(*out, strict=True)) if out else [[]] * len(names)
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = [(r["file"], r["offset"], r["fault"])] if r["fault"] else []
                if r["begin"] is not None:
                    store, place = _open(r["file"])
                    with store.open_input_file(place) as f:
                        for offset, line in _lines(f, r["begin"], r["end"], r["size"]):
                            if fault := _json_fault(line) if r["format"] == "jsonl" else _csv_fault(line, r["columns"]):
                                out.append((r["file"], offset, fault))
                values = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.string(), pa.int64(), pa.string()], strict=True)], ["file", "offset", "fault"])

    listed = files.select("file", "format").mapInArrow(ranges, "file string, format string, begin long, end long, size long, columns long, offset long, fault string")
    return listed.repartition(4 * spark.sparkContext.defaultParallelism, "file", "begin").mapInArrow(scanned, FAULTS)


def listed(spark: SparkSession, root: str, kinds: dict[str, str], empty: bool = True) -> DataFrame:
    """file and format of the files below `root` whose name ends in a key of `kinds`; the driver lists names only.

    `empty`: files without a byte, too. Spark writes one where the first of a table's partitions has no rows.
    """
    store, place = _open(root)
    found = [i.path for i in store.get_file_info(pyarrow.fs.FileSelector(place, recursive=True)) if i.type == pyarrow.fs.FileType.File and not i.base_name.startswith((".", "_")) and (empty or i.size)]
    scheme = f"{root.split('://')[0]}://" if "://" in root else ""
    rows = [(f"{scheme}{p}", kind) for p in sorted(found) for end, kind in kinds.items() if p.endswith(end)]
    return spark.createDataFrame(rows, "file string, format string").orderBy(F.col("file"))
