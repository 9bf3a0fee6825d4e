"""Media columns from content-defined payload chunks.

A text's bytes, padded by zero bytes to a positive multiple of 64, are the samples of an 8-bit mono PCM file. The payload is
cut by a rolling gear hash. Chunks that occur more than once are stored once, by digest, in a chunk table; a document's
row of the media table has its ordered chunk list and the chunks that only it holds. Both tables are written, read
back, joined on digests and put together again; every chunk and the whole file are verified against their digests before
the features are computed from the samples.

Which chunks occur more than once is a join in Spark; tasks know it from a Bloom filter of fixed size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlattice.llm import chunks
from turnlattice.llm.common import row_ids, sliced, utf8, written

BLOCK, RATE = 64, 8000
#: Chunk digests that a task remembers at most, so as to offer a chunk once.
MEMO = 200_000
_RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def header(size: int) -> bytes:
    """The 44 bytes before the samples: RIFF WAVE, PCM, one channel of 8 bits."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or size != 36 + n or len(media) != 44 + n:
        raise ValueError("not a media file of this kind")
    return media[44:]


def feature(read: bytes) -> str:
    """Mean, deviation, zero crossings a thousand samples, and the loudness of eight equal parts, of samples around 128."""
    wave = np.frombuffer(read, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    parts = (wave.reshape(8, -1) ** 2).sum(axis=1) * 8 // len(wave)
    square = int((wave * wave).sum())
    return f"{int(wave.sum()) / len(wave):.4f};{(square / len(wave) - (int(wave.sum()) / len(wave)) ** 2) ** 0.5:.4f};{1000 * crossings / len(wave):.3f};{','.join(map(str, parts.tolist()))}"


def _measured(n_bytes: int, media: bytes, whole: bytes) -> tuple:
    if chunks.digest(media) != whole:
        raise ValueError("a media file differs from what was stored")
    read = samples(media)
    return n_bytes, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(read)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", *(x.split()[0] for x in _RESULT.split(", "))])


def stored(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The media table and the chunk table, both written.

    media: _row, doc_id, n_bytes, whole (digest of the file), digests and sizes of its chunks in order, shared (the places
    in that list of the chunks that the chunk table has), own (all other chunks in order, compressed). chunk: digest, data.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = row_ids(documents.select("doc_id", utf8().alias("text")))
    payloads = rows.withColumn("data", _padded())
    known = rows.sparkSession.sparkContext.broadcast(chunks.shared_filter(payloads))

    def parted(data: bytes) -> tuple[list[bytes], list[bytes], list[bool]]:
        ends = chunks.cuts(data)
        parts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        digests = [chunks.digest(p) for p in parts]
        return parts, digests, chunks.members(known.value, chunks.keys(digests)).tolist()

    def media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            out = []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                data = payload(text)
                parts, digests, shared = parted(data)
                own = b"".join(p for p, s in zip(parts, shared, strict=True) if not s)
                out.append((len(text), chunks.digest(header(len(data)) + data), digests, [len(p) for p in parts], [k for k, s in enumerate(shared) if s], pack.compress(own)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_row", "doc_id", "n_bytes", "whole", "digests", "sizes", "shared", "own"])

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in sliced(batches):
            out: dict[bytes, bytes] = {}
            for i in range(batch.num_rows):
                out |= {d: p for p, d, s in zip(*parted(payload(batch.column("text")[i].as_py())), strict=True) if s and d not in seen}
            seen |= out.keys()
            if len(seen) > MEMO:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array([pack.compress(p) for p in out.values()], pa.binary())], ["digest", "data"])

    table = written(rows.mapInArrow(media, f"_row long, doc_id {kind}, n_bytes long, whole binary, digests array<binary>, sizes array<int>, shared array<int>, own binary"))
    return table, written(rows.select("text").mapInArrow(offered, "digest binary, data binary").dropDuplicates(["digest"]))


def _padded():
    size = F.octet_length("text")
    return F.rpad("text", F.greatest(F.ceil(size / BLOCK).cast("int"), F.lit(1)) * BLOCK, F.lit(b"\x00"))


def media_columns(documents: DataFrame) -> DataFrame:
    """One row for each row of `documents`: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text is an empty one, a payload of 64 zero bytes. Equal texts have equal values. Repeated rows are answered each;
    an empty table gives no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    media, store = stored(documents)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            rows = []
            for r in batch.to_pylist():
                read = unpack.decompress(r["own"])
                rows.append((r["doc_id"], *_measured(r["n_bytes"], header(len(read)) + read, r["whole"])))
            yield _batch(rows, batch.schema.field("doc_id").type)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            rows = []
            for r in batch.to_pylist():
                lent = {p["k"]: unpack.decompress(p["data"]) for p in r["lent"]}
                rest, at, parts = unpack.decompress(r["own"]), 0, []
                for k, (size, wanted) in enumerate(zip(r["sizes"], r["digests"], strict=True)):
                    part = lent[k] if k in lent else rest[at : at + size]
                    at += 0 if k in lent else size
                    if chunks.digest(part) != wanted:
                        raise ValueError("a chunk differs from its digest")
                    parts.append(part)
                read = b"".join(parts)
                rows.append((r["doc_id"], *_measured(r["n_bytes"], header(len(read)) + read, r["whole"])))
            yield _batch(rows, batch.schema.field("doc_id").type)

    alone = media.filter("size(shared) = 0").select("doc_id", "n_bytes", "whole", "own").mapInArrow(own, f"doc_id {kind}, {_RESULT}")
    mixed = media.filter("size(shared) > 0")
    wants = mixed.select("_row", F.explode(F.transform("shared", lambda k: F.struct(k.alias("k"), F.element_at("digests", k + 1).alias("digest")))).alias("w")).select("_row", "w.k", "w.digest")
    # a document's chunks at most come together
    lent = wants.join(store, "digest").groupBy("_row").agg(F.collect_list(F.struct("k", "data")).alias("lent"))
    joined = mixed.join(lent, "_row").select("doc_id", "n_bytes", "whole", "digests", "sizes", "own", "lent")
    return alone.unionByName(joined.mapInArrow(assembled, f"doc_id {kind}, {_RESULT}"))
