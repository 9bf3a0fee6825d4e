"""Content-defined chunks by a rolling gear hash, and the set of chunks that occur more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlattice.llm.common import FEW, alone, written

LEAST, MEAN_BITS, MOST = 512, 11, 8192
#: Bloom filters that are broadcast have this many bits for each key, between these bounds (8 KiB and 16 MiB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes, characters: bool = False) -> list[int]:
    """The ends of the chunks of `data`: where the gear hash of the 32 bytes before has MEAN_BITS leading zeros.

    Chunks have LEAST bytes (but the last) to MOST. `characters`: never within a UTF-8 character.
    """
    ends, size = [], len(data)
    if size > LEAST:
        octets = np.frombuffer(data, np.uint8)
        rolled = _GEAR[octets]
        for k in (1, 2, 4, 8, 16):  # h(i) = sum of gear(i - j) << j for j < 32
            rolled[k:] = rolled[k:] + (rolled[:-k] << np.uint32(k))
        at = 0
        for end in [*(np.flatnonzero(rolled < np.uint32(1 << (32 - MEAN_BITS))) + 1).tolist(), size]:
            while end - at > MOST:
                at = _boundary(data, at + MOST) if characters else at + MOST
                ends.append(at)
            if end - at >= LEAST and end < size:
                end = _boundary(data, end) if characters else end
                at = end
                ends.append(end)
    if not ends or ends[-1] < size:
        ends.append(size)
    return ends


def _boundary(data: bytes, at: int) -> int:
    while at < len(data) and 0x80 <= data[at] < 0xC0:
        at += 1
    return at


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def shared_digests(frame: DataFrame, characters: bool = False) -> DataFrame:
    """The digests of the chunks that occur more than once in the binary column `data` of all rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, column = [], batch.column("data")
            for i in range(batch.num_rows):
                data, at = column[i].as_py(), 0
                for end in cuts(data, characters):
                    out.append(digest(data[at:end]))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])

    return frame.select("data").mapInArrow(found, "digest binary").groupBy("digest").count().filter("count > 1").select("digest")


def shared_filter(frame: DataFrame, characters: bool = False) -> np.ndarray:
    """A Bloom filter of those chunks."""

    def longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys(batch.column("digest").to_pylist()))], ["key"])

    return membership(written(shared_digests(frame, characters).mapInArrow(longs, "key long")))


def keys(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest as a long."""
    return np.frombuffer(b"".join(digests), np.int64)[::2]


def filter_bits(n: int) -> int:
    """The size of a Bloom filter of `n` keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n - 1).bit_length()))


def membership(longs: DataFrame, n: int | None = None) -> np.ndarray:
    """A Bloom filter over the hashes in a one-column frame of longs, which is read twice, as 64-bit words; `n`: their count, if known.

    Words are merged by aggregation, so that the driver gets 2^21 numbers at most. What it holds by mistake is only looked at
    once more, which changes no result; beyond 2^23 keys that happens ever more often.
    """
    n = longs.count() if n is None else n
    bits = filter_bits(n)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array((np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64))], ["word", "mask"])

    merged = alone(longs, n <= FEW).mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[merged.column("word").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
    return table


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.stack([h, h >> np.uint64(12), h >> np.uint64(24)], axis=1).astype(np.uint64).view(np.int64) & (bits - 1)


def broadcast_filter(longs: DataFrame, n: int | None = None):
    return longs.sparkSession.sparkContext.broadcast(membership(longs, n))


def bounded_filter(longs: DataFrame):
    """A broadcast filter of a written table of longs; None where there are too many for its size."""
    n = longs.count()
    return broadcast_filter(longs, n) if BITS_A_KEY * n <= MOST_BITS else None


def within(frame: DataFrame, column: str, longs: DataFrame) -> DataFrame:
    """The rows of `frame` whose long `column` stands in the one column of `longs`, a written table; and maybe a few more.

    By a broadcast filter as long as its size is bounded, else by a join.
    """
    table = bounded_filter(longs)
    if table is None:
        return frame.join(longs.toDF(column), column, "left_semi").select(*frame.columns)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(members(table.value, batch.column(column).to_numpy())))

    return frame.mapInArrow(held, frame.schema)


def members(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, if the filter holds it."""
    places = _places(np.ascontiguousarray(hashes, np.int64), 64 * len(table))
    return ((table[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
