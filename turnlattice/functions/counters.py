"""Counter-based random numbers: pure functions of (seed, game, turn, roll, slot, stream, attempt), so that no partitioning
changes them. Once as columns, once on numpy arrays for use in tasks."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the generator: the multipliers of its six counters, and of the mixer.
COUNTERS = {"game": 0x9E3779B1, "turn": 0x85EBCA77, "roll": 0xC2B2AE3D, "slot": 0x27D4EB2F, "stream": 0x165667B1, "attempt": 0xD3A2646C}
MIX = (0x7FEB352D, 0x846CA68B)
#: Fixed values of the 32-bit seed splitter: its step, and its mixer.
SPLIT, SPLIT_MIX, GAME_STEP = 0x9E3779B9, (0x21F0AAAD, 0x735A2D97), 0x85EBCA6B
_32 = 0xFFFFFFFF


def seed64(namespace: str) -> int:
    """The first eight bytes of the name's SHA-256, little-endian."""
    return int.from_bytes(hashlib.sha256(namespace.encode()).digest()[:8], "little")


def times32(a: Column, b: int) -> Column:
    """a * b modulo 2^32 for 0 <= a < 2^32, without leaving BIGINT."""
    return (((a.bitwiseAND(65535)) * F.lit(b)) + F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(65535), 16)).bitwiseAND(F.lit(_32))


def _step(frame: DataFrame, **columns: Column) -> DataFrame:
    return frame.withColumns(columns)


def _mixed(frame: DataFrame, x: Column, mixer: tuple[int, int], shifts: tuple[int, int, int]) -> DataFrame:
    """Column _x: a mixed. Each step is a projection of its own, as its input is used more than once."""
    frame = _step(frame, _x=x)
    frame = _step(frame, _x=F.col("_x").bitwiseXOR(F.shiftright("_x", shifts[0])))
    frame = _step(frame, _x=times32(F.col("_x"), mixer[0]))
    frame = _step(frame, _x=F.col("_x").bitwiseXOR(F.shiftright("_x", shifts[1])))
    frame = _step(frame, _x=times32(F.col("_x"), mixer[1]))
    return _step(frame, _x=F.col("_x").bitwiseXOR(F.shiftright("_x", shifts[2])))


def counter_uint(frame: DataFrame, seed: int, to: str, only: Column | None = None, **counters: Column | int) -> DataFrame:
    """Adds `to`: the 32-bit number (as BIGINT) at the given counters; those not given are 0. Null where `only` doesn't hold."""
    low, high = seed & _32, (seed >> 32) & _32
    for i, (name, multiplier) in enumerate(COUNTERS.items()):
        at = counters.get(name, 0)
        if isinstance(at, int):
            own = F.lit((at + 1) * multiplier & _32).cast("long")
        else:
            own = times32((at.cast("long") + 1).bitwiseAND(F.lit(_32)), multiplier)
        x = own.bitwiseXOR(F.lit(low).cast("long")) if i == 0 else F.col("_x").bitwiseXOR(own)
        x = F.when(only, x) if i == 0 and only is not None else x
        frame = _mixed(frame, x.bitwiseXOR(F.lit(high).cast("long")) if i == 1 else x, MIX, (16, 15, 16))
    return frame.withColumn(to, F.col("_x")).drop("_x")


def potential_die(frame: DataFrame, seed: int, to: str, **counters: Column | int) -> DataFrame:
    """Adds `to`: a face from 1 to 6. Numbers from 6 * floor(2^32 / 6) on are rejected for the next of three attempts."""
    limit = (1 << 32) // 6 * 6
    frame = counter_uint(frame, seed, "_u0", attempt=0, **counters)
    for k in (1, 2):
        frame = counter_uint(frame, seed, f"_u{k}", only=F.col(f"_u{k - 1}") >= limit, attempt=k, **counters)
    used = F.when(F.col("_u0") < limit, F.col("_u0")).when(F.col("_u1") < limit, F.col("_u1")).otherwise(F.col("_u2"))
    return frame.withColumn(to, (used % 6 + 1).cast("int")).drop("_u0", "_u1", "_u2")


def game_seeds(frame: DataFrame, base: int, game: str) -> DataFrame:
    """Adds seed_a and seed_b: the two 32-bit seeds of a game."""
    low, high = base & _32, (base >> 32) & _32

    def split(frame: DataFrame, x: Column, to: str) -> DataFrame:
        frame = _mixed(frame, (x + SPLIT).bitwiseAND(F.lit(_32)), SPLIT_MIX, (16, 15, 15))
        return frame.withColumn(to, F.col("_x")).drop("_x")

    frame = split(frame, F.col(game).cast("long").bitwiseXOR(F.lit(low).cast("long")), "seed_a")
    return split(frame, times32(F.col(game).cast("long"), GAME_STEP).bitwiseXOR(F.lit(high).cast("long")), "seed_b")


def _mix_array(x: np.ndarray) -> np.ndarray:
    """Of numbers of 32 bits, whose products wrap around."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[0])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def _counter32(seed: int, **counters) -> np.ndarray:
    """The numbers of `counter_uint` in 32 bits. Counters broadcast; a step has the shape of the counters so far, no more."""
    x = np.full((1,) * max((np.ndim(c) for c in counters.values()), default=0) or (1,), seed & _32, np.uint32)
    for i, (name, multiplier) in enumerate(COUNTERS.items()):
        at = ((np.asarray(counters.get(name, 0)).astype(np.uint64) + np.uint64(1)) & np.uint64(_32)).astype(np.uint32)
        x = x ^ (np.atleast_1d(at) * np.uint32(multiplier))
        x = _mix_array(x ^ np.uint32((seed >> 32) & _32) if i == 1 else x)
    return x if any(np.ndim(c) for c in counters.values()) else x.reshape(())


def counter_array(seed: int, **counters) -> np.ndarray:
    """The same numbers as `counter_uint`, on arrays."""
    return _counter32(seed, **counters).astype(np.uint64)


def counter_int_array(seed: int, n, **counters) -> np.ndarray:
    """Numbers from 0 to n - 1, by rejection; n may be an array."""
    limit = (np.uint64(1 << 32) // np.asarray(n, np.uint64)) * np.asarray(n, np.uint64)
    attempt, x = 1, _counter32(seed, **counters)
    while (bad := x > (limit - np.uint64(1)).astype(np.uint32)).any():
        x = np.where(bad, _counter32(seed, **counters, attempt=attempt), x)
        attempt += 1
    return (x % np.asarray(n, np.uint32)).astype(np.int64)


class XorShift:
    """One xorshift generator a lane, seeded by (base, game index)."""

    def __init__(self, base: int, games: np.ndarray) -> None:
        games = games.astype(np.uint64) & np.uint64(_32)
        a = self._split(np.uint64(base & _32) ^ games)
        b = self._split(np.uint64((base >> 32) & _32) ^ ((games * np.uint64(GAME_STEP)) & np.uint64(_32)))
        #: Fixed values that stand in for zero words, and that derive the other two words.
        other = [self._split(a ^ np.uint64(0xA5A5A5A5)), self._split(b ^ np.uint64(0x5A5A5A5A))]
        words = zip([a, b, *other], (0x12345678, 0x9ABCDEF0, 0x6C8E9CF5, 0xDA3E39CB), strict=True)
        self.words = [np.where(w == 0, np.uint64(d), w) for w, d in words]

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        z = (x + np.uint64(SPLIT)) & np.uint64(_32)
        z = ((z ^ (z >> np.uint64(16))) * np.uint64(SPLIT_MIX[0])) & np.uint64(_32)
        z = ((z ^ (z >> np.uint64(15))) * np.uint64(SPLIT_MIX[1])) & np.uint64(_32)
        return z ^ (z >> np.uint64(15))

    def uint(self, lanes: np.ndarray) -> np.ndarray:
        """The next number of these lanes."""
        a, b, c, d = (w[lanes] for w in self.words)
        t = (a ^ (a << np.uint64(11))) & np.uint64(_32)
        new = d ^ (d >> np.uint64(19)) ^ t ^ (t >> np.uint64(8))
        for w, v in zip(self.words, (b, c, d, new), strict=True):
            w[lanes] = v
        return new

    def integers(self, n, lanes: np.ndarray) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, np.uint64), lanes.shape)
        limit = (np.uint64(1 << 32) // n) * n
        x = self.uint(lanes)
        while (bad := x >= limit).any():
            x[bad] = self.uint(lanes[bad])
        return (x % n).astype(np.int64)

    def floats(self, lanes: np.ndarray) -> np.ndarray:
        return self.uint(lanes) / float(1 << 32)
