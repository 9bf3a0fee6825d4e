"""The vectorised backup of one turn: numpy arrays in a task, one column a state, in a fixed order of operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from turnlattice.functions.dice import BONUS, COUNTS, UPPER_GOAL
from turnlattice.operators import universe

CHUNK = 1500


@dataclass
class Tables:
    """The universe as arrays of fixed size; legal[r] are the keepers of roll r in order, ids sorted in legal_by_id."""

    points: np.ndarray
    multiplicity: np.ndarray
    children: np.ndarray
    sizes: np.ndarray
    legal: list[np.ndarray]
    counts: np.ndarray
    keeper_counts: np.ndarray


def tables(spark: SparkSession, single_pair: bool = False) -> Tables:
    """Collects the model tables: 462, 252, 1260 and 4116 rows."""
    wide = universe.wide_scores(spark, single_pair).orderBy("roll_id").toPandas()
    edges = universe.children(spark).orderBy("keeper_id", "face").toPandas()
    kept = universe.keepers(spark).orderBy("keeper_id").toPandas()
    legal = universe.legal(spark).orderBy("roll_id", "ord").toPandas()
    return Tables(
        wide[[f"s{c}" for c in range(15)]].to_numpy(np.int64),
        wide["multiplicity"].to_numpy(np.int64),
        edges["child_id"].to_numpy(np.int64).reshape(-1, 6),
        kept["size"].to_numpy(np.int64),
        [g.to_numpy(np.int64) for _, g in legal.groupby("roll_id")["keeper_id"]],
        wide[COUNTS].to_numpy(np.int64),
        kept[COUNTS].to_numpy(np.int64),
    )


def kept_values(t: Tables, by_roll: np.ndarray) -> np.ndarray:
    """Expected value of each keeper when all missing dice are thrown: [462, states] from [252, states]."""
    out = np.empty((462, by_roll.shape[1]))
    out[universe.FIRST_ROLL :] = by_roll
    for size in range(4, -1, -1):
        ids = np.flatnonzero(t.sizes == size)
        nodes = t.children[ids]
        total = out[nodes[:, 0]]
        for face in range(1, 6):
            total = total + out[nodes[:, face]]
        out[ids] = total / 6
    return out


def scored(t: Tables, following: np.ndarray, mask: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value of scoring now, and its category (the lowest of equals): [252, states]. following: [mask, upper]."""
    best = np.full((252, len(mask)), -np.inf)
    code = np.zeros((252, len(mask)), np.uint8)
    for c in range(15):
        own = np.flatnonzero((mask >> c) & 1 == 0)
        if not len(own):
            continue
        points, u = t.points[:, c : c + 1], upper[own][None, :]
        after = np.minimum(UPPER_GOAL, u + points) if c < 6 else np.broadcast_to(u, (252, len(own)))
        grant = np.where((u < UPPER_GOAL) & (after == UPPER_GOAL), BONUS, 0) if c < 6 else 0
        value = (points + grant) + following[(mask[own] | 1 << c)[None, :], after]
        higher = value > best[:, own]
        best[:, own] = np.where(higher, value, best[:, own])
        code[:, own] = np.where(higher, c, code[:, own])
    return best, code


def improved(t: Tables, best: np.ndarray, code: np.ndarray, kept: np.ndarray, policy: bool) -> tuple[np.ndarray, np.ndarray]:
    """The better of scoring and the best keeper; codes 16 + k name the k-th legal keeper (the first of equals)."""
    out, codes = np.empty_like(best), code.copy() if policy else code
    for r, own in enumerate(t.legal):
        values = kept[own]
        top = values.max(axis=0)
        out[r] = np.maximum(best[r], top)
        if policy:
            codes[r] = np.where(top > best[r], 16 + values.argmax(axis=0), code[r])
    return out, codes


def backup(t: Tables, following: np.ndarray, mask: np.ndarray, upper: np.ndarray, policy: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Value of each state before its turn, and its 756 policy codes if asked for."""
    values, codes = np.empty(len(mask)), np.empty((len(mask), 756), np.uint8) if policy else None
    for at in range(0, len(mask), CHUNK):
        own = slice(at, at + CHUNK)
        best, code = scored(t, following, mask[own], upper[own])
        one, code1 = improved(t, best, code, kept_values(t, best), policy)
        two, code2 = improved(t, best, code, kept_values(t, one), policy)
        total = t.multiplicity[0] * two[0]
        for r in range(1, 252):
            total = total + t.multiplicity[r] * two[r]
        values[own] = total / 7776
        if policy:
            codes[own] = np.concatenate([code, code1, code2]).T
    return values, codes


def envelope(values: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound: an allowance by the categories left, one step outward; of the end exactly 0."""
    left = 15 - np.array([int(m).bit_count() for m in mask])
    allowance = np.maximum(1e-12, (left + 1) * 1e-6)
    low, high = np.nextafter(values - allowance, -np.inf), np.nextafter(values + allowance, np.inf)
    return np.where(left == 0, 0.0, low), np.where(left == 0, 0.0, high)


def dense(rows, column: str) -> np.ndarray:
    """A pandas frame of (mask, upper, column) as [32768, 64], NaN elsewhere: 16 MiB whatever it holds."""
    out = np.full((1 << 15, 64), np.nan)
    out[rows["mask"].to_numpy(), rows["upper"].to_numpy()] = rows[column].to_numpy()
    return out
