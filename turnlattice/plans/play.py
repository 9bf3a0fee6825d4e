"""Play of many games at once: each batch of games is one set of arrays in a task, one lane a game.

Random numbers depend on (seed, game, ..) only, so that no partitioning changes a game.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.functions.counters import XorShift, counter_array, counter_int_array
from turnlattice.functions.dice import BONUS, UPPER_GOAL
from turnlattice.plans import kernel

#: The policies and their random streams, the order of the fixed policy, the chance to reroll of the random one.
POLICIES = ["optimal", "one_turn", "greedy", "bonus_priority", "fixed_priority", "random"]
FIXED_ORDER = [14, 9, 11, 10, 12, 7, 8, 6, 5, 4, 3, 2, 1, 0, 13]
REROLL_CHANCE = 0.72
GAME = "game_index long, final_score int, upper_total int, bonus int, alike_rolls int, alike_score int, early_scores int, rerolls int, keeper_counts array<int>, category_scores array<int>, fill_turns array<int>, turn_scores array<int>, turn_uppers array<int>, turn_bonus array<int>"
LANES = 4000


class Table:
    """Where a batch of games stands."""

    def __init__(self, model: kernel.Tables, games: np.ndarray) -> None:
        n = len(games)
        self.model, self.games = model, games
        self.mask, self.upper, self.raw, self.total = (np.zeros(n, np.int64) for _ in range(4))
        self.bonus = np.zeros(n, bool)
        self.alike, self.early, self.rerolls = (np.zeros(n, np.int64) for _ in range(3))
        self.kept = np.zeros((n, 5), np.int64)
        self.scores, self.fills, self.sums, self.uppers, self.bonuses = (np.zeros((n, 15), np.int64) for _ in range(5))
        self.code = np.full(6**6, -1)
        powers = 6 ** np.arange(6)
        self.code[model.counts @ powers] = np.arange(252)
        self.powers = powers

    def roll_ids(self, counts: np.ndarray) -> np.ndarray:
        return self.code[counts @ self.powers]

    def score(self, lanes: np.ndarray, category: np.ndarray, roll: np.ndarray, turn: int) -> None:
        points = self.model.points[roll, category]
        self.scores[lanes, category] = points
        self.fills[lanes, category] = turn + 1
        self.total[lanes] += points
        up = category < 6
        self.raw[lanes] += np.where(up, points, 0)
        after = np.where(up, np.minimum(UPPER_GOAL, self.upper[lanes] + points), self.upper[lanes])
        grant = (self.upper[lanes] < UPPER_GOAL) & (after == UPPER_GOAL)
        self.total[lanes] += BONUS * grant
        self.bonus[lanes] |= grant
        self.upper[lanes] = after
        self.mask[lanes] |= 1 << category

    def rows(self) -> pa.RecordBatch:
        plain = [self.total, self.raw, self.bonus.astype(int), self.alike, self.scores[:, 14], self.early, self.rerolls]
        lists = [self.kept, self.scores, self.fills, self.sums, self.uppers, self.bonuses]
        columns = [pa.array(self.games, pa.int64()), *(pa.array(x, pa.int32()) for x in plain), *(pa.array(x.tolist(), pa.list_(pa.int32())) for x in lists)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in GAME.split(", ")])


def _multiples(counts: np.ndarray) -> np.ndarray:
    """What to keep: the face shown most often (the highest of equals) if at least twice, else fours, fives and sixes."""
    face = 5 - counts[:, ::-1].argmax(axis=1)
    most = counts.max(axis=1)
    keep = np.zeros_like(counts)
    lanes = np.arange(len(counts))
    keep[lanes, face] = most
    keep[most < 2] = 0
    return np.where((most < 2)[:, None] & (np.arange(6) >= 3), counts, keep)


def heuristic_keep(policy: str, mask: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The dice that a heuristic keeps while rerolls remain."""
    keep = _multiples(counts)
    if policy == "bonus_priority":
        wanted = ((mask[:, None] >> np.arange(6)) & 1 == 0) & (counts > 0)
        target = 5 - wanted[:, ::-1].argmax(axis=1)
        single = np.zeros_like(counts)
        lanes = np.arange(len(counts))
        single[lanes, target] = counts[lanes, target]
        keep = np.where(wanted.any(axis=1)[:, None], single, keep)
    return keep


def heuristic_category(policy: str, mask: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The category that a heuristic scores; the lowest of equals."""
    opened = (mask[:, None] >> np.arange(15)) & 1 == 0
    if policy == "bonus_priority":
        worth = points + np.where(np.arange(15) < 6, 8 + points * 0.35, 0)
        return np.where(opened, worth, -np.inf).argmax(axis=1)
    best = np.where(opened, points, -1).argmax(axis=1)
    if policy == "fixed_priority":
        ordered = (opened & (points > 0))[:, FIXED_ORDER]
        return np.where(ordered.any(axis=1), np.array(FIXED_ORDER)[ordered.argmax(axis=1)], best)
    return best


def _by_values(model: kernel.Tables, following: np.ndarray, mask: np.ndarray, upper: np.ndarray, roll: np.ndarray, rerolls: int) -> tuple[np.ndarray, np.ndarray]:
    """(category, keeper or -1) with the best value; scoring before rerolling, then the lowest id."""
    state, own = np.unique(mask * 64 + upper, return_inverse=True)
    category, keeper = np.empty(len(mask), np.int64), np.full(len(mask), -1)
    for at in range(0, len(state), kernel.CHUNK):
        m, u = state[at : at + kernel.CHUNK] // 64, state[at : at + kernel.CHUNK] % 64
        lanes = np.flatnonzero((own >= at) & (own < at + kernel.CHUNK))
        best, code = kernel.scored(model, following, m, u)
        column = own[lanes] - at
        category[lanes] = code[roll[lanes], column]
        if rerolls:
            kept = kernel.kept_values(model, best)
            if rerolls == 2:
                kept = kernel.kept_values(model, kernel.improved(model, best, code, kept, False)[0])
            for r in np.unique(roll[lanes]):
                some = lanes[roll[lanes] == r]
                ids = np.sort(model.legal[r])
                values = kept[ids][:, own[some] - at]
                better = values.max(axis=0) > best[r, own[some] - at]
                keeper[some] = np.where(better, ids[values.argmax(axis=0)], -1)
    return category, keeper


def play(model: kernel.Tables, policy: str, seed: int, games: np.ndarray, following: np.ndarray | None, shared: bool) -> Table:
    """Plays the games. `shared`: counter numbers by die slot, so that policies meet the same dice; else one xorshift a game."""
    table = Table(model, games)
    n = len(games)
    everyone = np.arange(n)
    ids = {tuple(c): i for i, c in enumerate(model.keeper_counts.tolist())}
    stream = POLICIES.index(policy) + 1
    generator = None if shared else XorShift(seed, games)
    drawn = np.zeros(n, np.int64)
    zero = np.zeros((1 << 15, 64)) if policy == "one_turn" else following

    def number(lanes: np.ndarray, k=None) -> np.ndarray:
        """A fraction, or an integer below k, for the random policy."""
        if not shared:
            return generator.floats(lanes) if k is None else generator.integers(k, lanes)
        at = drawn[lanes]
        drawn[lanes] += 1
        own = {"game": games[lanes], "turn": 0, "roll": at // 5, "slot": at % 5, "stream": stream}
        return counter_array(seed, **own) / float(1 << 32) if k is None else counter_int_array(seed, k, **own)

    for turn in range(15):
        slots = np.empty((n, 5), np.int64)
        for s in range(5):
            slots[:, s] = counter_int_array(seed, 6, game=games, turn=turn, roll=0, slot=s) if shared else generator.integers(6, everyone)
        active, rerolls, thrown = everyone, 2, 0
        while len(active):
            counts = (slots[active][:, :, None] == np.arange(6)).sum(axis=1)
            roll = table.roll_ids(counts)
            table.alike[active] += counts.max(axis=1) == 5
            points = model.points[roll]
            keep = np.full((len(active), 6), -1)
            if policy in ("optimal", "one_turn"):
                category, keeper = _by_values(model, zero, table.mask[active], table.upper[active], roll, rerolls)
                rerolling = keeper >= 0
                keep[rerolling] = model.keeper_counts[keeper[rerolling]]
            elif policy == "random":
                rerolling = number(active) < REROLL_CHANCE if rerolls else np.zeros(len(active), bool)
                if rerolling.any():
                    size = np.array([len(model.legal[r]) for r in roll[rerolling]])
                    chosen = number(active[rerolling], size)
                    keep[rerolling] = model.keeper_counts[[model.legal[r][k] for r, k in zip(roll[rerolling], chosen, strict=True)]]
                category = np.zeros(len(active), np.int64)
                scoring = np.flatnonzero(~rerolling)
                if len(scoring):
                    opened = (table.mask[active[scoring]][:, None] >> np.arange(15)) & 1 == 0
                    chosen = number(active[scoring], opened.sum(axis=1))
                    category[scoring] = (opened.cumsum(axis=1) <= chosen[:, None]).sum(axis=1)
            else:
                rerolling = np.full(len(active), rerolls > 0)
                keep = heuristic_keep(policy, table.mask[active], counts)
                category = heuristic_category(policy, table.mask[active], points)
            scoring = ~rerolling
            table.score(active[scoring], category[scoring], roll[scoring], turn)
            table.early[active[scoring]] += rerolls > 0
            active, keep = active[rerolling], keep[rerolling]
            if not len(active):
                break
            thrown += 1
            table.rerolls[active] += 1
            sizes = keep.sum(axis=1)
            small = sizes < 5
            table.kept[active[small], sizes[small]] += 1
            need = keep.copy()
            lanes = np.arange(len(active))
            if shared:
                for s in range(5):
                    face = slots[active, s]
                    stay = need[lanes, face] > 0
                    need[lanes, face] -= stay
                    fresh = counter_int_array(seed, 6, game=games[active], turn=turn, roll=thrown, slot=s)
                    slots[active, s] = np.where(stay, face, fresh)
            else:
                dice = np.zeros((len(active), 5), np.int64)
                place = np.zeros(len(active), np.int64)
                for face in range(6):
                    for _ in range(5):
                        some = need[:, face] > 0
                        dice[lanes[some], place[some]] = face
                        place[some] += 1
                        need[some, face] -= 1
                for s in range(5):
                    some = np.flatnonzero(place <= s)
                    if len(some):
                        dice[some, s] = generator.integers(6, active[some])
                slots[active] = dice
            rerolls -= 1
        table.sums[:, turn], table.uppers[:, turn], table.bonuses[:, turn] = table.total, np.minimum(105, table.raw), table.bonus
    return table


def simulate(spark: SparkSession, policy: str, games: int, seed: int, values: DataFrame | None = None, single_pair: bool = False, shared: bool = True) -> DataFrame:
    """Games 0 .. games - 1 under a policy, one row each (GAME). `values` (mask, upper, value) is needed by `optimal`.

    `shared`: all policies meet the same dice where they keep the same slots, so that games pair by game_index.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy: one of {POLICIES}")
    if policy == "optimal" and values is None:
        raise ValueError("the optimal policy needs the values of all states")
    model = spark.sparkContext.broadcast(kernel.tables(spark, single_pair))
    # 16 MiB, fixed by the model
    given = spark.sparkContext.broadcast(kernel.dense(values.select("mask", "upper", "value").toPandas(), "value") if policy == "optimal" else None)

    def played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column("id").to_numpy()
            for at in range(0, len(index), LANES):
                yield play(model.value, policy, seed, index[at : at + LANES], given.value, shared).rows()

    return spark.range(games).mapInArrow(played, GAME).withColumn("policy", F.lit(policy))
