"""Answers for any table of positions on a solved table of values: every legal action with its value, bounds and rank.

The solved values and bounds are dense arrays of 16 MiB each, fixed by the model, and are broadcast once; positions are a
distributed table of any size, and tasks answer them in Arrow batches by the same kernel as the solve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlattice.operators import universe
from turnlattice.operators.selection import even_sample
from turnlattice.plans import kernel

SCHEMA = "mask int, upper int, roll_id int, rerolls int, action int, size int, value double, lower double, upper_bound double"
#: Actions from here on are keepers: KEEP + keeper_id; those below are categories.
KEEP = 16


class Solved:
    """The dense value and bound arrays of a solved table, and the model tables, as one broadcast."""

    def __init__(self, spark: SparkSession, solved: DataFrame, single_pair: bool = False) -> None:
        rows = solved.select("mask", "upper", "value", "lower", "upper_bound").toPandas()  # 1,430,528 rows at most
        self.spark = spark
        self.shared = spark.sparkContext.broadcast((kernel.tables(spark, single_pair), [kernel.dense(rows, c) for c in ("value", "lower", "upper_bound")]))


def _state(t: kernel.Tables, tables: list[np.ndarray], mask: int, upper: int) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Open categories; [table, category, roll] scoring now; by rerolls left 1 and 2: [table, keeper]."""
    one = np.array([mask]), np.array([upper])
    opened = [c for c in range(15) if not mask >> c & 1]
    score = np.empty((len(tables), len(opened), 252))
    for k, following in enumerate(tables):
        for i, c in enumerate(opened):
            points = t.points[:, c]
            after = np.minimum(63, upper + points) if c < 6 else np.full(252, upper)
            grant = np.where((upper < 63) & (after == 63), 50, 0) if c < 6 else 0
            score[k, i] = points + grant + following[mask | 1 << c, after]
    kept = []
    best = [kernel.scored(t, following, *one)[0] for following in tables]
    for _ in range(2):
        values = [kernel.kept_values(t, b) for b in best]
        kept.append(np.stack([v[:, 0] for v in values]))
        best = [kernel.improved(t, kernel.scored(t, following, *one)[0], np.zeros((252, 1), np.uint8), v, False)[0] for following, v in zip(tables, values, strict=True)]
    return opened, score, kept


def actions(positions: DataFrame, solved: Solved) -> DataFrame:
    """One row for each position (mask, upper, roll_id, rerolls) and legal action, by SCHEMA. Positions of a game that has ended have none."""
    shared = solved.shared

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, tables = shared.value
        memo: dict = {}
        for batch in batches:
            masks, uppers, rolls, left = (batch.column(c).to_pylist() for c in ("mask", "upper", "roll_id", "rerolls"))
            found: list[list[np.ndarray]] = [[] for _ in range(9)]
            for mask, upper, roll, rerolls in zip(masks, uppers, rolls, left, strict=True):
                if (mask, upper) not in memo:
                    if len(memo) > 2000:
                        memo.clear()
                    memo[mask, upper] = _state(t, tables, mask, upper)
                opened, score, kept = memo[mask, upper]
                ids, sizes, values = np.array(opened, np.int32), np.full(len(opened), -1, np.int32), score[:, :, roll]
                if rerolls and opened:
                    own = t.legal[roll]
                    ids = np.concatenate([ids, KEEP + own]).astype(np.int32)
                    sizes = np.concatenate([sizes, t.sizes[own]]).astype(np.int32)
                    values = np.concatenate([values, kept[rerolls - 1][:, own]], axis=1)
                fixed = [np.full(len(ids), x, np.int32) for x in (mask, upper, roll, rerolls)]
                for column, part in zip(found, [*fixed, ids, sizes, *values], strict=True):
                    column.append(part)
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int32() if i < 6 else pa.float64()) for i, c in enumerate(found)]
            yield pa.RecordBatch.from_arrays(columns, ["mask", "upper", "roll_id", "rerolls", "action", "size", "value", "lower", "upper_bound"])

    return positions.select(*[F.col(c).cast("int").alias(c) for c in ("mask", "upper", "roll_id", "rerolls")]).mapInArrow(answered, SCHEMA)


def ranked(rows: DataFrame) -> DataFrame:
    """`actions` with rank (1 is best; of equal values the lower action) and regret against the best."""
    order = Window.partitionBy("mask", "upper", "roll_id", "rerolls").orderBy(F.desc("value"), "action")
    return rows.withColumns({"rank": F.row_number().over(order), "regret": F.max("value").over(order) - F.col("value")})


def margins(rows: DataFrame) -> DataFrame:
    """One row for each position of `actions`: the best action, its size, value and margin over the second, and if bounds part them."""
    best = F.max(F.struct("value", (-F.col("action")).alias("a"), "size", "lower"))
    top = rows.groupBy("mask", "upper", "roll_id", "rerolls").agg(best.alias("b"), F.slice(F.sort_array(F.collect_list(F.struct("value", "upper_bound")), asc=False), 1, 2).alias("two"), F.count("*").alias("actions"))
    second = F.try_element_at("two", F.lit(2))
    return top.select("mask", "upper", "roll_id", "rerolls", (-F.col("b.a")).alias("action"), "b.size", "b.value", (F.col("b.value") - second["value"]).alias("margin"), (F.col("b.lower") > second["upper_bound"]).alias("parted"), "actions")


#: States that are worked out at a time.
STATES = 256


def _told(t: kernel.Tables, tables: list[np.ndarray], padded: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """What `decided` tells of positions (mask, upper, roll_id, rerolls a row): each of their states is worked out once, all together."""
    mask, upper, roll, rerolls = keys.T
    states, own = np.unique(mask << 6 | upper, return_inverse=True)
    state_mask, state_upper = states >> 6, states & 63
    values = np.full((len(tables), len(keys), 15 + padded.shape[1]), -np.inf)
    for k, following in enumerate(tables):
        for c in range(15):
            at = np.flatnonzero(mask >> c & 1 == 0)
            points, u = t.points[roll[at], c], upper[at]
            after = np.minimum(63, u + points) if c < 6 else u
            grant = np.where((u < 63) & (after == 63), 50, 0) if c < 6 else 0
            values[k, at, c] = points + grant + following[mask[at] | 1 << c, after]
        best, code = kernel.scored(t, following, state_mask, state_upper)
        kept = kernel.kept_values(t, best)
        for left in (1, 2):
            if left == 2:
                kept = kernel.kept_values(t, kernel.improved(t, best, code, kept, False)[0])
            at = np.flatnonzero(rerolls == left)
            values[k, at, 15:] = np.where(padded[roll[at]] >= 0, kept[padded[roll[at]], own[at][:, None]], -np.inf)
    rows = np.arange(len(keys))
    middle = values[0].copy()
    first = middle.argmax(axis=1)  # of equal values the lower action
    keeper = padded[roll, np.maximum(first - 15, 0)]
    action, size = np.where(first < 15, first, KEEP + keeper), np.where(first < 15, -1, t.sizes[keeper])
    middle[rows, first] = -np.inf
    second = middle.argmax(axis=1)
    other = np.where(np.isfinite(middle[rows, second]), values[:, rows, second], np.nan)
    again = np.where(rerolls > 0, values[0][:, 15:].max(axis=1), np.nan)
    return [action, size, *values[:, rows, first], *other, values[0][:, :15].max(axis=1), again, np.isfinite(values[0]).sum(axis=1)]


DECIDED = "mask int, upper int, roll_id int, rerolls int, action int, size int, value double, lower double, upper_bound double, second double, second_lower double, second_upper double, score_value double, reroll_value double, actions int"


def decided(positions: DataFrame, solved: Solved) -> DataFrame:
    """One row for each position (mask, upper, roll_id, rerolls) of a game that goes on, by DECIDED.

    The best action with value and bounds, those of the second (null if there is none), the best values of scoring and of
    keeping (null without rerolls) and the number of actions. A task answers whole positions: nothing is shuffled.
    """
    shared = solved.shared
    names = [c.split(" ")[0] for c in DECIDED.split(", ")]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, tables = shared.value
        padded = np.full((252, max(map(len, t.legal))), -1, np.int32)
        for roll, own in enumerate(t.legal):
            padded[roll, : len(own)] = own
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in names[:4]], axis=1).astype(np.int64)
            keys = keys[keys[:, 0] != (1 << 15) - 1]
            keys = keys[np.lexsort(keys.T[[3, 1, 0]])]
            fresh = np.flatnonzero(np.append(True, (np.diff(keys[:, :2], axis=0) != 0).any(axis=1))) if len(keys) else np.zeros(0, int)
            edges = [*fresh[::STATES].tolist(), len(keys)]
            parts = [_told(t, tables, padded, keys[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            told = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(11)]
            columns = [pa.array(keys[:, i].astype(np.int32)) for i in range(4)]
            columns += [pa.array(c.astype(np.int32)) if i in (0, 1, 10) else pa.array(c, pa.float64(), from_pandas=True) for i, c in enumerate(told)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return positions.select(*[F.col(c).cast("int").alias(c) for c in names[:4]]).mapInArrow(answered, DECIDED)


POSITION = ["mask", "upper", "roll_id", "rerolls"]


def answered(frame: DataFrame, solved: Solved) -> DataFrame:
    """`frame`, any table with the columns of POSITION, with those that `decided` adds; each different position is worked out once.

    Positions of one state go to one task and follow each other there, so that a state is worked out once, too (twice where a
    batch ends), however many positions ask for it. Rows of games that have ended are left out.
    """
    asked = frame.select(*[F.col(c).cast("int").alias(c) for c in POSITION]).distinct()
    asked = asked.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mask", "upper").sortWithinPartitions("mask", "upper")
    return frame.join(decided(asked, solved), POSITION)


def even_states(states: DataFrame, n: int = 32) -> DataFrame:
    """At most `n` evenly spaced states (mask, upper, layer) of each layer below the last, with the states that each stands for.

    In order of state_index, the places floor(i (len - 1) / (n - 1)): the first and the last state of a layer are always in.
    """
    below = states.filter("layer < 15").select("mask", "upper", "layer", "state_index")
    sizes = below.groupBy("layer").agg(F.count("*").alias("_n"))  # fifteen rows
    chosen = even_sample(below, "state_index", n, "layer").join(F.broadcast(sizes), "layer")
    return chosen.select("mask", "upper", "layer", "state_index", (F.col("_n") / F.least(F.lit(n), F.col("_n"))).alias("weight"))


def all_positions(spark: SparkSession, states: DataFrame) -> DataFrame:
    """Every roll with 0, 1 and 2 rerolls left at each of `states`."""
    # 252 rows by 3, whatever the states
    rolls = universe.wide_scores(spark).select("roll_id", "multiplicity").crossJoin(spark.range(3).select(F.col("id").cast("int").alias("rerolls")))
    return states.crossJoin(F.broadcast(rolls))
