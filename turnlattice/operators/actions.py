"""Relational backup of a turn, ranked actions, margins and tie classes, for any set of states.

The relational form is for some states (4116 keeper rows and 4368 outcome rows for each state and stage); plans.kernel does
the same for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlattice.operators import universe
from turnlattice.operators.states import successors

STATE = ["mask", "upper"]
TOLERANCE = 1e-8


@dataclass
class Turn:
    """score: value by category; best, one, two: by roll with 0, 1, 2 rerolls left; keep_one, keep_two: by keeper; value: by state."""

    score: DataFrame
    best: DataFrame
    keep_one: DataFrame
    one: DataFrame
    keep_two: DataFrame
    value: DataFrame


def turn(spark: SparkSession, states: DataFrame, following: DataFrame | None = None, single_pair: bool = False) -> Turn:
    """The turn of each of `states` (mask, upper); `following` (mask, upper, value) is what comes after, 0 if there is none."""
    scores, legal = universe.wide_scores(spark, single_pair), universe.legal(spark).select("roll_id", "keeper_id")
    reaches = universe.reaches(spark)
    opened = successors(states.select(*STATE).crossJoin(F.broadcast(scores.drop("multiplicity"))))
    if following is None:
        opened = opened.withColumn("after", F.lit(0.0))
    else:
        then = following.select(F.col("mask").alias("next_mask"), F.col("upper").alias("next_upper"), F.col("value").alias("after"))
        opened = opened.join(then, ["next_mask", "next_upper"], "left").withColumn("after", F.coalesce("after", F.lit(0.0)))
    score = opened.select(*STATE, "roll_id", "category", "points", "bonus", (F.col("points") + F.col("bonus") + F.col("after")).alias("value"))
    best = score.groupBy(*STATE, "roll_id").agg(F.max("value").alias("value"))

    def kept(by_roll: DataFrame) -> DataFrame:
        return by_roll.join(F.broadcast(reaches), "roll_id").groupBy(*STATE, "keeper_id").agg(F.sum(F.col("p") * F.col("value")).alias("value"))

    def better(keep: DataFrame) -> DataFrame:
        offers = keep.join(F.broadcast(legal), "keeper_id").select(*STATE, "roll_id", "value")
        return best.unionByName(offers).groupBy(*STATE, "roll_id").agg(F.max("value").alias("value"))

    keep_one = kept(best)
    one = better(keep_one)
    keep_two = kept(one)
    two = better(keep_two)
    chances = universe.rolls(spark).select("roll_id", "multiplicity")
    value = two.join(F.broadcast(chances), "roll_id").groupBy(*STATE).agg((F.sum(F.col("multiplicity") * F.col("value")) / 7776).alias("value"))
    return Turn(score, best, keep_one, one, keep_two, value)


def actions(spark: SparkSession, t: Turn, digits: int = 9) -> DataFrame:
    """All actions: mask, upper, roll_id, rerolls, kind (0 score, 1 reroll), id, value (rounded, so that ties are ties)."""
    legal = universe.legal(spark).select("roll_id", "keeper_id")
    value = F.round("value", digits).alias("value")
    scored = t.score.withColumn("rerolls", F.explode(F.array(*map(F.lit, (0, 1, 2))))).select(*STATE, "roll_id", "rerolls", F.lit(0).alias("kind"), F.col("category").alias("id"), value)
    for n, keep in ((1, t.keep_one), (2, t.keep_two)):
        scored = scored.unionByName(keep.join(F.broadcast(legal), "keeper_id").select(*STATE, "roll_id", F.lit(n).alias("rerolls"), F.lit(1).alias("kind"), F.col("keeper_id").alias("id"), value))
    return scored


def ranked(frame: DataFrame, k: int = 30) -> DataFrame:
    """The k best actions of each position: by value, scoring before rerolling, then the lowest id."""
    order = Window.partitionBy(*STATE, "roll_id", "rerolls").orderBy(F.desc("value"), "kind", "id")
    return frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def margins(frame: DataFrame) -> DataFrame:
    """Of each position: n_actions, the best and the second value, their margin (0 if forced), and the advantage of rerolling."""
    top = F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, 2)  # a position has at most 15 + 32 actions
    out = frame.groupBy(*STATE, "roll_id", "rerolls").agg(F.count("*").alias("n_actions"), top.alias("_top"), F.max(F.when(F.col("kind") == 0, F.col("value"))).alias("_score"), F.max(F.when(F.col("kind") == 1, F.col("value"))).alias("_reroll"))
    best = F.col("_top")[0]
    return out.select(*STATE, "roll_id", "rerolls", "n_actions", best.alias("best"), (best - F.coalesce(F.get("_top", F.lit(1)), best)).alias("margin"), (F.col("_reroll") - F.col("_score")).alias("reroll_advantage"))


def tie_class(n_actions: Column, best: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> Column:
    """From (value, lower, upper) of the two best actions; the classes are tested in this order."""
    same = (best[0] == second[0]) & (best[1] == second[1]) & (best[2] == second[2])
    overlap = (best[1] <= second[2]) & (second[1] <= best[2])
    return F.when(n_actions == 1, "forced_action").when(same, "certified_interval_tie").when(overlap, "numerically_unresolved_overlap").when(best[0] - second[0] <= TOLERANCE, "tolerance_near_tie").otherwise("certified_order")
