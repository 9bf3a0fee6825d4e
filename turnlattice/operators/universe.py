"""The dice universe as small tables of fixed size: multisets, children, legal keepers, outcomes, probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlattice.functions.dice import COUNTS, score, score_by

#: The first keeper of five dice: rolls are those keepers in the same order.
FIRST_ROLL = 210


def keepers(spark: SparkSession) -> DataFrame:
    """All 462 multisets of up to five dice: keeper_id (by size, then counts), n1 .. n6, size.

    Counts are unfolded from one row, each as far as five dice go, so that one task makes them all and nothing is shuffled.
    """
    grid, left = spark.range(0, 1, 1, 1).select(F.lit(5).alias("left")), F.col("left")
    for i, c in enumerate(COUNTS):
        grid = grid.select(*COUNTS[:i], "left", F.explode(F.sequence(F.lit(0), left)).alias(c)).select(*COUNTS[: i + 1], (left - F.col(c)).alias("left"))
    sized = grid.select(*COUNTS, (F.lit(5) - left).alias("size"))
    return sized.withColumn("keeper_id", F.row_number().over(Window.orderBy("size", *COUNTS)) - 1)


def rolls(spark: SparkSession) -> DataFrame:
    """All 252 rolls: roll_id, n1 .. n6, multiplicity (ordered dice that give it, of 7776)."""
    ways = reduce(lambda a, b: a * b, [F.factorial(c) for c in COUNTS])
    return keepers(spark).filter("size = 5").select((F.col("keeper_id") - FIRST_ROLL).alias("roll_id"), *COUNTS, (F.lit(120) / ways).cast("int").alias("multiplicity"))


def children(spark: SparkSession) -> DataFrame:
    """Edges of the keeper lattice: keeper_id, face (0 to 5), child_id (the keeper with one die more)."""
    all_keepers = keepers(spark)
    wider = all_keepers.filter("size < 5").withColumn("face", F.explode(F.sequence(F.lit(0), F.lit(5))))
    wider = wider.select("keeper_id", "face", *[(F.col(c) + F.when(F.col("face") == i, 1).otherwise(0)).alias(c) for i, c in enumerate(COUNTS)])
    return wider.join(F.broadcast(all_keepers.select(*COUNTS, F.col("keeper_id").alias("child_id"))), COUNTS).select("keeper_id", "face", "child_id")


def legal(spark: SparkSession) -> DataFrame:
    """What may be kept of a roll: roll_id, ord (0, 1, .. by counts), keeper_id, size; four dice at most."""
    kept = keepers(spark).filter("size <= 4").select("keeper_id", "size", *[F.col(c).alias(f"k{c}") for c in COUNTS])
    within = reduce(lambda a, b: a & b, [F.col(f"k{c}") <= F.col(c) for c in COUNTS])
    # two tables of fixed size: 252 and 210 rows
    pairs = rolls(spark).join(F.broadcast(kept), within)
    return pairs.select("roll_id", (F.row_number().over(Window.partitionBy("roll_id").orderBy(*[f"k{c}" for c in COUNTS])) - 1).alias("ord"), "keeper_id", "size")


def outcomes(spark: SparkSession) -> DataFrame:
    """What n rerolled dice show: size, n1 .. n6, multiplicity, denominator 6^n."""
    ways = reduce(lambda a, b: a * b, [F.factorial(c) for c in COUNTS])
    return keepers(spark).select("size", *COUNTS, (F.factorial("size") / ways).cast("int").alias("multiplicity"), F.pow(F.lit(6), "size").cast("int").alias("denominator"))


def reaches(spark: SparkSession) -> DataFrame:
    """Probability of each roll after keeping: keeper_id, roll_id, p."""
    kept = keepers(spark).select("keeper_id", "size", *[F.col(c).alias(f"k{c}") for c in COUNTS])
    within = reduce(lambda a, b: a & b, [F.col(f"k{c}") <= F.col(c) for c in COUNTS])
    ways = reduce(lambda a, b: a * b, [F.factorial(F.col(c) - F.col(f"k{c}")) for c in COUNTS])
    return rolls(spark).join(F.broadcast(kept), within).select("keeper_id", "roll_id", (F.factorial(F.lit(5) - F.col("size")) / ways / F.pow(F.lit(6), F.lit(5) - F.col("size"))).alias("p"))


def score_matrix(spark: SparkSession, single_pair: bool = False) -> DataFrame:
    """roll_id, category, points: 252 x 15 rows."""
    return rolls(spark).crossJoin(F.broadcast(spark.range(15).select(F.col("id").cast("int").alias("category")))).select("roll_id", "category", score_by("category", single_pair).cast("int").alias("points"))


def wide_scores(spark: SparkSession, single_pair: bool = False) -> DataFrame:
    """roll_id and the fifteen points of each roll in one row."""
    return rolls(spark).select("roll_id", "multiplicity", *COUNTS, *[score(c, single_pair).cast("int").alias(f"s{c}") for c in range(15)])
