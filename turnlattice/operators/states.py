"""Reachable turn-boundary states: used categories (mask) and upper subtotal, capped at 63."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reachable_uppers(spark: SparkSession) -> DataFrame:
    """Upper subtotals that each set of used upper categories can have: upper_mask, upper, rank, base. 2794 rows."""
    found = spark.range(64).select(F.col("id").cast("int").alias("upper_mask"), F.lit(0).alias("upper"))
    for face in range(1, 7):
        used = F.col("upper_mask").bitwiseAND(1 << (face - 1)) != 0
        added = F.explode(F.when(used, F.sequence(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0))))
        found = found.select("upper_mask", "upper", added.alias("k")).select("upper_mask", F.least(F.lit(63), F.col("upper") + F.col("k") * face).alias("upper")).distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("upper_mask").orderBy("upper")) - 1)
    sizes = ranked.groupBy("upper_mask").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("upper_mask").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 512
    return ranked.join(F.broadcast(sizes.withColumn("base", base)), "upper_mask").select("upper_mask", "upper", "rank", "n", "base")


def states(spark: SparkSession) -> DataFrame:
    """All 1,430,528 reachable states: state_index, mask, upper, layer (categories used)."""
    lower = spark.range(512).select(F.col("id").cast("int").alias("lower_mask"))
    mask = F.col("upper_mask").bitwiseOR(F.shiftleft("lower_mask", 6))
    return lower.crossJoin(F.broadcast(reachable_uppers(spark))).select((F.col("base") + F.col("lower_mask") * F.col("n") + F.col("rank")).cast("int").alias("state_index"), mask.alias("mask"), "upper", F.bit_count(mask).alias("layer"))


def successors(frame: DataFrame) -> DataFrame:
    """From (mask, upper, roll's s0 .. s14): one row for each open category with points, next_mask, next_upper, bonus."""
    opened = frame.withColumn("category", F.explode(F.filter(F.sequence(F.lit(0), F.lit(14)), lambda c: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), c)) == 0)))
    points = F.element_at(F.array(*[F.col(f"s{c}") for c in range(15)]), F.col("category") + 1)
    opened = opened.withColumn("points", points)
    following = F.when(F.col("category") < 6, F.least(F.lit(63), F.col("upper") + F.col("points"))).otherwise(F.col("upper"))
    opened = opened.withColumn("next_upper", following).withColumn("next_mask", F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("category"))))
    return opened.withColumn("bonus", F.when((F.col("upper") < 63) & (F.col("next_upper") == 63), 50).otherwise(0))
