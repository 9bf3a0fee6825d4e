"""Selection by position in a global order, without a window over all rows.

A range sort spreads the order over partitions; a row's position is its partition's offset and its place in the partition.
Offsets are the running counts of the partitions, one row each, so that no task ever holds more than its own range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlattice.sources.shared import range_partitions, written

#: A place within a partition takes the low bits of monotonically_increasing_id.
PLACE_BITS = 33


def numbered(frame: DataFrame, *order: str | Column, name: str = "_at") -> DataFrame:
    """`frame` with the position of each row (0, 1, ..) by `order`, as a written table in that order.

    Rows of equal keys may be spread over partitions; their order among each other is any, but fixed from then on.
    """
    if name in frame.columns:
        raise ValueError(f"there is a column {name} already")
    keys = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    tie = f"{name}_tie"
    ordered = frame.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(range_partitions(frame), *keys, F.col(tie).asc()).sortWithinPartitions(*keys, F.col(tie).asc())
    table = written(ordered.drop(tie).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, PLACE_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    sizes = [counts.get(k, 0) for k in range(max(counts, default=-1) + 1)]
    starts = F.lit([0, *accumulate(sizes)]).cast("array<bigint>")
    return table.withColumn(name, starts[part] + F.col(name).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def every(frame: DataFrame, step: int, *order: str | Column) -> DataFrame:
    """The rows at positions 0, `step`, 2 `step`, .. of an order."""
    return numbered(frame, *order).filter(F.col("_at") % step == 0).drop("_at")


def even_sample(frame: DataFrame, order: str, n: int, *by: str) -> DataFrame:
    """n rows (at least 2) of each group at the places floor(i (len - 1) / (n - 1)); all rows of smaller groups.

    One order over group and key numbers all rows, in which a group is a run of positions: groups of any size are spread.
    """
    if n < 2:
        raise ValueError("n: at least 2")
    rows = numbered(frame, *by, order)
    groups = rows.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("_len"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_len") - 1) / F.lit(n - 1)))
    steps = F.when(F.col("_len") <= n, F.sequence(F.lit(0).cast("long"), F.col("_len") - 1)).otherwise(steps)
    wanted = groups.select(F.explode(steps).alias("_step"), "_first").select((F.col("_first") + F.col("_step")).alias("_at"))
    return rows.join(wanted, "_at", "left_semi").drop("_at")


def expanded(first: DataFrame, n: int, order: list[str | Column], details: DataFrame, key: str, detail_order: list[str | Column], most: int) -> DataFrame:
    """The first `n` rows of `first` by `order`, each with at most `most` of its `details` (joined by `key`) by `detail_order`.

    Adds _at, the place of a row, and _detail, that of its detail from 1 on. `n` rows are broadcast. Details beyond `most`
    are dropped within each task before they are shuffled.
    """
    keys = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    top = first.orderBy(*keys).limit(n)
    ranked = top.withColumn("_at", F.row_number().over(Window.orderBy(*keys)) - 1)  # n rows
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*detail_order))
    return details.join(F.broadcast(ranked), key).withColumn("_detail", rank).filter(F.col("_detail") <= most)


def runs(frame: DataFrame, column: str, *by: str) -> DataFrame:
    """Runs of consecutive whole numbers in `column`: by, start, length; repeated and null numbers count once and not at all.

    In a global order a number less its position is the same all over a run, also where it goes over the edge of a partition,
    so that runs are groups, which Spark sums up in each task first.
    """
    numbers = numbered(frame.select(*by, F.col(column).cast("long").alias("_n")).filter("_n is not null").distinct(), *by, "_n")
    found = numbers.groupBy(*by, (F.col("_n") - F.col("_at")).alias("_run")).agg(F.min("_n").alias("start"), F.count("*").alias("length"))
    return found.drop("_run")
