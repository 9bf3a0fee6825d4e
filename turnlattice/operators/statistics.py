"""Statistics as table in, table out: they work on any numeric column. Sums are mergeable, so that Spark combines them in
each task before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlattice.operators.quantiles import exact_quantiles
from turnlattice.sources.shared import written

#: Normal quantiles, the quantiles and thresholds that reports show, the edges of margin bins.
Z95, Z99 = 1.959963984540054, 2.5758293035489004
QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
THRESHOLDS = [150, 175, 200, 225, 250, 275, 300, 325, 350]
MARGIN_EDGES = [0, 1e-12, 1e-8, 1e-6, 1e-4, 1e-3, 1e-2, 0.05, 0.1, 0.5, 1, 2, 5, 10]


def moments(frame: DataFrame, value: str, *by: str, wide: bool = False) -> DataFrame:
    """n, sum, sum_sq, min, max of a whole-number column; `wide`: sums have 38 digits, for numbers whose squares leave 64 bits."""
    x = F.col(value).cast("long")
    y = x.cast("decimal(18,0)") if wide else x
    return frame.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("sum"), F.sum(y * y).alias("sum_sq"), F.min(x).alias("min"), F.max(x).alias("max"))


def spread(frame: DataFrame) -> DataFrame:
    """Adds mean, sd, se and the normal intervals ci95 and ci99 to moments (n, sum, sum_sq)."""
    frame = frame.withColumns({c: F.col(c).cast("double") for c, t in frame.dtypes if c in ("sum", "sum_sq") and t.startswith("decimal")})
    mean = F.col("sum") / F.col("n")
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("sum_sq") - F.col("sum") * F.col("sum") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))))).otherwise(0.0)
    frame = frame.withColumn("mean", mean).withColumn("sd", sd).withColumn("se", F.col("sd") / F.sqrt("n"))
    return frame.withColumns({f"ci{k}_{side}": F.col("mean") + sign * z * F.col("se") for k, z in ((95, Z95), (99, Z99)) for side, sign in (("low", -1), ("high", 1))})


def histogram(frame: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(value, count) for every whole number from `low` to `high`; numbers outside are not counted."""
    counted = frame.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("count"))
    return frame.sparkSession.range(low, high + 1).withColumnRenamed("id", "value").join(counted, "value", "left").select("value", F.coalesce("count", F.lit(0)).alias("count"))


def quantiles(counts: DataFrame, *by: str, at: list[float] = QUANTILES) -> DataFrame:
    """Order statistics sorted[floor(q (n - 1))] from (value, count), a row for each q."""
    order = Window.partitionBy(*by).orderBy("value") if by else Window.orderBy("value")
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    seen = counts.filter("count > 0").withColumn("_cum", F.sum("count").over(order)).withColumn("_n", F.sum("count").over(whole))
    asked = seen.withColumn("q", F.explode(F.array(*map(F.lit, at)))).filter(F.col("_cum") > F.col("q") * (F.col("_n") - 1))
    return asked.groupBy(*by, "q").agg(F.min("value").alias("value"))


def thresholds(counts: DataFrame, at: list[int] = THRESHOLDS) -> DataFrame:
    """How many values reach each threshold, and their share."""
    sums = counts.agg(F.sum("count").alias("n"), *[F.coalesce(F.sum(F.when(F.col("value") >= t, F.col("count"))), F.lit(0)).alias(f"t{t}") for t in at])
    pairs = F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"t{t}").alias("count")) for t in at])
    return sums.select("n", F.explode(pairs).alias("p")).select("p.threshold", "p.count", (F.col("p.count") / F.col("n")).alias("probability"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval; [0, 0] for n = 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = successes / m
    bottom = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / bottom
    half = F.lit(z) * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m) / bottom
    return F.coalesce(centre - half, F.lit(0.0)), F.coalesce(centre + half, F.lit(0.0))


def pearson(frame: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation from sums; 0 where one side doesn't vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = frame.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    bottom = F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))))
    return sums.select(*by, "n", F.when(bottom > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / bottom).otherwise(0.0).alias("correlation"))


def distribution(counts: DataFrame) -> DataFrame:
    """Adds probability, cumulative share and inclusive tail to (value, count), which has a bounded number of values."""
    up, down = Window.orderBy("value"), Window.orderBy("value").rowsBetween(0, Window.unboundedFollowing)
    n = F.sum("count").over(Window.partitionBy())
    return counts.select("value", "count", (F.col("count") / n).alias("probability"), (F.sum("count").over(up) / n).alias("cumulative"), (F.sum("count").over(down) / n).alias("tail"))


def margin_bin(x: Column) -> Column:
    """The half-open bin of a margin from 0 on; below 0 or not a number: the last."""
    reached = F.size(F.filter(F.array(*[F.lit(float(e)) for e in MARGIN_EDGES]), lambda e: x >= e))
    return F.when(x >= 0, reached - 1).otherwise(len(MARGIN_EDGES) - 1)


def paired(frame: DataFrame, difference: str) -> DataFrame:
    """One row on paired differences: n, mean, sd, se, ci95, min, max, median (the mean of the two middles), win, tie and loss shares.

    The median is selected by rounds of counts (`quantiles`), so that no task gathers the differences.
    """
    d = F.col(difference).cast("double")
    rows = written(frame.select(d.alias("_d")))  # read some times
    median = F.lit(exact_quantiles(rows, "_d", [0.5], linear=True)[0]).cast("double")
    d = F.col("_d")
    out = rows.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg((d > 0).cast("int")).alias("win_rate"), F.avg((d == 0).cast("int")).alias("tie_rate"), F.avg((d < 0).cast("int")).alias("loss_rate"))
    se = F.col("sd") / F.sqrt(F.nullif(F.col("n"), F.lit(0)))
    return out.withColumn("median", median).withColumn("se", se).withColumn("ci95_low", F.col("mean") - Z95 * se).withColumn("ci95_high", F.col("mean") + Z95 * se)


def visit_groups(visits: DataFrame) -> DataFrame:
    """Visits (turn, rerolls, mask, upper, pattern, size, margin, advantage) by turn, rerolls, categories used, distance to the
    bonus, pattern and keeper size: n, the mean margin, and the mean advantage over the visits that have one (null if none has)."""
    keys = [F.col("turn"), F.col("rerolls"), F.bit_count("mask").alias("used"), F.greatest(F.lit(0), 63 - F.col("upper")).alias("distance"), F.col("pattern"), F.col("size")]
    return visits.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("margin").alias("mean_margin"), F.avg("advantage").alias("mean_advantage"))


def latest(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order`: aggregated, so that a key with many rows is no window of its own."""
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")
