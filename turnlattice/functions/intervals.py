"""Interval columns with outward rounding: (low, high) pairs of doubles that contain the exact result.

The next double is found by arithmetic alone, which stays in generated code: in rounding to nearest, x + (phi |x| + eta) with
phi just over half the spacing is the next double above x, but for the smallest numbers, whose spacing is eta itself; numbers
whose half spacing would be that small are scaled up first, which is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half of the relative spacing and a little more; the smallest double, the spacing below TINY; what is scaled, and by how much.
PHI, ETA, TINY = 2.0**-53 * (1 + 2.0**-52), 5e-324, 2.0**-1021
SMALL, SCALE = 2.0**-900, 2.0**200
LARGEST = 1.7976931348623157e308
INFINITY = float("inf")


def _next(x: Column, sign: int) -> Column:
    scaled = x * SCALE
    return F.when(F.abs(x) < TINY, x + sign * ETA).when(F.abs(x) < SMALL, (scaled + sign * PHI * F.abs(scaled)) / SCALE).otherwise(x + sign * PHI * F.abs(x))


def next_up(x: Column) -> Column:
    """The least double above x; infinity and NaN stay."""
    return F.when(x == -INFINITY, F.lit(-LARGEST)).otherwise(_next(x, 1))


def next_down(x: Column) -> Column:
    """The greatest double below x; minus infinity and NaN stay."""
    return F.when(x == INFINITY, F.lit(LARGEST)).otherwise(_next(x, -1))


def interval(low: Column, high: Column | None = None) -> Column:
    """A column of intervals; of one number, that number alone."""
    return F.struct(low.cast("double").alias("low"), (low if high is None else high).cast("double").alias("high"))


def outward(low: Column, high: Column) -> Column:
    return F.struct(next_down(low).alias("low"), next_up(high).alias("high"))


def add(a: Column, b: Column) -> Column:
    return outward(a["low"] + b["low"], a["high"] + b["high"])


def subtract(a: Column, b: Column) -> Column:
    return outward(a["low"] - b["high"], a["high"] - b["low"])


def multiply(a: Column, b: Column) -> Column:
    products = [a[x] * b[y] for x in ("low", "high") for y in ("low", "high")]
    return outward(F.least(*products), F.greatest(*products))


def divide(a: Column, b: Column) -> Column:
    """Where the divisor contains zero, the whole line."""
    across = (b["low"] <= 0) & (b["high"] >= 0)
    quotients = [F.when(~across, a[x] / F.nullif(b[y], F.lit(0.0))) for x in ("low", "high") for y in ("low", "high")]
    return F.when(across, F.struct(F.lit(-INFINITY).alias("low"), F.lit(INFINITY).alias("high"))).otherwise(outward(F.least(*quotients), F.greatest(*quotients)))


def contains(a: Column, x: Column) -> Column:
    return (a["low"] <= x) & (x <= a["high"])


#: Numbers in [2^-LEAST_POWER, 2^MOST_POWER) are summed as whole numbers of 2^(e - 53), in two parts that begin at bit PART.
LEAST_POWER, MOST_POWER, PART = -900, 900, 27


def _power(x: Column) -> Column:
    """The e of 2^e <= |x| < 2^(e + 1), or one more next to the upper end; null for zero and where whole numbers don't do."""
    size = F.abs(x)
    return F.when((size >= 2.0**LEAST_POWER) & (size < 2.0**MOST_POWER), F.floor(F.log2(size)).cast("int"))


def interval_sum(frame: DataFrame, column: str, *by: str) -> DataFrame:
    """by, n, low, high: an interval that contains the exact sums of both ends of the intervals in `column`.

    Ends of one exponent are whole numbers of one unit, which add up exactly in any order and however many they are. Only the
    sums of exponents are added with rounding: their number, and so the width, doesn't grow with the rows. Other numbers (below
    2^-900 or from 2^900 on) are added as they are, and the bound is that of any order of them: n - 1 additions err by less
    than n phi / (1 - n phi) times the sum of sizes. The sum of sizes itself errs by no more than one over all rows would.
    Null intervals are left out. For fewer than 2^35 rows.
    """
    rows = frame.filter(F.col(column).isNotNull()).select(*by, F.col(column)["low"].alias("_low"), F.col(column)["high"].alias("_high"))
    rows = rows.withColumns({f"_e{side}": _power(F.col(side)) for side in ("_low", "_high")})
    whole = {side: (F.col(side) * F.pow(F.lit(2.0), 53 - F.col(f"_e{side}"))).cast("long") for side in ("_low", "_high")}
    rows = rows.withColumns({f"_k{side}": k for side, k in whole.items()})
    parts = [f(F.col(f"_k{side}")).alias(f"{name}{side}") for side in whole for name, f in (("_h", lambda k: F.sum(F.shiftright(k, PART))), ("_l", lambda k: F.sum(k.bitwiseAND(F.lit((1 << PART) - 1)))))]
    plain = [F.sum(F.when(F.col(f"_e{side}").isNull(), F.col(side))).alias(f"_p{side}") for side in whole]
    others = F.count_if((F.col("_e_low").isNull() & (F.col("_low") != 0)) | (F.col("_e_high").isNull() & (F.col("_high") != 0)))
    size = F.sum(F.greatest(F.abs("_low"), F.abs("_high")))
    sums = rows.groupBy(*by, "_e_low", "_e_high").agg(F.count("*").alias("n"), *parts, *plain, size.alias("_size"), others.alias("_others"))

    def total(side: str) -> Column:
        unit = F.pow(F.lit(2.0), F.col(f"_e{side}") - 53)
        exact = (F.col(f"_h{side}").cast("double") * 2.0**PART + F.col(f"_l{side}").cast("double")) * unit
        return F.sum(F.coalesce(exact, F.col(f"_p{side}")))

    sums = sums.groupBy(*by).agg(F.sum("n").alias("n"), total("_low").alias("_low"), total("_high").alias("_high"), F.sum("_size").alias("_size"), F.sum("_others").alias("_others"), F.count("*").alias("_groups"))
    # a group's sum is rounded three times before it is added
    err = (F.col("_others") + F.col("_groups") + 3) * 2.0**-52
    slack = next_up(next_up(err / (1 - err)) * next_up(F.col("_size") * (1 + 2 * F.col("n") * 2.0**-52)))
    return sums.select(*by, "n", next_down(F.col("_low") - slack).alias("low"), next_up(F.col("_high") + slack).alias("high"))
