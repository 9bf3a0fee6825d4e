"""Exact order statistics and quantiles by distributed selection.

Each asked rank has a bracket of values that holds it. A round draws two cuts from a mergeable sketch of the rows in the
bracket and counts exactly how many are below and at them, which narrows the bracket around the rank. When a bracket has few
rows left they are sorted; when it has one value left, that is the answer, however often it occurs. Nothing depends on the
sketch but the number of rounds, and no task or driver holds more than LEFT values a rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a bracket that are sorted, the sketch's accuracy, and the share of a bracket's rows on either side of a rank that its cuts should keep.
LEFT, ACCURACY, MARGIN = 10_000, 10_000, 0.001


def _inside(x: Column, bracket: dict) -> Column:
    return (x >= F.lit(bracket["low"])) & (x <= F.lit(bracket["high"]))


def order_statistics(frame: DataFrame, value: str, ranks: list[int], left: int = LEFT) -> list:
    """The values at `ranks` (from 0) of the non-null numbers in `value`, in order; NaN comes last, as Spark sorts.

    `frame` is read once to begin with and twice a round, so that what is dear to compute should be written before.
    """
    rows = frame.select(F.col(value).alias("_x")).filter("_x is not null")
    x = F.col("_x")
    whole = rows.agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).first()
    if any(not 0 <= r < whole["n"] for r in ranks):
        raise ValueError(f"a rank is not from 0 to {whole['n'] - 1}")
    found: dict[int, object] = {}
    brackets = {r: {"low": whole["low"], "high": whole["high"], "below": 0, "n": whole["n"]} for r in set(ranks)}
    while brackets:
        for r, b in list(brackets.items()):
            if b["low"] == b["high"] or b["low"] != b["low"]:
                found[r] = brackets.pop(r)["low"]
        small = {r: b for r, b in brackets.items() if b["n"] <= left}
        for r, b in small.items():  # `left` values at most
            values = rows.filter(_inside(x, b)).orderBy(x).collect()
            found[r] = values[r - b["below"]]["_x"]
            del brackets[r]
        if brackets:
            _narrow(rows, x, brackets)
    return [found[r] for r in ranks]


def _narrow(rows: DataFrame, x: Column, brackets: dict[int, dict]) -> None:
    """One round for all open ranks: two passes, each one aggregation without groups."""
    asked = list(brackets.items())
    cuts = []
    for r, b in asked:
        at = (r - b["below"] + 0.5) / b["n"]
        shares = [max(0.0, at - MARGIN), min(1.0, at + MARGIN)]
        cuts.append(F.percentile_approx(F.when(_inside(x, b), x), shares, F.lit(ACCURACY)))
    drawn = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    counts = []
    for i, (_, b) in enumerate(asked):
        low, high = drawn[f"c{i}"]
        inside = _inside(x, b)
        counts += [F.count_if(inside & (x < F.lit(low))).alias(f"l{i}"), F.count_if(inside & (x <= F.lit(low))).alias(f"le{i}"), F.count_if(inside & (x < F.lit(high))).alias(f"h{i}"), F.count_if(inside & (x <= F.lit(high))).alias(f"he{i}")]
        counts += [F.max(F.when(inside & (x < F.lit(low)), x)).alias(f"b{i}"), F.min(F.when(inside & (x > F.lit(high)), x)).alias(f"a{i}"), F.min(F.when(inside & (x > F.lit(low)), x)).alias(f"n{i}"), F.max(F.when(inside & (x < F.lit(high)), x)).alias(f"m{i}")]
    row = rows.agg(*counts).first()
    for i, (r, b) in enumerate(asked):
        low, high = drawn[f"c{i}"]
        place = r - b["below"]  # within the bracket
        steps = [  # (rows before, rows up to, least value, greatest value), in order
            (0, row[f"l{i}"], b["low"], row[f"b{i}"]),
            (row[f"l{i}"], row[f"le{i}"], low, low),
            (row[f"le{i}"], row[f"h{i}"], row[f"n{i}"], row[f"m{i}"]),
            (row[f"h{i}"], row[f"he{i}"], high, high),
            (row[f"he{i}"], b["n"], row[f"a{i}"], b["high"]),
        ]
        before, upto, least, greatest = next(s for s in steps if s[0] <= place < s[1])
        brackets[r] = {"low": least, "high": greatest, "below": b["below"] + before, "n": upto - before}


def exact_quantiles(frame: DataFrame, value: str, at: list[float], linear: bool = False) -> list:
    """The quantiles `at` (0 to 1) of the non-null numbers in `value`; None for each if there are none.

    The order statistic floor(q (n - 1)), or, if `linear`, between it and the next one by q (n - 1); 0.5 then is the mean of
    the two middle values of an even number.
    """
    n = frame.filter(F.col(value).isNotNull()).count()
    if not n:
        return [None] * len(at)
    places = [q * (n - 1) for q in at]
    low = [math.floor(p) for p in places]
    high = [math.ceil(p) if linear else k for p, k in zip(places, low, strict=True)]
    values = order_statistics(frame, value, low + high)
    out = []
    for p, k, a, b in zip(places, low, values[: len(at)], values[len(at) :], strict=True):
        out.append(a + (b - a) * (p - k) if p > k and linear and b != a else a)
    return out
