"""Dice as face counts n1 .. n6, and the fifteen scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The categories in the order of their bits, the upper threshold and its bonus.
CATEGORIES = ["ones", "twos", "threes", "fours", "fives", "sixes", "one_pair", "two_pairs", "three_alike", "four_alike", "small_straight", "large_straight", "full_house", "chance", "five_alike"]
UPPER_GOAL, BONUS, ALL_USED = 63, 50, 0x7FFF
COUNTS = [f"n{i}" for i in range(1, 7)]


def counts_of(dice: Column | str) -> Column:
    """array<int> of dice -> array of the six face counts; fails on anything but five faces from 1 to 6."""
    dice = F.col(dice) if isinstance(dice, str) else dice
    legal = (F.size(dice) == 5) & F.forall(dice, lambda d: d.between(1, 6))
    counts = F.transform(F.array(*map(F.lit, range(1, 7))), lambda f: F.size(F.filter(dice, lambda d: d == f)))
    return F.when(legal, counts).otherwise(F.raise_error(F.lit("dice: five faces from 1 to 6")).cast("array<int>"))


def dice_of(counts: Column) -> Column:
    """Six face counts -> the sorted dice."""
    return F.flatten(F.transform(F.arrays_zip(F.array(*map(F.lit, range(1, 7))).alias("face"), counts.alias("n")), lambda x: F.array_repeat(x["face"], x["n"])))


def pattern() -> Column:
    """The positive counts in descending order, such as 3-2."""
    return F.concat_ws("-", F.sort_array(F.filter(F.array(*COUNTS), lambda n: n > 0), asc=False).cast("array<string>"))


def _highest(least: int, times: int) -> Column:
    """times * the highest face that shows at least `least` times, else 0."""
    return F.greatest(*[F.when(F.col(f"n{f}") >= least, F.lit(times * f)).otherwise(0) for f in range(1, 7)])


def score(category: int, single_pair: bool = False) -> Column:
    """Points of n1 .. n6 in a category. `single_pair`: one pair counts where two pairs are asked for (a historical rule)."""
    n = [F.col(c) for c in COUNTS]
    total = sum((n[f] * (f + 1) for f in range(1, 6)), n[0])
    if category < 6:
        return n[category] * (category + 1)
    if category == 6:
        return _highest(2, 2)
    if category == 7:
        pairs = [F.when(x >= 2, 1).otherwise(0) for x in n]
        both = sum(pairs[1:], pairs[0])
        worth = sum((p * 2 * (f + 1) for f, p in enumerate(pairs)), F.lit(0))
        return F.when(both >= 2, worth).otherwise(_highest(2, 2) if single_pair else 0)
    if category in (8, 9):
        return _highest(category - 5, category - 5)
    if category in (10, 11):
        run = n[:5] if category == 10 else n[1:]
        every = run[0] == 1
        for x in run[1:]:
            every = every & (x == 1)
        return F.when(every, 15 if category == 10 else 20).otherwise(0)
    if category == 12:
        three = F.greatest(*[F.when(x == 3, F.lit(3 * f)).otherwise(0) for f, x in enumerate(n, 1)])
        two = F.greatest(*[F.when(x == 2, F.lit(2 * f)).otherwise(0) for f, x in enumerate(n, 1)])
        return F.when((three > 0) & (two > 0), three + two).otherwise(0)
    return total if category == 13 else F.when(F.greatest(*n) == 5, 50).otherwise(0)


def score_by(category: str, single_pair: bool = False) -> Column:
    """Points in the category that a column names."""
    chosen = F.lit(None).cast("int")
    for c in range(15):
        chosen = F.when(F.col(category) == c, score(c, single_pair)).otherwise(chosen)
    return chosen


def second_score(category: str) -> Column:
    """The same points from the sorted dice by array functions; a second opinion."""
    dice, faces = F.col("dice"), F.reverse(F.array(*map(F.lit, range(1, 7))))
    shown = lambda k: F.filter(faces, lambda f: F.size(F.filter(dice, lambda d: d == f)) >= k)
    exactly = lambda k: F.filter(faces, lambda f: F.size(F.filter(dice, lambda d: d == f)) == k)
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(0))
    total = F.aggregate(dice, F.lit(0), lambda a, d: a + d)
    upper = F.aggregate(dice, F.lit(0), lambda a, d: a + F.when(d == F.col(category) + 1, d).otherwise(0))
    rules = {
        6: 2 * first(shown(2)),
        7: F.when(F.size(shown(2)) >= 2, 2 * (F.get(shown(2), F.lit(0)) + F.get(shown(2), F.lit(1)))).otherwise(0),
        8: 3 * first(shown(3)),
        9: 4 * first(shown(4)),
        10: F.when(F.concat_ws("", dice.cast("array<string>")) == "12345", 15).otherwise(0),
        11: F.when(F.concat_ws("", dice.cast("array<string>")) == "23456", 20).otherwise(0),
        12: F.when((F.size(exactly(3)) > 0) & (F.size(exactly(2)) > 0), 3 * first(exactly(3)) + 2 * first(exactly(2))).otherwise(0),
        13: total,
        14: F.when(F.size(shown(5)) > 0, 50).otherwise(0),
    }
    chosen = upper
    for c, rule in rules.items():
        chosen = F.when(F.col(category) == c, rule).otherwise(chosen)
    return chosen
