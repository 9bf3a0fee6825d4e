"""state_index_all and successor_states_all hold every state, not those of some masks only."""

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

import __spark_entry__
from turnlattice.functions import dice
from turnlattice.plans import reference_queries


def uppers(mask):
    found = {0}
    for face in range(1, 7):
        if mask >> (face - 1) & 1:
            found = {min(63, u + k * face) for u in found for k in range(6)}
    return sorted(found)


def test_all_indexes(spark):
    got = __spark_entry__.queries()["state_index_all"](spark, "").toPandas().sort_values("state_index")
    want = [(lower << 6 | upper_mask, u) for upper_mask in range(64) for lower in range(512) for u in uppers(upper_mask)]
    assert len(want) == 1430528 and got["state_index"].tolist() == list(range(len(want)))
    assert list(zip(got["mask"].tolist(), got["upper"].tolist())) == want


def test_all_successors(spark):
    rolls = [[r.count(f) for f in range(1, 7)] for r in combinations_with_replacement(range(1, 7), 5)]
    table = spark.createDataFrame([(r, c) for r in rolls for c in range(15)], "counts array<int>, category int")
    scored = table.withColumn("dice", dice.dice_of(F.col("counts"))).withColumn("points", dice.second_score("category"))
    attainable = {(r.category, r.points) for r in scored.select("category", "points").distinct().collect()}
    some = [(0, 0), (63, 63), (31, 57), (32767 ^ 1, 62), (5 | 1 << 9, 12), (0b10101, 40)]
    want = set()
    for mask, upper in some:
        for c, points in attainable:
            if not mask >> c & 1:
                after = min(63, upper + points) if c < 6 else upper
                want.add((mask, upper, c, points, mask | 1 << c, after, 50 if upper < 63 == after else 0))
    frame = spark.createDataFrame(some, "mask int, upper int")
    got = reference_queries.all_successors(spark, frame).select("mask", "upper", "category", "points", "next_mask", "next_upper", "bonus")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_every_state_has_successors(spark):
    got = __spark_entry__.queries()["successor_states_all"](spark, "").agg(F.count("*").alias("n"), F.count_if(F.col("category") > 5).alias("lower")).first()
    per = {r.category: r.n for r in reference_queries.universe.score_matrix(spark).select("category", "points").distinct().groupBy("category").agg(F.count("*").alias("n")).collect()}
    states = [(m, len(uppers(m))) for m in range(64)]
    upper = sum(512 * n * sum(per[c] for c in range(6) if not m >> c & 1) for m, n in states)
    lower = sum(256 * n * per[c] for _, n in states for c in range(6, 15))
    assert (got.n, got.lower) == (upper + lower, lower)
