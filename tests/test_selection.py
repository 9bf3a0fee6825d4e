"""Selection by position and exact quantiles against plain lists."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlattice.operators import quantiles, selection
from turnlattice.operators import statistics as stat


def test_numbered_is_the_global_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(50), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k long, v long").repartition(7)
    found = selection.numbered(frame, F.desc("k"), "v").collect()
    assert sorted(r._at for r in found) == list(range(2000))
    assert [(r.k, r.v) for r in sorted(found, key=lambda r: r._at)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r.v for r in selection.every(frame, 300, "v").orderBy("v").collect()] == [0, 300, 600, 900, 1200, 1500, 1800]
    with pytest.raises(ValueError):
        selection.numbered(frame, "k", name="v")


def test_one_key_is_spread(spark):
    table = selection.numbered(spark.range(4000).select(F.lit(7).alias("k"), "id"), "k")
    assert sorted(r._at for r in table.collect()) == list(range(4000))
    assert table.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert selection.numbered(spark.range(0), "id").count() == 0


def test_even_sample_of_groups(spark):
    rnd = random.Random(2)
    sizes = {"a": 1, "b": 5, "c": 6, "d": 7, "e": 400, None: 33}
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    rnd.shuffle(rows)
    out = {}
    for r in selection.even_sample(spark.createDataFrame(rows, "g string, i long"), "i", 6, "g").collect():
        out.setdefault(r.g, []).append(r.i)
    for g, n in sizes.items():
        assert sorted(out[g]) == (list(range(n)) if n <= 6 else [i * (n - 1) // 5 for i in range(6)])


def test_expanded_has_few_details(spark):
    first = spark.createDataFrame([(i, (i * 37) % 100) for i in range(100)], "k long, price long")
    details = spark.createDataFrame([(i % 100 if i < 300 else 3, i) for i in range(3000)], "k long, d long")
    out = selection.expanded(first, 10, [F.desc("price"), "k"], details, "k", ["d"], 4).collect()
    top = sorted(((-(i * 37 % 100)), i) for i in range(100))[:10]
    assert {r.k: r._at for r in out} == {k: at for at, (_, k) in enumerate(top)}
    for k in {r.k for r in out}:
        own = sorted(d for d in ([*range(300)] if k != 3 else [*range(3000)]) if (d % 100 if d < 300 else 3) == k)[:4]
        assert sorted((r._detail, r.d) for r in out if r.k == k) == list(enumerate(own, 1))


def test_runs_go_over_partition_edges(spark):
    rnd = random.Random(4)
    numbers = sorted(set(range(1000)) - {0, 500, 501, 777} | {5000} | set(range(-30, -10)))
    rows = [("x", n) for n in numbers + rnd.sample(numbers, 50)] + [("y", 3), ("y", 4), ("y", None)]
    rnd.shuffle(rows)
    out = {(r.g, r.start): r.length for r in selection.runs(spark.createDataFrame(rows, "g string, n long").repartition(9), "n", "g").collect()}
    assert out == {("x", -30): 20, ("x", 1): 499, ("x", 502): 275, ("x", 778): 222, ("x", 5000): 1, ("y", 3): 2}


CASES = {
    "scales": lambda rnd: np.exp(rnd.normal(0, 80, 3000)) * np.sign(rnd.normal(0, 1, 3000)),
    "ties": lambda rnd: rnd.integers(0, 4, 3000).astype(float),
    "hot": lambda rnd: np.where(rnd.random(3000) < 0.4, 7.25, rnd.normal(0, 100, 3000)),
    "same": lambda rnd: np.full(3000, 2.5),
}


@pytest.mark.parametrize("case", CASES)
def test_order_statistics(spark, case):
    values = CASES[case](np.random.default_rng(3))
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 20, "x double").repartition(2).cache()
    want = np.sort(values)
    for ranks, left in (([0, 1499, 1500, 2999], 10_000), ([700, 2999], 5)):  # at once; by rounds of counts
        assert quantiles.order_statistics(frame, "x", ranks, left) == [want[r] for r in ranks]
    with pytest.raises(ValueError):
        quantiles.order_statistics(frame, "x", [3000])


def test_not_a_number_comes_last(spark):
    frame = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (2.0,), (float("nan"),)], "x double")
    found = quantiles.order_statistics(frame, "x", [0, 1, 2, 3, 4], 1)
    assert found[:3] == [1.0, 2.0, float("inf")] and all(v != v for v in found[3:])


def test_exact_quantiles(spark):
    values = [5, 1, 4, 4, 9, 2]
    frame = spark.createDataFrame([(v,) for v in values], "x long")
    assert quantiles.exact_quantiles(frame, "x", [0.5], linear=True) == [statistics.median(values)]
    assert quantiles.exact_quantiles(frame, "x", [0.0, 0.5, 1.0]) == [1, 4, 9]
    assert quantiles.exact_quantiles(frame.limit(0), "x", [0.5]) == [None]
    row = stat.paired(frame.withColumn("d", F.col("x") - 4), "d").first()
    assert (row.n, row.median, row.win_rate, row.tie_rate) == (6, 0.0, 2 / 6, 2 / 6)
    assert stat.paired(frame.limit(0), "x").first().median is None
