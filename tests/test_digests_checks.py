"""Digest trees, nested checks, canonical JSON and intervals against plain Python."""

import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlattice.functions import canonical, intervals
from turnlattice.operators import checks, digests
from turnlattice.sources.shared import written


# digests


def built(spark, rows, parts):
    return spark.createDataFrame(rows, "k long, v string, w double").repartition(parts)


def test_builds_agree_whatever_the_partitions(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(-3000, 100_000), rnd.choice(["a", "b", None, ""]), rnd.random()) for _ in range(3000)] + [(None, "x", None)]
    again = rows[:]
    rnd.shuffle(again)
    columns = [F.col("k"), F.col("v"), F.col("w")]
    one, other = (written(digests.tree(built(spark, r, p), F.col("k"), columns, 6, 4, 5)) for r, p in ((rows, 2), (again, 7)))
    assert one.exceptAll(other).count() == 0 and one.filter("level = 4").first().n == 3001
    assert digests.differing(one, other, 4, 5).count() == 0


def test_differences_are_located(spark):
    rnd = random.Random(2)
    rows = [(i * 3, rnd.choice("abc"), float(i)) for i in range(4000)] + [(300, "twin", 1.0)] * 2 + [(None, "n", 0.0)]
    bad = [r for r in rows if r[0] != 900] + [(3000, "b", 1.5), (9000, "new", 0.5)]
    bad = [(k, v, 77.0) if k == 6000 else (k, v, w) for k, v, w in bad]
    bad.remove((300, "twin", 1.0))
    bad.append((None, "n", 0.0))
    frames = built(spark, rows, 3), built(spark, bad, 5)
    columns = [F.col("k"), F.col("v"), F.col("w")]
    trees = tuple(written(digests.tree(f, F.col("k"), columns, 6, 4, 5)) for f in frames)
    nodes = {r.node for r in digests.differing(*trees, 4, 5).collect()}
    assert nodes == {k >> 6 for k in (300, 900, 3000, 6000, 9000)} | {None}
    found = {(r.k, r.v, r.n_one, r.n_other, r.kind) for r in digests.compared(*frames, "k", trees, 6, 4, 5).collect()}
    row = {r[0]: r for r in rows}
    assert found == {(300, "twin", 2, 1, "repeated"), (900, row[900][1], 1, 0, "lost"), (3000, "b", 0, 1, "added"), (9000, "new", 0, 1, "added"), (6000, row[6000][1], 1, 0, "changed"), (6000, row[6000][1], 0, 1, "changed"), (None, "n", 1, 2, "repeated")}


def test_values_keep_apart(spark):
    cases = [("a", "bc"), ("ab", "c"), ("", "abc"), (None, "abc"), ("-", "abc"), ("1:a", "bc"), ("abc", ""), ("abc", None)]
    frame = spark.createDataFrame(cases, "a string, b string").select(digests.encoded([F.col("a"), F.col("b")]).alias("e"))
    assert frame.distinct().count() == len(cases)


# checks


def nested(spark):
    schema = "id long, name string, lines array<struct<price double, tags array<string>>>, more map<string, float>, hist struct<n long, counts array<long>>, sha string, place string"
    good = (1, "a", [(1.0, ["x"]), (2.0, [])], {"k": 1.0}, (3, [1, 2]), "0" * 64, "a/b")
    bad = [
        (2, None, [(math.nan, ["x", None]), None], {"k": math.inf, "z": None}, (4, [1, 2]), "0" * 63, "../x"),
        (3, "", None, None, (0, [0, 0]), "F" * 64, "/abs"),
        (4, "n", [(None, None)], {}, None, None, "a//..", ),
    ]
    return spark.createDataFrame([good, *bad], schema)


def test_violations_have_paths(spark):
    rules = {"$.sha": [checks.is_hash()], "$.place": [checks.is_relative()], "$.name": [checks.not_empty()], "$.hist": [checks.total("counts", "n")], "$.lines": [checks.has_items()]}
    found = sorted(map(tuple, checks.violations(nested(spark), ["id"], rules).collect()))
    assert found == sorted(
        [(2, "$.name", "null"), (2, "$.lines[0].price", "not_finite"), (2, "$.lines[0].tags[1]", "null"), (2, "$.lines[1]", "null"), (2, "$.more.k", "not_finite"), (2, "$.more.z", "null"), (2, "$.hist", "total"), (2, "$.sha", "hash"), (2, "$.place", "relative_path")]
        + [(3, "$.name", "empty"), (3, "$.lines", "null"), (3, "$.more", "null"), (3, "$.hist", "total"), (3, "$.sha", "hash"), (3, "$.place", "relative_path")]
        + [(4, "$.lines[0].price", "null"), (4, "$.lines[0].tags", "null"), (4, "$.hist", "null"), (4, "$.sha", "null"), (4, "$.place", "relative_path")]
    )
    fewer = checks.violations(nested(spark), ["id"], nullable={"$.lines", "$.lines[].tags", "$.more{}"})
    assert not {r.path for r in fewer.collect()} & {"$.lines", "$.lines[0].tags", "$.more.z"}
    with pytest.raises(ValueError, match="no such place"):
        checks.violations(nested(spark), ["id"], {"$.lines[].nothing": [checks.is_hash()]})


def test_gate_fails_on_a_violation(spark):
    good = checks.violations(nested(spark).filter("id = 1"), ["id"])
    assert checks.gate(good, ["id"]).count() == 0
    with pytest.raises(Exception, match="check failed at"):
        checks.gate(checks.violations(nested(spark), ["id"]), ["id"]).collect()


def test_manifests(spark):
    good = ("a", "solve", "abc", "1", True, "COMPLETE", 1.0, 1.0, 1.0, 0.0, ["in/x"], ["out"], {"rules": "0" * 64})
    bad = [("b", "", "abc", "1", True, "FAILED", -1.0, float("inf"), 1.0, 0.0, [], ["/abs", "a/../b"], {"rules": "x"}), ("c", "k", None, "1", False, "FAILED", 1.0, 1.0, 1.0, 0.0, ["i"], ["o"], {}), ("c", *good[1:])]
    found = sorted(map(tuple, checks.manifest_violations(spark.createDataFrame([good, *bad], checks.EXPERIMENT)).collect()))
    assert found == sorted([("b", "$", "incomplete"), ("b", "$.kind", "empty"), ("b", "$.game_count", "negative"), ("b", "$.workers", "not_finite"), ("b", "$.inputs", "empty"), ("b", "$.outputs[0]", "relative_path"), ("b", "$.outputs[1]", "relative_path"), ("b", "$.hashes.rules", "hash"), ("c", "$.source_commit", "null"), ("c", "$.id", "repeated")])


# canonical JSON


def test_canonical_rows(spark):
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice('ab"\\/\n\t\x00\x1f\x7fé日😀  ') for _ in range(rnd.randint(0, 8)))
    rows = [(text(), [float(f"{rnd.random():.12g}e{rnd.randint(-30, 30)}"), float(rnd.randint(-5, 10**6)), None], {text(): i for i in range(3)}, (rnd.random() < 0.5, None, text()), rnd.randint(-(2**60), 2**60)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "`z a` string, b array<double>, m map<string, int>, s struct<y boolean, x int, `é` string>, n long")
    for r in frame.withColumn("json", canonical.row_json(frame, style="repr")).collect():
        plain = {"z a": r["z a"], "b": r.b, "m": r.m, "s": r.s.asDict(), "n": r.n}
        assert r.json == json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    one = spark.createDataFrame([(None,)], "a struct<b int>")
    assert one.select(canonical.row_json(one)).first()[0] == '{"a":null}'


def test_numbers(spark):
    rnd = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.0, 100.0, 1e15, 1e16, 123456789012345680.0, 1e21, 1e22, 1e23, 0.1, 0.001, 0.0001, 0.00001, 1e-6, 1e-7, 5e-324, 1.7976931348623157e308, 2.0**-44, 2e-3, 1 / 3, 123.456, 4.35, 9007199254740993.0]
    values += [float(np.frombuffer(rnd.randbytes(8), "<f8")[0]) for _ in range(3000)] + [round(rnd.random() * 10**6, 2) for _ in range(500)]
    values = [v for v in values if math.isfinite(v)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    found = frame.select("x", canonical.number(F.col("x"), "repr").alias("r"), canonical.number(F.col("x")).alias("e")).collect()
    other = [r for r in found if r.r != repr(r.x)]
    assert all(float(r.r) == r.x and (len(repr(r.x).split("e")[0]) > 16 or r.x == 5e-324) for r in other) and len(other) < 0.005 * len(found)
    ecma = {0.0: "0", 100.0: "100", 1e16: "10000000000000000", 1e21: "1e+21", 1e20 + 0.0: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 123.456: "123.456"}
    for r in found:
        assert float(r.e) == r.x and r.e == ecma.get(r.x, r.e) and not r.e.endswith(".0")
    with pytest.raises(Exception, match="no such number"):
        spark.createDataFrame([(math.nan,)], "x double").select(canonical.number(F.col("x"))).collect()


# intervals


def test_next_doubles(spark):
    rnd = random.Random(5)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1021, 2.0**-1023, 1.0, -1.0, 2.0, 0.5, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf]
    with np.errstate(over="ignore"):
        values += [float(np.nextafter(v, d)) for v in values for d in (-math.inf, math.inf)]
    values += [v for _ in range(4000) if (v := float(np.frombuffer(rnd.randbytes(8), "<f8")[0])) == v] + [2.0**k for k in range(-1074, 1024, 7)]
    for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", intervals.next_up(F.col("x")).alias("u"), intervals.next_down(F.col("x")).alias("d")).collect():
        assert (r.u, r.d) == (np.nextafter(r.x, math.inf), np.nextafter(r.x, -math.inf)), r.x


def test_operations_contain_the_exact_result(spark):
    rnd = random.Random(6)
    number = lambda: rnd.choice([rnd.uniform(-10, 10), rnd.uniform(-1e-8, 1e8), float(rnd.randint(-3, 3)), 0.1])
    rows = [(*sorted((number(), number())), *sorted((number(), number()))) for _ in range(800)]
    a, b = intervals.interval(F.col("a"), F.col("b")), intervals.interval(F.col("c"), F.col("d"))
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for r in frame.select("*", intervals.add(a, b).alias("add"), intervals.subtract(a, b).alias("sub"), intervals.multiply(a, b).alias("mul"), intervals.divide(a, b).alias("div")).collect():
        ends = [(Fraction(x), Fraction(y)) for x in (r.a, r.b) for y in (r.c, r.d)]
        for found, exact in ((r["add"], [x + y for x, y in ends]), (r["sub"], [x - y for x, y in ends]), (r["mul"], [x * y for x, y in ends])):
            assert all(Fraction(found.low) <= e <= Fraction(found.high) for e in exact)
        if r.c <= 0 <= r.d:
            assert (r["div"].low, r["div"].high) == (-math.inf, math.inf)
        else:
            assert all(Fraction(r["div"].low) <= x / y <= Fraction(r["div"].high) for x, y in ends)


def test_sum_contains_the_exact_one(spark):
    rnd = random.Random(7)
    rows = [(i % 3, rnd.uniform(-1, 1) * 10 ** rnd.randint(-5, 12)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g long, x double").repartition(5).withColumn("i", intervals.interval(F.col("x")))
    for r in intervals.interval_sum(frame, "i", "g").collect():
        exact, size = sum(Fraction(x) for g, x in rows if g == r.g), sum(abs(x) for g, x in rows if g == r.g)
        assert Fraction(r.low) <= exact <= Fraction(r.high) and r.high - r.low <= 1e-11 * size and r.n == 1000


def test_width_of_a_sum_does_not_grow_with_the_rows(spark):
    frame = spark.range(0, 3_000_000, 1, 4).select((F.col("id") / 7 + 0.1).alias("x")).withColumn("i", intervals.interval(F.col("x")))
    r = intervals.interval_sum(frame, "i").first()
    exact = sum(map(Fraction, (np.arange(3_000_000) / 7 + 0.1)[::3000].tolist()))
    some = intervals.interval_sum(frame.filter(F.round(F.col("x") * 7 - 0.7) % 3000 == 0), "i").first()
    assert r.n == 3_000_000 and r.high - r.low < 1e-11 * r.high  # 1e-9 and more by a bound that grows with the rows
    assert Fraction(some.low) <= exact <= Fraction(some.high)


def test_sum_of_any_sizes(spark):
    values = [0.0, -0.0, 5e-324, -(2.0**-1000), 2.0**-900, 2.0**899, -1.5 * 2.0**899, 8.0, np.nextafter(8.0, 0), 2.0**29, -3.0, 1e300]
    frame = spark.createDataFrame([(float(v),) for v in values], "x double").withColumn("i", intervals.interval(F.col("x")))
    r = intervals.interval_sum(frame, "i").first()
    assert r.n == len(values) and Fraction(r.low) <= sum(map(Fraction, map(float, values))) <= Fraction(r.high)


def test_hundredths_are_told_as_other_numbers(spark):
    rnd = random.Random(8)
    values = [rnd.randint(1, 10**rnd.randint(1, 14)) / 100 * rnd.choice([1, -1]) for _ in range(500)] + [0.01, 0.1, 0.07, 1e12, 999999999999.99, 1e11, 0.009, 0.1 + 0.2]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for r in frame.select("x", canonical.number(F.col("x"), "repr").alias("r"), canonical.number(F.col("x")).alias("e")).collect():
        assert r.r == repr(r.x) and r.e == repr(r.x).removesuffix(".0")


def test_lines_of_orders_are_not_broadcast(spark):
    from turnlattice.plans.exchange_queries import order_json

    plan = order_json(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
