"""Statistics on any table against plain Python: wide sums, visit groups, paired rows."""

import statistics
from collections import defaultdict

from turnlattice.operators import statistics as stat


def test_wide_moments_leave_64_bits(spark):
    values = [4_000_000_000 + i for i in range(50)] + [-5, 0]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 7)], "g string, x long").repartition(3)
    rows = {r.g: r for r in stat.moments(frame, "x", "g", wide=True).collect()}
    assert (rows["a"].n, int(rows["a"]["sum"]), int(rows["a"].sum_sq)) == (52, sum(values), sum(v * v for v in values))
    found = {r.g: r for r in stat.spread(stat.moments(frame, "x", "g", wide=True)).collect()}
    assert abs(found["a"].sd - statistics.stdev(values)) < 1e-3 and abs(found["a"]["mean"] - statistics.mean(values)) < 1e-3
    assert (found["b"].sd, found["b"].ci95_low, found["b"].ci95_high) == (0.0, 7.0, 7.0)


def test_visit_groups_leave_out_missing_advantages(spark):
    rows = [(1, 2, 5, 10, "3-2", 3, 1.0, 2.0), (1, 2, 6, 10, "3-2", 3, 3.0, None), (1, 0, 5, 10, "3-2", -1, 4.0, None), (1, 2, 5, 70, "3-2", 3, 1.0, 8.0), (1, 2, 7, 10, "3-2", 3, 9.0, 9.0)]
    frame = spark.createDataFrame(rows, "turn int, rerolls int, mask int, upper int, pattern string, size int, margin double, advantage double")
    want = defaultdict(list)
    for t, r, m, u, p, s, margin, advantage in rows:
        want[t, r, m.bit_count(), max(0, 63 - u), p, s].append((margin, advantage))
    for r in stat.visit_groups(frame).collect():
        own = want.pop((r.turn, r.rerolls, r.used, r.distance, r.pattern, r["size"]))
        known = [a for _, a in own if a is not None]
        assert (r.n, r.mean_margin, r.mean_advantage) == (len(own), statistics.mean(m for m, _ in own), statistics.mean(known) if known else None)
    assert not want


def test_paired_rows(spark):
    values = [3.0, -1.0, 0.0, 0.0, 10.0, 2.0, -4.0]
    row = stat.paired(spark.createDataFrame([(v,) for v in values], "d double"), "d").first()
    assert (row.n, row.median, row["min"], row["max"]) == (7, 0.0, -4.0, 10.0)
    assert abs(row["mean"] - statistics.mean(values)) < 1e-12 and abs(row.sd - statistics.stdev(values)) < 1e-12
    assert (row.win_rate, row.tie_rate, row.loss_rate) == (3 / 7, 2 / 7, 2 / 7)
