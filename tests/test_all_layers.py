"""Gains by one upper point over all layers, on made values against brute force."""

import random
from collections import defaultdict

import pytest

from turnlattice.plans import reference_queries as rq


def test_gains_of_all_layers(spark):
    rnd = random.Random(4)
    rows = {(m, u): rnd.uniform(0, 250) for m in rnd.sample(range(1 << 15), 60) for u in rnd.sample(range(64), 40)}
    frame = spark.createDataFrame([(m, u, m.bit_count(), v) for (m, u), v in rows.items()], "mask int, upper int, layer int, value double")
    means, shadow = defaultdict(list), defaultdict(list)
    for (m, u), v in rows.items():
        if u < 63 and (m, u + 1) in rows:
            means[u].append(rows[m, u + 1] - v)
            shadow[m.bit_count(), min(12, (63 - u) // 5)].append(rows[m, u + 1] - v)
    gains = rq.upper_gains(frame)
    got = {r.upper: r for r in rq.upper_means(gains).collect()}
    assert got.keys() == means.keys()
    for u, g in means.items():
        mean = sum(g) / len(g)
        assert (got[u].n, got[u].mean_continuation, got[u].mean_grant) == (len(g), pytest.approx(mean, abs=2e-6), pytest.approx(mean + 1 + 50 * (u == 62), abs=2e-6))
    got = {(r.layer, r.distance): (r.n, r.shadow) for r in rq.shadows(gains).collect()}
    assert len({layer for layer, _ in got}) > 3
    assert got == {k: (len(g), pytest.approx(sum(g) / len(g), abs=2e-6)) for k, g in shadow.items()}
