"""Clustering with bounds against plain rounds in Python integers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from turnlattice.llm import centroid_clusters as cc


def plain(rows, k, rounds, size, scale=64, seed=1):
    """Every distance computed; Python integers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == size and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector]))
    if not kept:
        return Counter()
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for left in range(rounds, -1, -1):
        best = [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if left:
            for j in range(len(centres)):
                if own := [v for (_, v), (_, b) in zip(kept, best, strict=True) if b == j]:
                    centres[j] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in best:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((vec_id, j, d, inertia[j], inertia.total(), digest[j]) for (vec_id, _), (d, j) in zip(kept, best, strict=True))


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, vector string, cluster string").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_rounds(spark, seed):
    rnd = np.random.default_rng(seed)
    size = 6
    points = rnd.normal(0, 1, (5, size))[rnd.integers(0, 5, 150)] + rnd.normal(0, 0.2, (150, size))
    if seed == 2:  # a coarse grid: many equal distances
        points = np.round(points * 2) / 2
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    rows += [rows[3]] * 40 + [(None, rows[4][1]), (None, rows[5][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [None] * 6), (904, [float("nan")] + [1.0] * 5), (905, [float("inf")] * 6)]
    out = cc.clusters(table(spark, rows), k=7, rounds=3, size=size)
    assert Counter(map(tuple, out.collect())) == plain(rows, 7, 3, size)


def test_few_and_none(spark):
    two = [(1, [0.5, -0.26]), (2, [2.0, 1.0]), (3, [0.5, -0.26])]
    assert Counter(map(tuple, cc.clusters(table(spark, two), size=2).collect())) == plain(two, 16, 3, 2)
    same = [(i, [1.0, 1.0]) for i in range(30)]  # all centroids equal: all but the first are empty and stay
    assert Counter(map(tuple, cc.clusters(table(spark, same), size=2).collect())) == plain(same, 16, 3, 2)
    out = cc.clusters(table(spark, [(1, None)]), size=2)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large(spark):
    with pytest.raises(Exception, match="reaches"):
        cc.clusters(table(spark, [(1, [3e9, 0.0])]), size=2).collect()


@pytest.mark.parametrize("scale", [3, 40, 100_000_000])
def test_bounds_hold_and_save(scale):
    rnd = np.random.default_rng(scale)
    vectors = (rnd.integers(-2, 3, (4000, 8)) * scale + rnd.integers(-scale // 3, scale // 3 + 1, (4000, 8))).clip(1 - cc.MOST, cc.MOST - 1)
    centres = vectors[:12].copy()
    own, upper, lower = cc.begun(vectors, centres)
    spent = 0
    for _ in range(8):
        before, centres = centres, centres.copy()
        for j in range(12):
            if (own == j).any():
                centres[j] = vectors[own == j].sum(axis=0) // (own == j).sum()
        upper, lower = cc.moved(own, upper, lower, before, centres)
        exact = cc.distances(vectors, centres)
        for squared, bound, side in ((exact, lower, 1), (exact[np.arange(4000), own], upper, -1)):
            assert ((np.sqrt(squared) - bound.astype(np.float64)) * side >= -1e-9 * np.sqrt(squared)).all()
        own, upper, lower, computed = cc.reassigned(vectors, centres, own, upper, lower)
        assert (own == exact.argmin(axis=1)).all()
        spent += computed
    assert spent < 0.7 * 8 * 4000 * 12  # of all distances
