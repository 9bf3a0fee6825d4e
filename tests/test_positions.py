"""Answers for any position against the relational form of a turn, and the audit on bad codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlattice.operators import states as st
from turnlattice.plans import kernel, positions, reference_queries
from turnlattice.plans.solve import _version


@pytest.fixture(scope="module")
def late(spark):
    """Values of the last two layers, whose bounds are one off."""
    model, after = reference_queries._late(spark)
    rows = [(int(m), int(u), *(float(after[c][m, u]) for c in ("value", "lower", "higher"))) for m, u in zip(*np.nonzero(~np.isnan(after["value"])))]
    return model, after, spark.createDataFrame(rows, "mask int, upper int, value double, lower double, upper_bound double")


def test_positions_agree_with_the_policy(spark, late):
    model, after, table = late
    mask = reference_queries.TWO_LEFT
    values, codes = kernel.backup(model, after["value"], np.array([mask]), np.array([0]), policy=True)
    asked = positions.all_positions(spark, spark.createDataFrame([(mask, 0)], "mask int, upper int"))
    rows = positions.ranked(positions.actions(asked, positions.Solved(spark, table))).collect()
    best = {(r.rerolls, r.roll_id): r for r in rows if r["rank"] == 1}
    assert len(best) == 756 and all(r.regret >= 0 and r.lower <= r.value <= r.upper_bound for r in rows)
    for (rerolls, roll), r in best.items():
        code = int(codes[0].reshape(3, 252)[rerolls, roll])
        assert r.action == (code if code < 16 else 16 + model.legal[roll][code - 16])
    mean = sum(int(model.multiplicity[roll]) * r.value for (rerolls, roll), r in best.items() if rerolls == 2) / 7776
    assert mean == pytest.approx(values[0], abs=1e-9)
    found = {(r.rerolls, r.roll_id): r for r in positions.margins(positions.actions(asked, positions.Solved(spark, table))).collect()}
    assert all(found[k].action == r.action and found[k].margin >= 0 for k, r in best.items())


def test_decisions_agree_with_all_actions(spark, late):
    model, after, table = late
    solved = positions.Solved(spark, table)
    mask = reference_queries.TWO_LEFT
    states = [(mask, 0), (mask, 40), ((1 << 15) - 1, 10), ((1 << 15) - 1 - 16, 63)]
    asked = positions.all_positions(spark, spark.createDataFrame(states, "mask int, upper int"))
    want = {(r.mask, r.upper, r.roll_id, r.rerolls): [] for r in asked.collect() if r.mask != (1 << 15) - 1}
    for r in positions.actions(asked, solved).collect():
        want[r.mask, r.upper, r.roll_id, r.rerolls].append(r)
    found = positions.decided(asked, solved).collect()
    assert len(found) == len(want)
    for r in found:
        own = sorted(want[r.mask, r.upper, r.roll_id, r.rerolls], key=lambda a: (-a.value, a.action))
        assert (r.action, r["size"], r.value, r.lower, r.upper_bound, r.actions) == (own[0].action, own[0]["size"], own[0].value, own[0].lower, own[0].upper_bound, len(own))
        assert (r.second, r.second_lower, r.second_upper) == ((own[1].value, own[1].lower, own[1].upper_bound) if len(own) > 1 else (None,) * 3)
        assert r.score_value == max(a.value for a in own if a.action < positions.KEEP)
        assert r.reroll_value == max((a.value for a in own if a.action >= positions.KEEP), default=None)


def test_any_table_of_positions(spark, late):
    model, after, table = late
    mask = reference_queries.TWO_LEFT
    rows = [("a", mask, 0, 7, 2), ("b", mask, 0, 7, 2), ("c", mask, 40, 251, 0), ("d", (1 << 15) - 1, 3, 1, 1)]
    frame = spark.createDataFrame(rows, "name string, mask long, upper long, roll_id long, rerolls long")
    solved = positions.Solved(spark, table)
    found = {r.name: r for r in positions.answered(frame, solved).collect()}
    want = {(r.upper, r.roll_id, r.rerolls): r for r in positions.margins(positions.actions(frame, solved)).collect()}
    assert set(found) == {"a", "b", "c"}
    for name, _, upper, roll, rerolls in rows[:3]:
        assert (found[name].action, found[name].value) == (want[upper, roll, rerolls].action, want[upper, roll, rerolls].value)


def test_even_states_are_those_of_a_plain_list(spark):
    layers = {}
    for r in st.states(spark).filter("layer < 15").select("layer", "state_index").collect():
        layers.setdefault(r.layer, []).append(r.state_index)
    want = set()
    for layer, indexes in layers.items():
        indexes.sort()
        picked = indexes if len(indexes) <= 32 else [indexes[i * (len(indexes) - 1) // 31] for i in range(32)]
        want |= {(layer, i, len(indexes) / len(picked)) for i in picked}
    assert {(r.layer, r.state_index, r.weight) for r in positions.even_states(st.states(spark)).collect()} == want


def test_even_states(spark):
    chosen = positions.even_states(st.states(spark))
    assert chosen.count() == 449 and chosen.groupBy("layer").agg(F.sum("weight").alias("w")).filter("w < 1").count() == 0
    assert positions.all_positions(spark, chosen).count() == 339_444


def test_audit_finds_bad_codes(spark, late):
    model, after, _ = late
    mask = reference_queries.TWO_LEFT
    codes = kernel.backup(model, after["value"], np.array([mask]), np.array([0]), policy=True)[1][0]
    bad = codes.copy()
    bad[0], bad[300], bad[600] = 0, 15, 255
    frame = lambda c: spark.createDataFrame([(mask, 13, bytearray(c.tobytes()))], "mask int, layer int, policy binary")
    assert [r.illegal for r in reference_queries.audited(spark, frame(codes)).orderBy("stage").collect()] == [0, 0, 0]
    assert [r.illegal for r in reference_queries.audited(spark, frame(bad)).orderBy("stage").collect()] == [1, 1, 1]


def test_tables_are_known_by_rules():
    assert len({_version(a, b) for a in (True, False) for b in (True, False)}) == 4


def test_positions_of_a_state_follow_each_other(spark, late):
    model, after, table = late
    frame = spark.range(50).selectExpr("'x' AS name", f"{reference_queries.TWO_LEFT} + 0 * id AS mask", "id % 60 AS upper", "id AS roll_id", "0 AS rerolls")
    plan = positions.answered(frame, positions.Solved(spark, table))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Sort [")
