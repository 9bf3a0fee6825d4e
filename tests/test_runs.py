"""Staged runs: lost after any stage and taken up again they end alike, and the ledger tells what happened."""

import pytest
from pyspark.sql import functions as F

from turnlattice.plans import runs
from turnlattice.plans.runs import Bound, Run, Stage

BOUNDS = {"n": Bound(100, 1, 1000), "odd": Bound(True)}


def stages(log, fail=None):
    def made(name, build):
        def f(run):
            log.append(name)
            if fail == name:
                raise RuntimeError("lost")
            return build(run)

        return f

    return [
        Stage("last", 1, made("last", lambda r: r.table("twice").join(r.table("base"), "id")), ("twice", "base")),
        Stage("base", 2, made("base", lambda r: r.spark.range(r.settings["n"]).withColumn("x", F.col("id") * 3)), ()),
        Stage("twice", 5, made("twice", lambda r: r.table("base").filter(F.col("id") % 2 == int(r.settings["odd"])).select("id")), ("base",)),
    ]


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_lost_after_each_stage(spark, tmp_path):
    want = rows(Run(spark, str(tmp_path / "whole"), stages([]), BOUNDS).run())
    for lost in ("base", "twice", "last"):
        path, log = str(tmp_path / lost), []
        assert Run(spark, path, stages(log), BOUNDS).run(stop_after=lost) is None
        before = Run(spark, path, stages(log), BOUNDS).progress()
        assert before == {"base": 2 / 8, "twice": 7 / 8, "last": 1.0}[lost]
        assert rows(Run(spark, path, stages(log), BOUNDS).run()) == want
        assert log == ["base", "twice", "last"]  # each made once


def test_a_failed_stage_is_made_again(spark, tmp_path):
    log = []
    with pytest.raises(RuntimeError):
        Run(spark, str(tmp_path), stages(log, "twice"), BOUNDS).run()
    run = Run(spark, str(tmp_path), stages(log), BOUNDS)
    assert {r.stage: r.status for r in run.status().collect()} == {"base": "COMPLETE", "twice": "FAILED_RECOVERABLE", "last": "PENDING"}
    assert run.ledger("events").filter("code = 'STAGE_FAILED'").first().message == "lost"
    run.run()
    assert log == ["base", "twice", "twice", "last"] and run.progress() == 1.0
    assert [r.status for r in run.ledger("stages").filter("stage = 'twice'").collect()] == ["RUNNING", "FAILED_RECOVERABLE", "RUNNING", "COMPLETE"]


def test_other_settings_make_all_anew(spark, tmp_path):
    log = []
    Run(spark, str(tmp_path), stages(log), BOUNDS).run()
    out = Run(spark, str(tmp_path), stages(log), BOUNDS, {"n": 10}).run()
    assert log == ["base", "twice", "last"] * 2 and out.count() == 5


def test_changed_results_are_found(spark, tmp_path):
    run = Run(spark, str(tmp_path), stages([]), BOUNDS)
    run.run()
    assert all(r.same for r in run.verify().collect())
    spark.range(100).withColumn("x", F.col("id") * 3 + F.when(F.col("id") == 50, 1).otherwise(0)).write.mode("overwrite").parquet(f"{tmp_path}/out/base")
    assert {r.stage: r.same for r in run.verify().collect()} == {"base": False, "twice": True, "last": True}


def test_settings_are_bounded():
    assert runs.resolved({"n": 1000}, BOUNDS) == {"n": 1000, "odd": True}
    for bad in ({"n": 0}, {"n": 1001}, {"n": True}, {"n": 1.5}, {"n": "5"}, {"odd": 1}, {"more": 1}):
        with pytest.raises(ValueError):
            runs.resolved(bad, BOUNDS)
    one, other = runs.settings_hash({"a": 1, "b": 2}), runs.settings_hash({"b": 2, "a": 1})
    assert one == other != runs.settings_hash({"a": 1, "b": 3})


def test_graphs():
    s = lambda name, *needs: Stage(name, 1, None, needs)
    assert [x.name for x in runs.ordered([s("c", "a", "b"), s("b", "a"), s("a")])] == ["a", "b", "c"]
    for bad in ([s("a", "b"), s("b", "a")], [s("a", "x")], [s("a"), s("a")]):
        with pytest.raises(ValueError):
            runs.ordered(bad)


def test_checks_and_preflight(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "customer.parquet"))
    found = {r.id: r.passed for r in runs.preflight(spark, str(tmp_path), {"orders": ["id", "x"], "customer": ["id"], "gone": []}).collect()}
    assert found == {"shared_folder": True, "table_orders": False, "rows_orders": True, "table_customer": True, "rows_customer": False, "table_gone": False}
    with pytest.raises(ValueError, match="table_orders"):
        Run(spark, str(tmp_path / "r"), runs.order_stages(str(tmp_path)), runs.ORDER_BOUNDS).run()
    run = Run(spark, str(tmp_path / "r"), runs.order_stages(str(tmp_path)), runs.ORDER_BOUNDS)
    assert run.ledger("checks").filter("not passed").count() == 1 and run.progress() == 0.0


def test_digest_of_any_table(spark):
    frame = spark.range(50).select("id", F.array("id").alias("a"), F.struct("id").alias("s"), F.lit(None).cast("string").alias("n"))
    assert runs.table_digest(frame) == runs.table_digest(frame.repartition(7).orderBy(F.desc("id")))
    assert runs.table_digest(frame) != runs.table_digest(frame.unionByName(frame.limit(1)))
    assert runs.table_digest(frame.limit(0))[0] == 0


def test_profiles():
    assert runs.profile("official")["games_per_run"] == 1_000_000 and runs.profile("smoke", paired_games=20)["paired_games"] == 20
    for bad in (lambda: runs.profile("official", rebuild=False), lambda: runs.profile("other"), lambda: runs.profile("smoke", games_per_run=10)):
        with pytest.raises(ValueError):
            bad()
    assert len({runs.settings_hash(runs.profile(p)) for p in runs.PROFILES}) == 3


def test_command_line(spark, tmp_path, capsys):
    from turnlattice.__main__ import main

    assert main([]) == 2
    spark.createDataFrame([(1, 5.0), (1, 2.5)], "o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "d/orders.parquet"))
    assert main(["preflight", str(tmp_path / "d")]) == 1
    spark.createDataFrame([(1, 7)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "d/customer.parquet"))
    assert main(["preflight", str(tmp_path / "d")]) == 0
    assert main(["run", str(tmp_path / "d"), str(tmp_path / "r")]) == 0 and "COMPLETE" in capsys.readouterr().out
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "r/out/report")).collect()] == [(7, 1, 2, 750)]
