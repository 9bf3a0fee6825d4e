import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlattice.functions import counters as rng
from turnlattice.functions import dice
from turnlattice.operators import selection
from turnlattice.operators import statistics as stat
from turnlattice.plans import kernel, model_queries, play
from turnlattice.plans.solve import solve
from turnlattice.sources import binary, reports
from turnlattice.streaming import batches

CASES = [((6, 6, 6, 6, 6), 6, 12), ((1, 2, 2, 3, 4), 7, 0), ((2, 2, 2, 3, 4), 7, 0), ((4, 4, 4, 4, 6), 7, 0), ((2, 2, 2, 5, 5), 7, 14), ((3, 3, 3, 6, 6), 12, 21), ((6, 6, 6, 6, 6), 12, 0), ((1, 2, 3, 4, 5), 10, 15), ((2, 3, 4, 5, 6), 11, 20)]


def _scored(spark, cases, single_pair=False):
    rows = spark.createDataFrame([(list(d), c) for d, c, _ in cases], "dice array<int>, category int")
    counted = rows.withColumn("c", dice.counts_of("dice"))
    wide = counted.select("category", *[F.col("c")[i].alias(f"n{i + 1}") for i in range(6)])
    return [r[0] for r in wide.select(dice.score_by("category", single_pair)).collect()]


def test_scores(spark):
    assert _scored(spark, CASES) == [p for *_, p in CASES]
    assert _scored(spark, [((4, 4, 4, 4, 6), 7, 8), ((2, 2, 2, 5, 5), 7, 14)], single_pair=True) == [8, 14]
    with pytest.raises(Exception, match="five faces"):
        _scored(spark, [((1, 2, 3, 4, 7), 0, 0)])


def test_one_category(spark):
    assert abs(model_queries.bellman_one_category(spark, "").first().value - 2.301432) < 1e-9


def test_counters(spark):
    games = spark.range(500).withColumnRenamed("id", "g")
    seed = rng.seed64("test")
    rows = rng.potential_die(rng.counter_uint(games, seed, "u", game=F.col("g"), turn=3, roll=1, slot=2), seed, "face", game=F.col("g"), turn=3, slot=4).orderBy("g").collect()
    index = np.arange(500)
    assert [r.u for r in rows] == rng.counter_array(seed, game=index, turn=3, roll=1, slot=2).tolist()
    assert [r.face for r in rows] == (rng.counter_int_array(seed, 6, game=index, turn=3, slot=4) + 1).tolist()
    pairs = rng.game_seeds(games, seed, "g").orderBy("g").collect()
    lanes = rng.XorShift(seed, index)
    assert [r.seed_a for r in pairs] == lanes.words[0].tolist() and [r.seed_b for r in pairs] == lanes.words[1].tolist()
    faces = np.concatenate([lanes.integers(6, index) for _ in range(20)])
    assert set(faces) == set(range(6)) and all((w[0] != w[1]) for w in lanes.words)


@pytest.mark.parametrize("policy", ["greedy", "bonus_priority", "fixed_priority", "random", "one_turn"])
def test_play_is_partition_invariant(spark, policy):
    model = kernel.tables(spark)
    for shared in (True, False):
        whole = play.play(model, policy, 77, np.arange(40), None, shared)
        part = play.play(model, policy, 77, np.arange(25, 40), None, shared)
        assert (whole.total[25:] == part.total).all() and (whole.fills[25:] == part.fills).all()
        assert (np.sort(whole.fills, axis=1) == np.arange(1, 16)).all() and (whole.mask == dice.ALL_USED).all()
        assert (whole.scores.sum(axis=1) + 50 * whole.bonus == whole.total).all() and ((whole.raw >= 63) == whole.bonus).all()


def test_quantiles_are_order_statistics(spark):
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 101):
        values = np.sort(rnd.integers(0, 30, n))
        counts = stat.histogram(spark.createDataFrame([(int(v),) for v in values], "v int"), "v", 0, 40)
        got = {r.q: r.value for r in stat.quantiles(counts).collect()}
        assert got == {q: int(values[int(np.floor(q * (n - 1)))]) for q in stat.QUANTILES}


def test_statistics_edges(spark):
    one = spark.createDataFrame([(0, 0)], "k int, n int")
    low, high = stat.wilson(F.col("k"), F.col("n"))
    assert tuple(one.select(low, high).first()) == (0.0, 0.0)
    flat = spark.createDataFrame([(1, 2), (1, 3)], "x int, y int")
    assert stat.pearson(flat, "x", "y").first().correlation == 0
    bins = spark.createDataFrame([(0.0,), (0.05,), (9.99,), (10.0,), (float("inf"),)], "m double").select(stat.margin_bin(F.col("m")).alias("b"))
    assert [r.b for r in bins.collect()] == [0, 7, 12, 13, 13]
    with pytest.raises(ValueError):
        selection.even_sample(flat, "x", 1)


@pytest.fixture(scope="module")
def solved(spark, tmp_path_factory):
    return solve(spark, str(tmp_path_factory.mktemp("solve") / "plain"))


def test_full_solve(spark, solved, tmp_path):
    """Every value and bound of all 1,430,528 states, to the bit."""
    start = solved.filter("mask = 0 and upper = 0").first()
    assert (start.value, start.lower, start.upper_bound) == (248.43998937785537, 248.43997337785535, 248.44000537785539)
    values, bounds = str(tmp_path / "values.bin"), str(tmp_path / "bounds.bin")
    assert binary.write_table(solved, values, binary.VALUES) == "59880282ab231bc87992d7e02751b4469525f2d73e555aea35ba63eadfc5a582"
    assert binary.write_table(solved, bounds, binary.BOUNDS) == "03d977013c8827a422191213c3562c4b24d165a72a4ee9a484b7da7e0e5cc458"
    back = binary.read_table(spark, values, binary.VALUES)
    assert back.join(solved.select("state_index", F.col("value").alias("v")), "state_index").filter("value != v").isEmpty() and back.count() == 1430528
    with pytest.raises(ValueError):
        binary.check_header(b"x" * 200, binary.VALUES)


def test_policy_file(spark, tmp_path):
    rows = spark.createDataFrame([(i, bytes([i]) * 756) for i in (2, 0, 1)], "state_index int, policy binary")
    binary.write_policy(rows, str(tmp_path / "policy.bin"))
    data = (tmp_path / "policy.bin").read_bytes()
    assert binary.check_header(data, binary.POLICY) == 3 and data[128:] == b"".join(bytes([i]) * 756 for i in range(3))


def test_optimal_play(spark, solved):
    games = play.simulate(spark, "optimal", 1200, 5, solved).agg(F.avg("final_score").alias("m"), F.stddev("final_score").alias("s"), F.count("*").alias("n")).first()
    assert abs(games.m - 248.44) <= 4 * games.s / games.n**0.5


def test_reports_and_ledger(spark, tmp_path):
    frame = spark.createDataFrame([("a,b", 1), ('q"q', None)], "x string, y int")
    reports.write_csv(frame, str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.option("header", True).option("escape", '"').schema("x string, y int").csv(str(tmp_path / "csv")).collect()} == {("a,b", 1), ('q"q', None)}
    assert reports.markdown(frame.limit(1)) == "| x | y |\n| --- | --- |\n| a,b | 1 |\n"
    assert "a,b & 1" in reports.latex(frame.limit(1))
    for step, value in enumerate(["old", "new"]):
        reports.record(spark, str(tmp_path / "ledger"), "b1", {"state": value}, step)
    assert [tuple(r) for r in reports.current(spark, str(tmp_path / "ledger"), "b1").collect()] == [("state", "new")]


def test_stream_folds_batches(spark, tmp_path):
    for part in range(2):
        spark.createDataFrame([("r", part * 10 + i, 100 + i, i % 2) for i in range(10)], batches.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        row = batches.games(spark, str(tmp_path / "in"), str(tmp_path / "fold")).first()
    assert (row.n, row.sum_x, row.sum_bonus) == (20, 2 * sum(range(100, 110)), 10)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 1
