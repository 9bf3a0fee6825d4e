"""Queries whose results SQL can't express: the solve, policies with bounds, and play. Tests hold them against published values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.functions import counters as rng
from turnlattice.functions import dice
from turnlattice.operators import states as st
from turnlattice.operators import universe
from turnlattice.operators.actions import tie_class
from turnlattice.plans import kernel, play, positions
from turnlattice.plans.model_queries import TWO_LEFT, longs
from turnlattice.plans.solve import solve

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _late(spark: SparkSession) -> tuple[kernel.Tables, dict[str, object]]:
    """Values and bounds of the last two layers, which is all that a state with two categories left needs."""
    model = kernel.tables(spark)
    rows = st.states(spark).filter("layer >= 14").select("mask", "upper", "layer").toPandas()
    rows["value"] = 0.0
    last = rows["layer"] == 14
    ends = kernel.dense(rows[~last], "value")
    rows.loc[last, "value"] = kernel.backup(model, ends, rows.loc[last, "mask"].to_numpy("int64"), rows.loc[last, "upper"].to_numpy("int64"))[0]
    rows["lower"], rows["higher"] = kernel.envelope(rows["value"].to_numpy(), rows["mask"].to_numpy())
    return model, {c: kernel.dense(rows, c) for c in ("value", "lower", "higher")}


def upper_gains(value: DataFrame) -> DataFrame:
    """The rows of `value` (mask, upper, layer, value) whose upper subtotal could be one higher, with the gain in value."""
    higher = value.select("mask", (F.col("upper") - 1).alias("upper"), F.col("value").alias("higher"))
    return value.filter("upper < 63").join(higher, ["mask", "upper"]).select("mask", "upper", "layer", (F.col("higher") - F.col("value")).alias("gain"))


def upper_means(gains: DataFrame) -> DataFrame:
    grant = F.col("gain") + 1 + F.when(F.col("upper") == 62, 50).otherwise(0)
    return longs(gains.groupBy("upper").agg(F.count("*").alias("n"), (F.round(F.avg("gain"), 6) + 0).alias("mean_continuation"), (F.round(F.avg(grant), 6) + 0).alias("mean_grant")))


def shadows(gains: DataFrame) -> DataFrame:
    distance = F.least(F.lit(12), F.floor((63 - F.col("upper")) / 5))
    return longs(gains.groupBy("layer", distance.alias("distance")).agg(F.count("*").alias("n"), (F.round(F.avg("gain"), 6) + 0).alias("shadow")))


@query
def upper_point_means_all(spark, sf_dir):
    """What one more upper point is worth over the states of all layers; upper_point_means has SQL, and so only layer 14."""
    return upper_means(upper_gains(solve(spark)))


@query
def bonus_shadow_all(spark, sf_dir):
    """The matrix of all layers by distance to the bonus; bonus_shadow has SQL, and so only layer 14."""
    return shadows(upper_gains(solve(spark)))


@query
def state_index_all(spark, sf_dir):
    """The index of all 1,430,528 states; state_index has SQL, and so only some masks."""
    return longs(st.states(spark).select("state_index", "mask", "upper"))


@query
def successor_states_all(spark, sf_dir):
    """Successors of all states by all open categories and attainable points; successor_states has SQL, and so only some."""
    return longs(all_successors(spark, st.states(spark).filter("layer < 15")))


def all_successors(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """One row for each state of `frame` (mask, upper), open category and points that some roll scores in it."""
    scores = universe.score_matrix(spark).select("category", "points").distinct()
    bit = F.call_function("shiftleft", F.lit(1), F.col("category"))
    rows = frame.select("mask", "upper").join(F.broadcast(scores), F.col("mask").bitwiseAND(bit) == 0)
    following = F.when(F.col("category") < 6, F.least(F.lit(63), F.col("upper") + F.col("points"))).otherwise(F.col("upper"))
    rows = rows.withColumn("next_mask", F.col("mask").bitwiseOR(bit)).withColumn("next_upper", following)
    return rows.withColumn("bonus", F.when((F.col("upper") < 63) & (F.col("next_upper") == 63), 50).otherwise(0))


@query
def solve_layer_summary(spark, sf_dir):
    """States, mean, least and greatest value and widest bound of each layer of the full solve."""
    return longs(solve(spark).groupBy("layer").agg(F.count("*").alias("states"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("greatest"), F.round(F.max(F.col("upper_bound") - F.col("lower")), 9).alias("width")))


@query
def policy_state(spark, sf_dir):
    """The 756 action codes of one state: stage, roll_id, code."""
    import numpy as np

    model, after = _late(spark)
    codes = kernel.backup(model, after["value"], np.array([TWO_LEFT]), np.array([0]), policy=True)[1][0].reshape(3, 252)
    return spark.createDataFrame([(s, r, int(codes[s, r])) for s in range(3) for r in range(252)], "stage long, roll_id long, code long")


@query
def policy_audit(spark, sf_dir):
    """Codes of one state that name a used category or a keeper which the roll doesn't have: none."""
    codes = policy_state(spark, sf_dir)
    kept = universe.legal(spark).groupBy("roll_id").agg(F.count("*").alias("n"))
    illegal = ((F.col("code") < 16) & ~F.col("code").isin(12, 14)) | ((F.col("code") >= 16) & ((F.col("stage") == 0) | (F.col("code") - 16 >= F.col("n"))))
    return codes.join(F.broadcast(kept), "roll_id").groupBy("stage").agg(F.count("*").alias("codes"), F.count_if(illegal).alias("illegal"))


@query
def action_bounds(spark, sf_dir):
    """Midpoint and bounds of scoring in each open category, and of the best keeper, for all rolls of one state."""
    import numpy as np

    model, after = _late(spark)
    mask, upper = np.array([TWO_LEFT]), np.array([0])
    found = {}
    for name, table in after.items():
        best, code = kernel.scored(model, table, mask, upper)
        kept = kernel.kept_values(model, best)
        found[name] = best[:, 0], np.array([kept[own, 0].max() for own in model.legal])
    rows = [(r, k, *(round(float(found[c][k][r]), 9) for c in ("value", "lower", "higher"))) for r in range(252) for k in (0, 1)]
    return spark.createDataFrame(rows, "roll_id long, kind long, value double, lower double, upper_bound double")


def _moments(frame: DataFrame) -> DataFrame:
    return longs(frame.groupBy("policy").agg(F.count("*").alias("games"), F.round(F.avg("final_score"), 6).alias("mean"), F.round(F.stddev_samp("final_score"), 6).alias("sd"), F.min("final_score").alias("least"), F.max("final_score").alias("greatest"), F.round(F.avg("bonus"), 6).alias("bonus_frequency"), F.round(F.avg("rerolls"), 6).alias("rerolls")))


def _heuristics(spark: SparkSession, games: int, shared: bool) -> DataFrame:
    out = None
    for policy in ("one_turn", "greedy", "bonus_priority", "fixed_priority", "random"):
        own = play.simulate(spark, policy, games, rng.seed64("policy comparison"), shared=shared)
        out = own if out is None else out.unionByName(own)
    return out


@query
def simulate_games(spark, sf_dir):
    """Five policies, one xorshift generator a game."""
    return _moments(_heuristics(spark, 2000, False))


@query
def simulate_counter(spark, sf_dir):
    """Five policies on the same dice."""
    return _moments(_heuristics(spark, 2000, True))


@query
def xorshift_stream(spark, sf_dir):
    """The first ten faces that each order's generator gives, counted."""
    import numpy as np
    import pyarrow as pa

    def drawn(batches):
        for batch in batches:
            lanes = np.arange(batch.num_rows)
            generator = rng.XorShift(rng.seed64("streams"), batch.column("o_orderkey").to_numpy())
            for i in range(10):
                counts = np.bincount(generator.integers(6, lanes), minlength=6)
                yield pa.RecordBatch.from_arrays([pa.array([i] * 6, pa.int64()), pa.array(range(1, 7), pa.int64()), pa.array(counts)], ["draw", "face", "n"])

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return orders.mapInArrow(drawn, "draw long, face long, n long").groupBy("draw", "face").agg(F.sum("n").alias("n"))


@query
def verify_run(spark, sf_dir):
    """Checks of the solve: counts, the terminal layer, finite and contained values, widths, and the value at the start."""
    v = solve(spark)
    inside = (F.col("lower") <= F.col("value")) & (F.col("value") <= F.col("upper_bound"))
    row = v.agg(F.count("*").alias("states"), F.count_if(F.isnan("value") | ~inside).alias("outside"), F.count_if((F.col("layer") == 15) & (F.col("value") != 0)).alias("terminal"), F.max(F.col("upper_bound") - F.col("lower")).alias("width"), F.max(F.when((F.col("mask") == 0) & (F.col("upper") == 0), F.col("value"))).alias("start"))
    checks = F.array(*[F.struct(F.lit(n).alias("id"), c.alias("passed")) for n, c in (("states", F.col("states") == 1430528), ("contained", F.col("outside") == 0), ("terminal_zero", F.col("terminal") == 0), ("width", F.col("width") <= 3.21e-5), ("start", F.abs(F.col("start") - 248.43998937785537) < 1e-9))])
    return row.select(F.explode(checks).alias("c")).select("c.id", "c.passed")


def _even(spark: SparkSession) -> DataFrame:
    """The decisions at all positions (339,444) of at most 32 evenly spaced states a layer, with what the reports group by."""
    chosen = positions.even_states(st.states(spark))
    asked = positions.all_positions(spark, chosen.select("mask", "upper")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mask", "upper")
    rolls = universe.wide_scores(spark).select("roll_id", "multiplicity", dice.pattern().alias("pattern"))
    # 252 rows, and 32 a layer
    found = positions.decided(asked, positions.Solved(spark, solve(spark))).join(F.broadcast(rolls), "roll_id").join(F.broadcast(chosen), ["mask", "upper"])
    kind = tie_class(F.col("actions"), (F.col("value"), F.col("lower"), F.col("upper_bound")), (F.col("second"), F.col("second_lower"), F.col("second_upper")))
    margin = F.coalesce(F.col("value") - F.col("second"), F.lit(0.0))
    return found.withColumns({"margin": margin, "advantage": F.col("reroll_value") - F.col("score_value"), "tie_class": kind, "distance": F.greatest(F.lit(0), 63 - F.col("upper")), "population": F.col("weight") * F.col("multiplicity")})


def _strata(rows: DataFrame, *by: str) -> DataFrame:
    w, a = F.col("population"), F.col("advantage")
    known = F.sum(F.when(a.isNotNull(), w))
    return longs(rows.groupBy(*by).agg(F.count("*").alias("positions"), F.round(F.sum(w), 6).alias("weight"), F.round(F.sum(w * F.col("margin")) / F.sum(w), 6).alias("margin"), F.round(F.sum(w * a) / F.nullif(known, F.lit(0.0)), 6).alias("advantage")))


@query
def structural_strata_all(spark, sf_dir):
    """Weighted population, margin and advantage of a reroll of each evenly spaced state of all layers, by rerolls left."""
    return _strata(_even(spark), "layer", "state_index", "mask", "upper", "rerolls")


@query
def pattern_strata_all(spark, sf_dir):
    """The same by layer, rerolls, distance to the bonus, pattern of the dice and size of the best keeper (-1: scoring)."""
    return _strata(_even(spark), "layer", "rerolls", "distance", "pattern", "size")


@query
def tie_classes_all(spark, sf_dir):
    """How the bounds part the two best actions of those positions, by layer."""
    return longs(_even(spark).groupBy("layer", "tie_class").agg(F.count("*").alias("positions")))


@query
def decision_atlas_all(spark, sf_dir):
    """The best action of every position of the evenly spaced states of all layers, with its value, margin and class."""
    return longs(_even(spark).select("layer", "state_index", "mask", "upper", "distance", "roll_id", "pattern", "rerolls", "action", "size", "actions", F.round("value", 6).alias("value"), F.round("margin", 6).alias("margin"), F.round("advantage", 6).alias("advantage"), "tie_class", "multiplicity"))


def audited(spark: SparkSession, table: DataFrame) -> DataFrame:
    """By stage: codes of `table` (mask, policy: 756 bytes) that tasks have seen, and those that the rules don't allow there."""
    import numpy as np
    import pyarrow as pa

    sizes = np.array([r["n"] for r in universe.legal(spark).groupBy("roll_id").agg(F.count("*").alias("n")).orderBy("roll_id").collect()])  # 252 rows

    def counted(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("policy").to_pylist()), np.uint8).reshape(-1, 3, 252).astype(np.int64)
            mask = batch.column("mask").to_numpy().astype(np.int64)[:, None, None]
            used = (codes < 16) & ((mask >> np.minimum(codes, 15) & 1 == 1) | (codes == 15))
            keeper = (codes >= 16) & ((np.arange(3)[None, :, None] == 0) | (codes - 16 >= sizes[None, None, :]))
            illegal = (used | keeper).sum(axis=(0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array([len(codes) * 252] * 3, pa.int64()), pa.array(illegal, pa.int64())], ["stage", "codes", "illegal"])

    return table.filter("layer < 15").select("mask", "policy").mapInArrow(counted, "stage long, codes long, illegal long").groupBy("stage").agg(F.sum("codes").alias("codes"), F.sum("illegal").alias("illegal"))


@query
def policy_audit_all(spark, sf_dir):
    """Illegal codes among the 756 of every state that has a turn left (1.08e9 codes), counted in tasks: none."""
    return audited(spark, solve(spark, policy=True))
