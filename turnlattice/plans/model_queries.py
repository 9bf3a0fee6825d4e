"""Queries on the model itself; they don't depend on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlattice.functions import dice
from turnlattice.functions.dice import COUNTS
from turnlattice.operators import actions as act
from turnlattice.operators import states as st
from turnlattice.operators import universe
from turnlattice.plans import oracles as o

QUERIES, SQL = {}, {}
ONE_LEFT, TWO_LEFT = 0x7FFF ^ (1 << 14), 0x7FFF ^ (1 << 14) ^ (1 << 12)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def longs(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.col(n).cast("long") for n in names or [c for c, t in frame.dtypes if t in ("int", "tinyint", "smallint")]})


def _states(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "mask int, upper int")


@query(f"WITH {o.KEEPERS} SELECT keeper_id, {o.N}, size FROM keepers")
def enum_keepers(spark, sf_dir):
    return longs(universe.keepers(spark).select("keeper_id", *COUNTS, "size"))


@query(f"WITH {o.ROLLS} SELECT roll_id, {o.N}, multiplicity FROM rolls")
def roll_multiplicity(spark, sf_dir):
    return longs(universe.rolls(spark))


@query(f"""WITH {o.ROLLS}, {o.LEGAL}, pieces AS (
  SELECT 'rolls' AS part, count(*) AS n, sum(multiplicity)::BIGINT AS total FROM rolls
  UNION ALL SELECT 'keepers', count(*), sum(size)::BIGINT FROM keepers UNION ALL SELECT 'legal', count(*), sum(size)::BIGINT FROM legal
  UNION ALL SELECT 'children', count(*) * 6, sum(size + 1)::BIGINT * 6 FROM keepers WHERE size < 5
  UNION ALL SELECT 'outcomes', count(*), sum((factorial(size::INTEGER) / ({' * '.join(f'factorial(n{i}::INTEGER)' for i in range(1, 7))}))::BIGINT)::BIGINT FROM keepers) SELECT * FROM pieces""")
def dice_universe_summary(spark, sf_dir):
    sizes = universe.keepers(spark).select(F.col("keeper_id").alias("child_id"), "size")
    parts = [("rolls", universe.rolls(spark), "multiplicity"), ("keepers", universe.keepers(spark), "size"), ("legal", universe.legal(spark), "size"), ("children", universe.children(spark).join(F.broadcast(sizes), "child_id"), "size"), ("outcomes", universe.outcomes(spark), "multiplicity")]
    out = None
    for name, frame, column in parts:
        row = frame.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum(F.col(column).cast("long")).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {o.KEEPERS} SELECT a.keeper_id, f.i AS face, b.keeper_id AS child_id FROM keepers a, range(6) f(i), keepers b
WHERE a.size < 5 AND {' AND '.join(f'b.n{i} = a.n{i} + (f.i = {i - 1})::BIGINT' for i in range(1, 7))}""")
def keeper_children(spark, sf_dir):
    return longs(universe.children(spark))


@query(f"WITH {o.ROLLS}, {o.LEGAL} SELECT roll_id, ord, keeper_id, size FROM legal")
def legal_keepers(spark, sf_dir):
    return longs(universe.legal(spark))


@query(f"WITH {o.ROLLS}, {o.LEGAL}, {o.REACHES} SELECT keeper_id, round(sum(p * (1 * n1 + 2 * n2 + 3 * n3 + 4 * n4 + 5 * n5 + 6 * n6)), 6) AS value FROM reaches JOIN rolls USING (roll_id) GROUP BY keeper_id")
def keeper_expectation(spark, sf_dir):
    """Expected sum of the dice after keeping: the keeper transform of a value by roll."""
    value = sum((F.col(c) * i for i, c in enumerate(COUNTS, 1)), F.lit(0))
    return longs(universe.reaches(spark).join(F.broadcast(universe.rolls(spark)), "roll_id").groupBy("keeper_id").agg(F.round(F.sum(F.col("p") * value), 6).alias("value")))


@query(f"WITH {o.ROLLS}, {o.MATRIX} SELECT roll_id, category, points FROM matrix")
def score_matrix(spark, sf_dir):
    return longs(universe.score_matrix(spark))


@query(f"WITH {o.ROLLS} SELECT roll_id, c.i AS category, {o.score('c.i', True)} AS points FROM rolls, range(15) c(i)")
def score_matrix_compat(spark, sf_dir):
    return longs(universe.score_matrix(spark, single_pair=True))


@query(f"WITH {o.ROLLS}, {o.MATRIX} SELECT category, count(*) AS cells, 0::BIGINT AS differences, sum(points)::BIGINT AS total FROM matrix GROUP BY category")
def score_crosscheck(spark, sf_dir):
    """Both scorers on all 3780 cells."""
    both = universe.rolls(spark).crossJoin(F.broadcast(spark.range(15).select(F.col("id").cast("int").alias("category")))).withColumn("dice", dice.dice_of(F.array(*COUNTS)))
    both = both.withColumn("a", dice.score_by("category")).withColumn("b", dice.second_score("category"))
    return longs(both.groupBy("category").agg(F.count("*").alias("cells"), F.count_if(F.col("a") != F.col("b")).alias("differences"), F.sum("b").cast("long").alias("total")))


@query(f"WITH {o.UPPERS} SELECT upper_mask, upper, row_number() OVER (PARTITION BY upper_mask ORDER BY upper) - 1 AS rank FROM uppers")
def reachable_upper(spark, sf_dir):
    return longs(st.reachable_uppers(spark).select("upper_mask", "upper", "rank"))


@query(f"WITH {o.STATES} SELECT layer, count(*) AS states FROM all_states GROUP BY layer")
def state_layers(spark, sf_dir):
    return longs(st.states(spark).groupBy("layer").agg(F.count("*").alias("states")))


@query(f"""WITH {o.UPPERS}, sizes AS (SELECT upper_mask, count(*) AS n FROM uppers GROUP BY 1),
bases AS (SELECT upper_mask, n, (coalesce(sum(n) OVER (ORDER BY upper_mask ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 512)::BIGINT AS base FROM sizes),
full_index AS (SELECT base + l.i * n + row_number() OVER (PARTITION BY upper_mask, l.i ORDER BY upper) - 1 AS state_index, upper_mask | (l.i << 6) AS mask, upper FROM uppers JOIN bases USING (upper_mask), range(512) l(i))
SELECT state_index, mask, upper FROM full_index WHERE mask % 61 = 7""")
def state_index(spark, sf_dir):
    return longs(st.states(spark).filter("mask % 61 = 7").select("state_index", "mask", "upper"))


@query(f"WITH {o.MODEL}, s AS (SELECT {ONE_LEFT} AS mask, 0 AS upper), {o.turn('s', None, 't')} SELECT mask::BIGINT AS mask, upper::BIGINT AS upper, round(value, 6) AS value FROM t_value")
def bellman_one_category(spark, sf_dir):
    """Only five alike is open: the end-to-end answer 2.301432."""
    return longs(act.turn(spark, _states(spark, [(ONE_LEFT, 0)])).value.withColumn("value", F.round("value", 6)))


@query(f"WITH {o.MODEL}, {o.STATES}, s AS (SELECT mask, upper FROM all_states WHERE layer = 14), {o.turn('s', None, 't')} SELECT mask, upper, round(value, 6) AS value FROM t_value")
def bellman_layer14(spark, sf_dir):
    return longs(act.turn(spark, st.states(spark).filter("layer = 14")).value.withColumn("value", F.round("value", 6)))


@query(f"WITH {o.STATES} SELECT layer, count(*) AS states, round(max(CASE WHEN layer = 15 THEN 0 ELSE 2 * greatest(1e-12, (16 - layer) * 1e-6) END), 9) AS width FROM all_states GROUP BY layer")
def bound_width(spark, sf_dir):
    left = 15 - F.col("layer")
    width = F.when(left == 0, 0.0).otherwise(2 * F.greatest(F.lit(1e-12), (left + 1) * 1e-6))
    return longs(st.states(spark).groupBy("layer").agg(F.count("*").alias("states"), F.round(F.max(width), 9).alias("width")))


_ZERO = f"(VALUES (0, 0), (63, 0), (63, 30), (63, 63), (31, 57), (31, 60), ({TWO_LEFT}, 0)) v(mask, upper)"


@query(f"WITH {o.MODEL}, s AS (SELECT mask::BIGINT AS mask, upper::BIGINT AS upper FROM {_ZERO}), {o.turn('s', None, 't')} SELECT mask, upper, round(value, 6) AS value FROM t_value")
def one_turn_value(spark, sf_dir):
    """The turn's value if nothing follows."""
    return longs(act.turn(spark, _states(spark, [(0, 0), (63, 0), (63, 30), (63, 63), (31, 57), (31, 60), (TWO_LEFT, 0)])).value.withColumn("value", F.round("value", 6)))


@query(f"WITH {o.MODEL}, s AS (SELECT (32767 ^ 0)::BIGINT AS mask, 0 AS upper WHERE false UNION ALL SELECT 32767 - (1 << c.i), 0 FROM range(6, 15) c(i)), {o.turn('s', None, 't')} SELECT mask, upper::BIGINT AS upper, round(value, 6) AS value FROM t_value")
def reference_turn_value(spark, sf_dir):
    """The nine lower categories alone, from ordered throws of five dice instead of multisets: a second solver."""
    wide = universe.wide_scores(spark)
    rows = wide.crossJoin(F.broadcast(spark.range(6, 15).select(F.col("id").cast("int").alias("category"))))
    best = rows.select("roll_id", "category", F.element_at(F.array(*[F.col(f"s{c}").cast("double") for c in range(15)]), F.col("category") + 1).alias("v"))
    face = spark.range(1, 7)
    ordered = face.select(F.col("id").alias("d1"))
    for i in range(2, 6):
        ordered = ordered.crossJoin(face.select(F.col("id").alias(f"d{i}")))
    throws = ordered.select(*[sum((F.when(F.col(f"d{d}") == f, 1).otherwise(0) for d in range(1, 6)), F.lit(0)).alias(f"n{f}") for f in range(1, 7)], *[f"d{d}" for d in range(1, 6)])
    keyed = throws.join(F.broadcast(universe.rolls(spark).select("roll_id", *COUNTS)), COUNTS).select("roll_id", *[f"d{d}" for d in range(1, 6)])

    # which of the five dice stay, and what they show
    held = keyed.withColumn("hold", F.explode(F.sequence(F.lit(0), F.lit(30))))
    shown = [F.when(F.col("hold").bitwiseAND(1 << (d - 1)) != 0, F.col(f"d{d}")).otherwise(0) for d in range(1, 6)]
    held = held.select("roll_id", (F.col("hold") * 7**5 + sum((x * 7**i for i, x in enumerate(shown)), F.lit(0))).alias("kept"))

    def step(v: DataFrame) -> DataFrame:
        mean = held.join(F.broadcast(v), "roll_id").groupBy("kept", "category").agg(F.avg("v").alias("v"))
        offers = held.distinct().join(mean, "kept").select("roll_id", "category", "v")
        return best.unionByName(offers).groupBy("roll_id", "category").agg(F.max("v").alias("v"))

    two = step(step(best))
    value = keyed.join(F.broadcast(two), "roll_id").groupBy("category").agg(F.round(F.avg("v"), 6).alias("value"))
    return longs(value.select((F.lit(32767) - F.call_function("shiftleft", F.lit(1), F.col("category"))).alias("mask"), F.lit(0).alias("upper"), "value"))


_LATE = f"{o.MODEL}, f AS (SELECT (32767 - (1 << 14))::BIGINT AS mask, 0::BIGINT AS upper UNION ALL SELECT 32767 - (1 << 12), 0), {o.turn('f', None, 'f')}, s AS (SELECT {TWO_LEFT}::BIGINT AS mask, 0::BIGINT AS upper), {o.turn('s', 'f_value', 't')}, {o.actions('t')}"


def late_actions(spark: SparkSession) -> DataFrame:
    """All actions of a state with two categories left: full house and five alike."""
    ends = act.turn(spark, _states(spark, [(0x7FFF ^ (1 << 14), 0), (0x7FFF ^ (1 << 12), 0)])).value
    return act.actions(spark, act.turn(spark, _states(spark, [(TWO_LEFT, 0)]), ends))


_ORDER = "row_number() OVER (PARTITION BY roll_id, rerolls ORDER BY value DESC, kind, id)"


@query(f"WITH {_LATE} SELECT roll_id, rerolls, rank, kind::BIGINT AS kind, id, round(value, 6) AS value FROM (SELECT *, {_ORDER} AS rank FROM actions) WHERE rank <= 5")
def rank_actions(spark, sf_dir):
    return longs(act.ranked(late_actions(spark), 5).select("roll_id", "rerolls", "rank", "kind", "id", F.round("value", 6).alias("value")))


@query(f"WITH {_LATE} SELECT roll_id, rerolls, kind::BIGINT AS kind, id, round(value, 6) AS value FROM (SELECT *, {_ORDER} AS rank FROM actions) WHERE rank = 1")
def best_action(spark, sf_dir):
    """The first action of each position as an aggregate: no window."""
    best = late_actions(spark).groupBy("roll_id", "rerolls").agg(F.max(F.struct("value", (-F.col("kind")).alias("k"), (-F.col("id")).alias("i"))).alias("b"))
    return longs(best.select("roll_id", "rerolls", (-F.col("b.k")).alias("kind"), (-F.col("b.i")).alias("id"), F.round("b.value", 6).alias("value")))


@query(f"""WITH {_LATE}, placed AS (SELECT *, {_ORDER} AS rank FROM actions)
SELECT roll_id, rerolls, count(*) AS n_actions, round(max(value), 6) AS best, round(max(value) - coalesce(max(value) FILTER (WHERE rank = 2), max(value)), 6) AS margin,
round(max(value) FILTER (WHERE kind = 1) - max(value) FILTER (WHERE kind = 0), 6) AS reroll_advantage FROM placed GROUP BY roll_id, rerolls""")
def decision_margin(spark, sf_dir):
    return longs(act.margins(late_actions(spark)).select("roll_id", "rerolls", "n_actions", *[F.round(c, 6).alias(c) for c in ("best", "margin", "reroll_advantage")]))


@query(f"WITH {_LATE} SELECT roll_id, rerolls, id AS category, round(max(value) OVER (PARTITION BY roll_id, rerolls) - value, 6) AS option_cost FROM actions QUALIFY kind = 0")
def option_costs(spark, sf_dir):
    best = F.max("value").over(Window.partitionBy("roll_id", "rerolls"))
    return longs(late_actions(spark).withColumn("option_cost", F.round(best - F.col("value"), 6)).filter("kind = 0").select("roll_id", "rerolls", F.col("id").alias("category"), "option_cost"))


@query(f"WITH {_LATE} SELECT roll_id, rerolls, id AS category, round(cost, 6) AS option_cost FROM (SELECT *, max(value) OVER (PARTITION BY roll_id, rerolls) - value AS cost FROM actions) WHERE kind = 0 ORDER BY round(cost, 6) DESC, roll_id, rerolls, id LIMIT 100")
def option_costs_top(spark, sf_dir):
    """A report: the 100 largest, by four keys."""
    return option_costs(spark, sf_dir).orderBy(F.desc("option_cost"), "roll_id", "rerolls", "category").limit(100)


@query(f"""WITH {o.STATES}, few AS (SELECT * FROM all_states WHERE mask % 97 = 5 AND layer < 15)
SELECT a.mask, a.upper, c.i AS category, k.i AS points, a.mask | (1 << c.i) AS next_mask, least(63, a.upper + k.i * (c.i + 1)) AS next_upper,
CASE WHEN a.upper < 63 AND a.upper + k.i * (c.i + 1) >= 63 THEN 50 ELSE 0 END::BIGINT AS bonus
FROM few a, range(6) c(i), range(6) k(i) WHERE (a.mask >> c.i) & 1 = 0 AND k.i IN (0, 5)""")
def successor_states(spark, sf_dir):
    """Successors of some states by an upper category with none or five of its face."""
    few = st.states(spark).filter("mask % 97 = 5 and layer < 15").select("mask", "upper")
    faces = few.crossJoin(F.broadcast(spark.createDataFrame([(0,), (5,)], "k int")))
    for c in range(15):
        faces = faces.withColumn(f"s{c}", F.col("k") * (c + 1) if c < 6 else F.lit(0))
    out = st.successors(faces).filter("category < 6")
    return longs(out.select("mask", "upper", "category", F.col("k").alias("points"), "next_mask", "next_upper", "bonus"))


@query(f"""WITH {o.STATES} SELECT a.upper, count(*) AS pairs FROM all_states a JOIN all_states b ON b.mask = a.mask AND b.upper = a.upper + 1 WHERE a.upper < 63 GROUP BY a.upper""")
def upper_point_pairs(spark, sf_dir):
    """States whose upper subtotal could be one higher."""
    every = st.states(spark).select("mask", "upper")
    higher = every.select("mask", (F.col("upper") - 1).alias("upper"))
    return longs(every.filter("upper < 63").join(higher, ["mask", "upper"]).groupBy("upper").agg(F.count("*").alias("pairs")))


@query(f"""WITH {o.MODEL}, {o.STATES}, s AS (SELECT mask, upper FROM all_states WHERE layer = 14), {o.turn('s', None, 't')}
SELECT a.upper, count(*) AS n, round(avg(b.value - a.value), 6) + 0 AS mean_continuation, round(avg(1 + 50 * (a.upper = 62)::INTEGER + b.value - a.value), 6) + 0 AS mean_grant
FROM t_value a JOIN t_value b ON b.mask = a.mask AND b.upper = a.upper + 1 WHERE a.upper < 63 GROUP BY a.upper""")
def upper_point_means(spark, sf_dir):
    """What one more upper point is worth where one category is left."""
    value = act.turn(spark, st.states(spark).filter("layer = 14")).value
    higher = value.select("mask", (F.col("upper") - 1).alias("upper"), F.col("value").alias("higher"))
    gain = F.col("higher") - F.col("value")
    grant = gain + 1 + F.when(F.col("upper") == 62, 50).otherwise(0)
    return longs(value.filter("upper < 63").join(higher, ["mask", "upper"]).groupBy("upper").agg(F.count("*").alias("n"), (F.round(F.avg(gain), 6) + 0).alias("mean_continuation"), (F.round(F.avg(grant), 6) + 0).alias("mean_grant")))


@query(f"""WITH {o.MODEL}, {o.STATES}, s AS (SELECT mask, upper FROM all_states WHERE layer = 14), {o.turn('s', None, 't')}
SELECT 14::BIGINT AS layer, least(12, (63 - a.upper) // 5) AS distance, count(*) AS n, round(avg(b.value - a.value), 6) + 0 AS shadow
FROM t_value a JOIN t_value b ON b.mask = a.mask AND b.upper = a.upper + 1 WHERE a.upper < 63 GROUP BY 2""")
def bonus_shadow(spark, sf_dir):
    value = act.turn(spark, st.states(spark).filter("layer = 14")).value
    higher = value.select("mask", (F.col("upper") - 1).alias("upper"), F.col("value").alias("higher"))
    distance = F.least(F.lit(12), F.floor((63 - F.col("upper")) / 5))
    return longs(value.filter("upper < 63").join(higher, ["mask", "upper"]).groupBy(F.lit(14).alias("layer"), distance.alias("distance")).agg(F.count("*").alias("n"), (F.round(F.avg(F.col("higher") - F.col("value")), 6) + 0).alias("shadow")))


@query(f"""WITH {_LATE}, placed AS (SELECT *, {_ORDER} AS rank FROM actions),
m AS (SELECT roll_id, rerolls, max(value) - coalesce(max(value) FILTER (WHERE rank = 2), max(value)) AS margin, max(value) FILTER (WHERE kind = 1) - max(value) FILTER (WHERE kind = 0) AS adv FROM placed GROUP BY ALL)
SELECT rerolls, list_aggregate(list_reverse_sort(list_filter([{o.N}], lambda x: x > 0)), 'string_agg', '-') AS pattern, sum(multiplicity)::BIGINT AS weight,
round(sum(multiplicity * margin) / sum(multiplicity), 6) AS mean_margin, round(sum(multiplicity * adv) / sum(multiplicity) FILTER (WHERE adv IS NOT NULL), 6) AS mean_reroll_advantage
FROM m JOIN rolls USING (roll_id) GROUP BY ALL""")
def structural_strata(spark, sf_dir):
    """Weighted mean margins by stage and dice pattern; a roll weighs as many throws as give it."""
    m = act.margins(late_actions(spark)).join(F.broadcast(universe.rolls(spark).withColumn("pattern", dice.pattern())), "roll_id")
    w, adv = F.col("multiplicity"), F.col("reroll_advantage")
    return longs(m.groupBy("rerolls", "pattern").agg(F.sum(w).alias("weight"), F.round(F.sum(w * F.col("margin")) / F.sum(w), 6).alias("mean_margin"), F.round(F.sum(w * adv) / F.sum(F.when(adv.isNotNull(), w)), 6).alias("mean_reroll_advantage")))


_EDGES = [0, 1e-12, 1e-8, 1e-6, 1e-4, 1e-3, 1e-2, 0.05, 0.1, 0.5, 1, 2, 5, 10]
_BIN = "CASE " + " ".join(f"WHEN margin >= {a} AND margin < {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + f" ELSE {len(_EDGES) - 1} END"


@query(f"""WITH {_LATE}, placed AS (SELECT *, {_ORDER} AS rank FROM actions),
m AS (SELECT roll_id, rerolls, count(*) AS n, round(max(value) - coalesce(max(value) FILTER (WHERE rank = 2), max(value)), 6) AS margin, max(kind) FILTER (WHERE rank = 1) AS kind FROM placed GROUP BY ALL)
SELECT rerolls, ({_BIN})::BIGINT AS bin, count(*) AS positions, count(*) FILTER (WHERE kind = 1) AS rerolling, count(*) FILTER (WHERE margin = 0 AND n > 1) AS ties FROM m GROUP BY ALL""")
def decision_atlas(spark, sf_dir):
    """Counters by stage: margin bin, positions where rerolling is best, ties."""
    from turnlattice.operators.statistics import margin_bin

    late = late_actions(spark)
    m = act.margins(late).withColumn("margin", F.round("margin", 6))
    rerolling = (F.col("reroll_advantage") > 0).cast("int")
    return longs(m.groupBy("rerolls", margin_bin(F.col("margin")).alias("bin")).agg(F.count("*").alias("positions"), F.coalesce(F.sum(rerolling), F.lit(0)).cast("long").alias("rerolling"), F.count_if((F.col("margin") == 0) & (F.col("n_actions") > 1)).alias("ties")))


_CASES = [("five_as_pair", [0, 0, 0, 0, 0, 5], 6, 12), ("pair_is_not_two", [1, 2, 1, 1, 0, 0], 7, 0), ("triple_is_not_two", [0, 3, 1, 1, 0, 0], 7, 0), ("four_is_not_two", [0, 0, 0, 4, 0, 1], 7, 0), ("five_is_not_two", [0, 0, 0, 0, 0, 5], 7, 0), ("two_with_triple", [0, 3, 0, 0, 2, 0], 7, 14), ("full_house", [0, 0, 3, 0, 0, 2], 12, 21), ("five_is_no_house", [0, 0, 0, 0, 0, 5], 12, 0), ("small_run", [1, 1, 1, 1, 1, 0], 10, 15), ("large_run", [0, 1, 1, 1, 1, 1], 11, 20)]


@query(f"""WITH {o.ROLLS}, {o.STATES}, {o.LEGAL}, cases AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {c[0]}, {c[1]}, {c[2]}, {c[3]}, {c[4]}, {c[5]}, {k}, {p})" for n, c, k, p in _CASES)}) v(id, {o.N}, category, expected))
SELECT 'rolls' AS id, count(*) AS actual, 252::BIGINT AS expected, count(*) = 252 AS passed FROM rolls
UNION ALL SELECT 'keepers', count(*), 462, count(*) = 462 FROM keepers UNION ALL SELECT 'throws', sum(multiplicity)::BIGINT, 7776, sum(multiplicity) = 7776 FROM rolls
UNION ALL SELECT 'upper_pairs', count(*), 2794, count(*) = 2794 FROM uppers UNION ALL SELECT 'states', count(*), 1430528, count(*) = 1430528 FROM all_states
UNION ALL SELECT 'legal', count(*), 4116, count(*) = 4116 FROM legal
UNION ALL SELECT id, ({o.score()})::BIGINT, expected::BIGINT, ({o.score()}) = expected FROM cases""")
def static_checks(spark, sf_dir):
    """Counts of the model and scores of boundary cases: id, actual, expected, passed."""
    counted = [("rolls", universe.rolls(spark), F.count("*"), 252), ("keepers", universe.keepers(spark), F.count("*"), 462), ("throws", universe.rolls(spark), F.sum("multiplicity").cast("long"), 7776), ("upper_pairs", st.reachable_uppers(spark), F.count("*"), 2794), ("states", st.states(spark), F.count("*"), 1430528), ("legal", universe.legal(spark), F.count("*"), 4116)]
    cases = spark.createDataFrame([(n, *c, k, p) for n, c, k, p in _CASES], "id string, n1 int, n2 int, n3 int, n4 int, n5 int, n6 int, category int, expected long")
    out = cases.select("id", dice.score_by("category").cast("long").alias("actual"), "expected")
    for name, frame, value, expected in counted:
        out = out.unionByName(frame.agg(F.lit(name).alias("id"), value.alias("actual"), F.lit(expected).cast("long").alias("expected")))
    return out.withColumn("passed", F.col("actual") == F.col("expected"))
