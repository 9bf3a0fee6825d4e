"""DuckDB SQL of the model, for the driver's comparison: written apart from the Spark code, on generator tables."""

from __future__ import annotations

from turnlattice.functions.counters import COUNTERS, MIX

N = "n1, n2, n3, n4, n5, n6"
KEEPERS = f"""keepers AS (SELECT row_number() OVER (ORDER BY size, {N}) - 1 AS keeper_id, * FROM (
  SELECT a.i AS n1, b.i AS n2, c.i AS n3, d.i AS n4, e.i AS n5, f.i AS n6, a.i + b.i + c.i + d.i + e.i + f.i AS size
  FROM range(6) a(i), range(6) b(i), range(6) c(i), range(6) d(i), range(6) e(i), range(6) f(i)) WHERE size <= 5)"""
_WAYS = " * ".join(f"factorial(n{i}::INTEGER)" for i in range(1, 7))
ROLLS = f"{KEEPERS},\nrolls AS (SELECT keeper_id - 210 AS roll_id, {N}, (120 / ({_WAYS}))::BIGINT AS multiplicity FROM keepers WHERE size = 5)"
_LEQ = " AND ".join(f"k.n{i} <= r.n{i}" for i in range(1, 7))
_DIFF = " * ".join(f"factorial((r.n{i} - k.n{i})::INTEGER)" for i in range(1, 7))
LEGAL = f"legal AS (SELECT roll_id, row_number() OVER (PARTITION BY roll_id ORDER BY {', '.join(f'k.n{i}' for i in range(1, 7))}) - 1 AS ord, keeper_id, k.size FROM rolls r JOIN keepers k ON k.size <= 4 AND {_LEQ})"
REACHES = f"reaches AS (SELECT keeper_id, roll_id, factorial((5 - size)::INTEGER)::DOUBLE / ({_DIFF})::DOUBLE / pow(6, 5 - size) AS p FROM rolls r JOIN keepers k ON {_LEQ})"


def highest(least: int, times: int) -> str:
    return "CASE " + " ".join(f"WHEN n{f} >= {least} THEN {times * f}" for f in range(6, 0, -1)) + " ELSE 0 END"


def score(category: str = "category", single_pair: bool = False) -> str:
    pairs = " + ".join(f"(n{f} >= 2)::INTEGER" for f in range(1, 7))
    worth = " + ".join(f"{2 * f} * (n{f} >= 2)::INTEGER" for f in range(1, 7))
    three = "CASE " + " ".join(f"WHEN n{f} = 3 THEN {3 * f}" for f in range(1, 7)) + " END"
    two = "CASE " + " ".join(f"WHEN n{f} = 2 THEN {2 * f}" for f in range(1, 7)) + " END"
    return f"""(CASE WHEN {category} < 6 THEN ([{N}])[{category} + 1] * ({category} + 1)
    WHEN {category} = 6 THEN {highest(2, 2)}
    WHEN {category} = 7 THEN CASE WHEN {pairs} >= 2 THEN {worth} ELSE {highest(2, 2) if single_pair else 0} END
    WHEN {category} = 8 THEN {highest(3, 3)} WHEN {category} = 9 THEN {highest(4, 4)}
    WHEN {category} = 10 THEN 15 * (n6 = 0 AND greatest({N}) = 1)::INTEGER
    WHEN {category} = 11 THEN 20 * (n1 = 0 AND greatest({N}) = 1)::INTEGER
    WHEN {category} = 12 THEN coalesce({three} + {two}, 0)
    WHEN {category} = 13 THEN n1 + 2 * n2 + 3 * n3 + 4 * n4 + 5 * n5 + 6 * n6
    ELSE 50 * (greatest({N}) = 5)::INTEGER END)"""


MATRIX = f"matrix AS (SELECT roll_id, c.i AS category, {score('c.i')} AS points FROM rolls, range(15) c(i))"
UPPERS = "u0 AS (SELECT m.i AS upper_mask, 0::BIGINT AS upper FROM range(64) m(i)),\n" + ",\n".join(
    f"u{f} AS (SELECT DISTINCT upper_mask, least(63, upper + k.i * {f}) AS upper FROM u{f - 1}, range(6) k(i) WHERE k.i = 0 OR (upper_mask >> {f - 1}) & 1 = 1)" for f in range(1, 7)
) + ",\nuppers AS (SELECT * FROM u6)"
STATES = f"{UPPERS},\nall_states AS (SELECT upper_mask | (l.i << 6) AS mask, upper, bit_count(upper_mask | (l.i << 6))::BIGINT AS layer FROM uppers, range(512) l(i))"


def turn(states: str, following: str | None, tag: str) -> str:
    """CTEs <tag>_score, _best, _keep1, _one, _keep2, _two, _value for a CTE of states (mask, upper)."""
    after = "coalesce(f.value, 0)" if following else "0"
    join = f"LEFT JOIN {following} f ON f.mask = o.mask | (1 << o.category) AND f.upper = o.next_upper" if following else ""
    return f"""{tag}_open AS (SELECT s.mask, s.upper, m.roll_id, m.category, m.points, CASE WHEN m.category < 6 THEN least(63, s.upper + m.points) ELSE s.upper END AS next_upper
  FROM {states} s, matrix m WHERE (s.mask >> m.category) & 1 = 0),
{tag}_score AS (SELECT o.mask, o.upper, o.roll_id, o.category, o.points + CASE WHEN o.upper < 63 AND o.next_upper = 63 THEN 50 ELSE 0 END + {after} AS value FROM {tag}_open o {join}),
{tag}_best AS (SELECT mask, upper, roll_id, max(value) AS value FROM {tag}_score GROUP BY ALL),
{tag}_keep1 AS (SELECT mask, upper, keeper_id, sum(p * value) AS value FROM {tag}_best JOIN reaches USING (roll_id) GROUP BY ALL),
{tag}_one AS (SELECT b.mask, b.upper, b.roll_id, greatest(any_value(b.value), max(k.value)) AS value FROM {tag}_best b JOIN legal l USING (roll_id) JOIN {tag}_keep1 k ON k.mask = b.mask AND k.upper = b.upper AND k.keeper_id = l.keeper_id GROUP BY ALL),
{tag}_keep2 AS (SELECT mask, upper, keeper_id, sum(p * value) AS value FROM {tag}_one JOIN reaches USING (roll_id) GROUP BY ALL),
{tag}_two AS (SELECT b.mask, b.upper, b.roll_id, greatest(any_value(b.value), max(k.value)) AS value FROM {tag}_best b JOIN legal l USING (roll_id) JOIN {tag}_keep2 k ON k.mask = b.mask AND k.upper = b.upper AND k.keeper_id = l.keeper_id GROUP BY ALL),
{tag}_value AS (SELECT mask, upper, sum(multiplicity * value) / 7776 AS value FROM {tag}_two JOIN rolls USING (roll_id) GROUP BY ALL)"""


MODEL = f"{ROLLS},\n{LEGAL},\n{REACHES},\n{MATRIX}"


def actions(tag: str) -> str:
    """CTE actions (mask, upper, roll_id, rerolls, kind, id, value)."""
    return f"""actions AS (
  SELECT mask, upper, roll_id, r.i AS rerolls, 0 AS kind, category AS id, round(value, 9) AS value FROM {tag}_score, range(3) r(i)
  UNION ALL SELECT mask, upper, roll_id, 1, 1, keeper_id, round(value, 9) FROM {tag}_keep1 JOIN legal USING (keeper_id)
  UNION ALL SELECT mask, upper, roll_id, 2, 1, keeper_id, round(value, 9) FROM {tag}_keep2 JOIN legal USING (keeper_id))"""


def _times(x: str, k: int) -> str:
    return f"((({x})::HUGEINT * {k}) & 4294967295)::BIGINT"


def counter(source: str, seed: int, **counters: str) -> str:
    """A query: the columns of `source` and u, the counter number; counters not given are 0."""
    out = f"SELECT *, 0::BIGINT AS u FROM {source}"
    low, high = seed & 0xFFFFFFFF, seed >> 32
    for i, (name, k) in enumerate(COUNTERS.items()):
        own = _times(f"({counters.get(name, '0')} + 1)", k)
        base = f"{low}::BIGINT" if i == 0 else f"xor(u, {high}::BIGINT)" if i == 1 else "u"
        out = f"SELECT * REPLACE (xor({base}, {own}) AS u) FROM ({out})"
        for shift, m in ((16, MIX[0]), (15, MIX[1])):
            out = f"SELECT * REPLACE ({_times(f'xor(u, u >> {shift})', m)} AS u) FROM ({out})"
        out = f"SELECT * REPLACE (xor(u, u >> 16) AS u) FROM ({out})"
    return out
