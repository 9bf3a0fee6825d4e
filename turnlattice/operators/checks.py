"""Checks of nested tables: a walk over any schema makes column expressions that tell each violation and where it is.

Paths are like $.lines[3].price; rules are asked for by pattern ($.lines[].price). All of it are JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rule: its name, and the expression that is true where a value breaks it.
Rule = tuple[str, Callable[[Column], Column]]
_NONE = "array<struct<path string, rule string>>"


def is_hash() -> Rule:
    return "hash", lambda x: ~x.rlike("^[0-9a-f]{64}$")


def is_relative() -> Rule:
    """A path without a root, a drive, a back slash or steps to itself or upward."""
    return "relative_path", lambda x: ~x.rlike(r"^(?!/)(?!.*\\)(?!.*(^|/)\.\.?(/|$))[^:]+$")


def not_empty() -> Rule:
    """For texts, arrays and maps."""
    return "empty", lambda x: F.length(x.cast("string")) == 0


def has_items() -> Rule:
    return "empty", lambda x: F.size(x) == 0


def not_negative() -> Rule:
    return "negative", lambda x: x < 0


def total(items: str, of: str) -> Rule:
    """For a struct: the numbers in the array `items` add up to the field `of`, and not to zero."""
    summed = lambda x: F.aggregate(x[items], F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b.cast("long"), F.lit(0).cast("long")))
    return "total", lambda x: (summed(x) != x[of]) | (summed(x) == 0)


def _told(at: Column, rule: str, broken: Column) -> Column:
    found = F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule")))
    return F.when(F.coalesce(broken, F.lit(False)), found).otherwise(F.array().cast(_NONE))


def _walk(value: Column, kind: T.DataType, at: Column, pattern: str, rules: dict[str, list[Rule]], nullable: set[str]) -> list[Column]:
    """Arrays of violations, one for each check, of a value and all in it."""
    out = []
    if pattern not in nullable:
        out.append(_told(at, "null", value.isNull()))
    if isinstance(kind, T.FloatType | T.DoubleType):
        out.append(_told(at, "not_finite", F.isnan(value) | (F.abs(value) == float("inf"))))
    out += [_told(at, name, value.isNotNull() & broken(value)) for name, broken in rules.get(pattern, [])]
    inner = None
    if isinstance(kind, T.StructType):
        inner = F.concat(*[c for f in kind for c in _walk(value[f.name], f.dataType, F.concat(at, F.lit(f".{f.name}")), f"{pattern}.{f.name}", rules, nullable)])
    elif isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x, i: F.concat(*_walk(x, kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), f"{pattern}[]", rules, nullable))))
    elif isinstance(kind, T.MapType):
        inner = F.flatten(F.transform(F.map_entries(value), lambda e: F.concat(*_walk(e["value"], kind.valueType, F.concat(at, F.lit("."), e["key"].cast("string")), f"{pattern}{{}}", rules, nullable))))
    if inner is not None:
        out.append(F.when(value.isNotNull(), inner).otherwise(F.array().cast(_NONE)))
    return out


def violations(frame: DataFrame, key: list[str], rules: dict[str, list[Rule]] | None = None, nullable: set[str] | None = None) -> DataFrame:
    """key, path and rule of every violation in `frame`: a row for each.

    Every value must not be null, but at the patterns in `nullable`, and every number must be finite; `rules` has more for
    patterns, "$" for the row as a whole. What is inside a null isn't looked at. An unknown pattern fails.
    """
    rules, nullable = rules or {}, nullable or set()
    known = set(patterns(frame.schema))
    if unknown := (set(rules) | nullable) - known:
        raise ValueError(f"no such place: {sorted(unknown)}")
    whole = F.struct(*[F.col(f"`{c}`") for c in frame.columns])
    found = F.concat(*_walk(whole, frame.schema, F.lit("$"), "$", rules, nullable))
    return frame.select(*key, F.explode(found).alias("_v")).select(*key, "_v.path", "_v.rule")


EXPERIMENT = "id string, kind string, source_commit string, seed string, required boolean, status string, game_count double, workers double, batches double, duration_ms double, inputs array<string>, outputs array<string>, hashes map<string, string>"
#: What holds for a row of a manifest of experiments, besides that nothing is null.
EXPERIMENT_RULES: dict[str, list[Rule]] = {
    "$": [("incomplete", lambda x: x["required"] & (x["status"] != "COMPLETE"))],
    **{f"$.{c}": [not_empty()] for c in ("kind", "source_commit", "seed")},
    **{f"$.{c}": [not_negative()] for c in ("game_count", "workers", "batches", "duration_ms")},
    **{f"$.{c}": [has_items()] for c in ("inputs", "outputs")},
    **{f"$.{c}[]": [is_relative()] for c in ("inputs", "outputs")},
    "$.hashes{}": [is_hash()],
}


def manifest_violations(experiments: DataFrame) -> DataFrame:
    """id, path and rule of what is wrong in a manifest (a table by EXPERIMENT), repeated ids included."""
    twice = experiments.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("$.id").alias("path"), F.lit("repeated").alias("rule"))
    return violations(experiments, ["id"], EXPERIMENT_RULES).unionByName(twice)


def patterns(kind: T.DataType, at: str = "$") -> list[str]:
    """All places of a schema."""
    out = [at]
    if isinstance(kind, T.StructType):
        out += [p for f in kind for p in patterns(f.dataType, f"{at}.{f.name}")]
    elif isinstance(kind, T.ArrayType):
        out += patterns(kind.elementType, f"{at}[]")
    elif isinstance(kind, T.MapType):
        out += patterns(kind.valueType, f"{at}{{}}")
    return out


def gate(found: DataFrame, key: list[str]) -> DataFrame:
    """`found`, but fails when run if there is a violation, with one of them in the message."""
    text = F.concat(F.lit("check failed at "), F.to_json(F.struct(*key)), F.lit(" "), F.col("path"), F.lit(": "), F.col("rule"))
    return found.filter(F.raise_error(text).isNull())
