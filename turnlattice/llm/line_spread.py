"""Cross-site boilerplate lines by distinct-site spread.

Each line is known by a 96-bit hash. HyperLogLog sketches of the sites that show it are merged by aggregation, so that a
line costs one small sketch a task, however often it occurs. Lines whose estimate lies near the threshold get an exact
distinct count; lines on at least `min_sites` sites are boilerplate and go from every document. DataFrame functions only.

Lines that hold at least one in HOT_SHARE of all lines are joined by broadcast (there are at most that many of them), all
others by a shuffle on their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlattice.llm.common import hidden, written

MIN_SITES = 10
LG_K = 11
#: An estimate within this share of the threshold is checked: six times the sketch's standard error of 1.04 / sqrt(2^11).
NEAR = 0.14
HOT_SHARE = 1000


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _keys() -> list[Column]:
    """128 bits for each (doc_id, text): rows that agree in both get the same lines taken away, so that they may share a key."""
    return [F.xxhash64("doc_id", "text").alias("_k"), F.xxhash64("text", F.lit(1), "doc_id").alias("_l")]


def _lines(documents: DataFrame, *more: str) -> DataFrame:
    """The trimmed lines that aren't empty, by hash, and their place."""
    lines = documents.select(*more, F.posexplode(F.split(_text(), "\n")).alias("_at", "_line"))
    trimmed = lines.withColumn("_line", F.trim("_line")).filter("_line != ''")
    return trimmed.select(*more, "_at", F.xxhash64("_line").alias("_h"), F.hash("_line").alias("_g"))


def _of(lines: DataFrame, chosen: DataFrame, total: int) -> DataFrame:
    """The rows of `lines` that are in `chosen` (_h, _g, times), a written table; a line that is everywhere meets in no one task."""
    hot = F.broadcast(chosen.filter(F.col("times") * HOT_SHARE >= total).select("_h", "_g"))
    rest = lines.join(hot, ["_h", "_g"], "left_anti").join(chosen.filter(F.col("times") * HOT_SHARE < total).select("_h", "_g"), ["_h", "_g"], "left_semi")
    return lines.join(hot, ["_h", "_g"], "left_semi").unionByName(rest)


def boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> tuple[DataFrame, int]:
    """The lines (_h, _g, times) that at least `min_sites` different sources show, and how many lines there are in all.

    Null sources don't count as sites; `times` counts lines with a source. An empty table has none.
    """
    lines = _lines(documents.filter("source is not null"), "source")
    spread = lines.groupBy("_h", "_g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", lg_k)).alias("sites"), F.count("*").alias("times"))
    low, high = min_sites * (1 - near), min_sites * (1 + near)
    known = written(spread.filter((F.col("sites") >= int(low)) & (F.col("times") >= min_sites)).select("_h", "_g", "times", (F.col("sites") > high).alias("_sure")))
    total = lines.count()
    close = _of(lines, known.filter("not _sure").select("_h", "_g", "times"), total)
    exact = close.select("_h", "_g", "source").distinct().groupBy("_h", "_g").count().filter(F.col("count") >= min_sites)
    found = known.filter("not _sure").join(exact.select("_h", "_g"), ["_h", "_g"], "left_semi")
    return written(known.filter("_sure").unionByName(found).drop("_sure")), total


def without_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`documents` with all their columns, the text without boilerplate lines, and n_lines, n_removed.

    Lines end at a newline; they are compared without spaces at their ends, and empty ones are never boilerplate. A null text
    stays null and has 0 lines removed. Repeated rows are treated alike; an empty table gives no rows. Columns of any name
    stay, but n_lines and n_removed, which are written anew.
    """
    documents = documents.drop("n_lines", "n_removed")
    k, l, gone_at = hidden(documents, "_k", "_l", "_gone")
    spread, total = boilerplate(documents.select("text", "source"), min_sites)
    gone = _of(_lines(documents.select("text", *_keys()), "_k", "_l"), spread, total)
    gone = gone.groupBy(F.col("_k").alias(k), F.col("_l").alias(l)).agg(F.collect_set("_at").alias(gone_at))
    found = documents.withColumns(dict(zip([k, l], _keys(), strict=True))).join(gone, [k, l], "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains(gone_at, i))
    n_removed = F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at))
    return found.withColumns({"n_lines": F.size(F.split(_text(), "\n")), "n_removed": n_removed, "text": F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}).drop(gone_at, k, l)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, u.at, trim(u.line, ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS at FROM documents) u),
spread AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(s.line) AS n_removed,
         coalesce(string_agg(r.raw, chr(10) ORDER BY r.at) FILTER (WHERE s.line IS NULL), '') AS text
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS at FROM documents) r
  LEFT JOIN spread s ON trim(r.raw, ' ') = s.line GROUP BY doc_id)
SELECT doc_id, n_lines::INTEGER AS n_lines, n_removed::INTEGER AS n_removed, sha256(text) AS kept_sha256 FROM kept
"""
