"""URL filter rules by a sort-merge range join on reversed-host keys.

The key of a rule is its host with the labels reversed, a separator, and its path; every url that the rule fits has, for
one of its host's suffixes, a key that starts with it. A rule is thus an interval of keys, and rules on one host suffix
nest like brackets. Rules and keys are sorted together; a running `last` over that order carries the stack of rules that
are open at a key, and the innermost one that still covers the key is the answer. DataFrame functions only.

Only suffixes for which there are rules are kept. The sort runs within (suffix, salt): a suffix with many urls has as
many salts as its count calls for, and the rules of a suffix are repeated once for each of its salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlattice.llm.common import row_ids, written

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
URLS_A_SALT, HOT_SHARE = 50_000, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table: host, path, verdict."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _canonical(host: str, path: str) -> Column:
    """The host's labels in reverse, a separator below all that a path holds, and the path."""
    return F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.")), "."), F.lit("\x00"), F.col(path))


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule's suffix and key with all rules that cover that key, innermost first. Equal (host, path): block wins."""
    own = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    outer = own.select("host", F.col("path").alias("_prefix"), F.struct(F.length("path").alias("size"), _canonical("host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict").alias("_outer"))
    prefixes = own.select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("_prefix"))
    return prefixes.join(outer, ["host", "_prefix"]).groupBy("host", "path").agg(F.sort_array(F.collect_list("_outer"), asc=False).alias("stack")).select(F.col("host").alias("suffix"), _canonical("host", "path").alias("key"), "stack")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", urls_a_salt: int = URLS_A_SALT) -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict.

    A null url, or one without `://`, has an empty host and path, fits no rule and gets the default verdict. The longest
    rule wins (characters of host and path; then the longer host). Repeated rows are judged one by one; an empty table
    gives no rows; other columns are not read.
    """
    after = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    host = F.translate(F.regexp_extract("_after", r"^([^/?#]*)", 1), _UPPER, _LOWER)
    # rows are met again by number, so that they are numbered once
    parts = written(row_ids(pages.select("page_id", F.coalesce(after, F.lit("")).alias("_after"))))
    parts = parts.select("_row", "page_id", host.alias("host"), F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1).alias("path"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice(F.col("_labels"), i, F.size("_labels")), "."))
    offered = parts.withColumn("_labels", labels).select("_row", "path", F.explode(suffixes).alias("suffix"))
    stacks = _stacks(rules)
    # a row for each suffix that has rules and urls; those with many urls are at most HOT_SHARE, and are joined by broadcast
    counts = written(offered.groupBy("suffix").agg(F.count("*").alias("n")).join(stacks.select("suffix").distinct(), "suffix"))
    salts = counts.select("suffix", F.ceil(F.col("n") / urls_a_salt).cast("int").alias("salts"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * HOT_SHARE >= total).select("suffix")
    tagged = offered.join(F.broadcast(salts.join(hot, "suffix")), "suffix", "left")
    rest = tagged.filter("salts is null").drop("salts").join(salts.join(hot, "suffix", "left_anti"), "suffix")
    hollow = F.lit(None).cast(stacks.schema["stack"].dataType)
    keys = tagged.filter("salts is not null").unionByName(rest).select("suffix", F.pmod(F.xxhash64("_row"), F.col("salts")).cast("int").alias("salt"), _canonical("suffix", "path").alias("key"), "_row", hollow.alias("stack"))
    opened = stacks.join(salts, "suffix").select("suffix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", F.lit(None).cast("long").alias("_row"), "stack")
    # a rule comes before the keys that equal it
    order = Window.partitionBy("suffix", "salt").orderBy("key", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = keys.unionByName(opened).withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("_row is not null and stack is not null")
    covering = swept.withColumn("_over", F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))).filter("size(_over) > 0")
    hits = covering.withColumn("_over", F.col("_over")[0]).select("_row", F.struct((F.length("suffix") + F.col("_over.size")).alias("size"), F.length("suffix").alias("host_size"), F.col("_over.rule").alias("rule"), F.col("_over.verdict").alias("verdict")).alias("_hit"))
    found = parts.select("_row", "page_id", "host", "path").unionByName(hits, allowMissingColumns=True)
    by_page = found.groupBy("_row").agg(F.max("page_id").alias("page_id"), F.max("host").alias("host"), F.max("path").alias("path"), F.max("_hit").alias("_hit"))
    return by_page.select("page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))
