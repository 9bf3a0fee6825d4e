"""Comparison of two builds of a table by digests that no order and no partitioning changes.

A row's digest is a SHA-256 of its values. A set of rows has the sums of their digests, as numbers of 64 bits in LANES
lanes, and its size: sums merge in any order and count repeated rows. Sums are kept for ranges of a whole-number key, and
for ranges of those, up to one root. Two builds whose roots agree are equal; else the differing ranges are found from the
root down, and only their rows are compared.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lanes of 64 bits, keys of a leaf (as a power of two), and children of a node (as a power of two).
LANES, LEAF, FAN = 2, 10, 6
_WRAP = Decimal(1 << 64)


def encoded(columns: list[Column]) -> Column:
    """Values as one text that no other values give: each with its length before it, null as a dash."""
    return F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns])


def _lane(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")


def summed(n: Column, lanes: list[Column]) -> list[Column]:
    """n and the lanes of all rows of a group; sums are taken modulo 2^64."""
    return [F.sum(n).alias("n"), *[(F.sum(x) % F.lit(_WRAP)).cast("decimal(20,0)").alias(f"lane{k}") for k, x in enumerate(lanes)]]


def leaves(frame: DataFrame, key: Column, columns: list[Column], leaf: int = LEAF) -> DataFrame:
    """node (key >> leaf), n, lane0, .. of each range of keys. A null key is in node null. Sums are combined in tasks first."""
    rows = frame.select(F.shiftright(key.cast("long"), leaf).alias("node"), F.sha2(encoded(columns), 256).alias("_digest"))
    return rows.groupBy("node").agg(*summed(F.lit(1).cast("long"), [_lane(F.col("_digest"), k) for k in range(LANES)]))


def tree(frame: DataFrame, key: Column, columns: list[Column], leaf: int = LEAF, fan: int = FAN, levels: int = 4) -> DataFrame:
    """level, node, n, lane0, ..: leaves are level 0, and each level above sums 2^fan nodes; the last is the root, null.

    Each level is made of the one below, so that the rows are read once.
    """
    level = leaves(frame, key, columns, leaf)
    lanes = [F.col(f"lane{k}") for k in range(LANES)]
    out = level.select(F.lit(0).alias("level"), "*")
    for k in range(1, levels):
        above = F.shiftright("node", fan).alias("node") if k < levels - 1 else F.lit(None).cast("long").alias("node")
        level = level.groupBy(above).agg(*summed(F.col("n"), lanes))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "*"))
    return out


def differing(one: DataFrame, other: DataFrame, fan: int = FAN, levels: int = 4) -> DataFrame:
    """The leaves (node) in which two written trees differ, from the root down: below equal nodes nothing is looked at."""
    names = ["n", *(f"lane{k}" for k in range(LANES))]
    above = None
    for k in range(levels - 1, -1, -1):
        a = one.filter(F.col("level") == k).select("node", F.struct(*names).alias("_a"))
        b = other.filter(F.col("level") == k).select(F.col("node").alias("_node"), F.struct(*names).alias("_b"))
        if above is not None:
            own = F.shiftright("node", fan) if k < levels - 2 else F.lit(None).cast("long")
            a = a.join(above, own.eqNullSafe(F.col("_above")), "left_semi")
            b = b.join(above, (F.shiftright("_node", fan) if k < levels - 2 else F.lit(None).cast("long")).eqNullSafe(F.col("_above")), "left_semi")
        both = a.withColumn("_in", F.lit(True)).join(b, F.col("node").eqNullSafe(F.col("_node")), "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
        above = both.select(F.when(F.col("_in"), F.col("node")).otherwise(F.col("_node")).alias("_above"))
    return above.withColumnRenamed("_above", "node")


def row_differences(one: DataFrame, other: DataFrame, key: str, nodes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The rows of the leaves `nodes` that two tables hold a different number of times: all columns, n_one, n_other."""

    def within(frame: DataFrame, side: int) -> DataFrame:
        held = frame.join(nodes.withColumnRenamed("node", "_node"), F.shiftright(F.col(key).cast("long"), leaf).eqNullSafe(F.col("_node")), "left_semi")
        return held.withColumns({"n_one": F.lit(1 - side).cast("long"), "n_other": F.lit(side).cast("long")})

    both = within(one, 0).unionByName(within(other, 1))
    return both.groupBy(*one.columns).agg(F.sum("n_one").alias("n_one"), F.sum("n_other").alias("n_other")).filter("n_one != n_other")


def compared(one: DataFrame, other: DataFrame, key: str, trees: tuple[DataFrame, DataFrame], leaf: int = LEAF, fan: int = FAN, levels: int = 4) -> DataFrame:
    """row_differences of two tables with written trees over `key`; kind: lost, added, changed (a key lost and added) or repeated (a row more or less often)."""
    found = row_differences(one, other, key, differing(*trees, fan, levels), leaf)
    marks = found.groupBy(key).agg(F.bool_or(F.col("n_other") == 0).alias("_lost"), F.bool_or(F.col("n_one") == 0).alias("_added")).withColumnRenamed(key, "_key")
    told = found.join(marks, F.col(key).eqNullSafe(F.col("_key")))
    kind = F.when((F.col("n_one") > 0) & (F.col("n_other") > 0), "repeated").when(F.col("_lost") & F.col("_added"), "changed").when(F.col("n_other") == 0, "lost").otherwise("added")
    return told.select(*one.columns, "n_one", "n_other", kind.alias("kind"))
