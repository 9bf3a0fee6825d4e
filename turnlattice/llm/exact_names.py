"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed size. All blocks of the corpus are sorted, and equal neighbours get one
integer name. Adjacent names of a document are then paired, the pairs sorted and named again, until one name is left
for each document. Names are ranks in a sort of the contents themselves, so that no hash can collide.

Blocks are sorted by (hash, content), so that range bounds are sampled from hashes and not from contents. If different
blocks of one hash meet an edge between partitions, the sort is done again by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlattice.llm.common import hidden, row_ids, settled, utf8, written
from turnlattice.llm.sorted_ranks import ranked

BLOCK_BYTES = 1024
#: Groups that hold at least one in so many rows are joined by broadcast; so there are at most that many of them.
HOT_SHARE = 1000


def identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `documents`: doc_id, text_sha256, and its identity (level, name).

    Null texts are empty; repeated rows are answered each; an empty table gives no rows.
    """
    size = F.octet_length("_bytes")
    whole = row_ids(documents.select("doc_id", utf8().alias("_bytes")))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / block_bytes).cast("int"), F.lit(1)) - 1), lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = (
        whole.select("_row", "doc_id", F.sha2("_bytes", 256).alias("text_sha256"), cut.alias("_blocks"))
        .select("_row", "doc_id", "text_sha256", F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("_i", "_block"))
        .withColumn("text_sha256", F.when(F.col("_i") == 0, F.col("text_sha256")))
    )
    named = ranked(blocks.withColumn("_hash", F.xxhash64("_block")), ["_hash", "_block"], "_row", ["_hash"])
    heads = named.filter("_i = 0").select("_row", "doc_id", "text_sha256")
    level, done = 0, named.filter("_n = 1").select("_row", F.lit(0).alias("level"), "name")
    rest = named.filter("_n > 1").select("_row", "_i", "_n", "name")
    while not rest.isEmpty():
        level += 1
        pairs = rest.groupBy("_row", F.expr("_i div 2").alias("_i"), F.expr("(_n + 1) div 2").alias("_n")).agg(F.max(F.expr("if(_i % 2 = 0, name, null)")).alias("_a"), F.coalesce(F.max(F.expr("if(_i % 2 = 1, name, null)")), F.lit(-1)).alias("_b"))
        named = ranked(pairs.withColumn("_i", F.col("_i").cast("int")).withColumn("_n", F.col("_n").cast("int")), ["_a", "_b"], "_row")
        done = done.unionByName(named.filter("_n = 1").select("_row", F.lit(level).alias("level"), "name"))
        rest = named.filter("_n > 1")
    return heads.join(done, "_row")


def exact_duplicates(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `documents`: doc_id, keep_id, group_size, kept, text_sha256, and _row.

    Texts are equal when their bytes are; a null text is an empty one. Of equal texts the row with the largest doc_id
    stays (null is the smallest; of rows repeated with that doc_id one stays). An empty table gives no rows, and other
    columns are not read.
    """
    rows = settled(documents.sparkSession, lambda: identities(documents, block_bytes))
    groups = written(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_best")))
    # rows of a large group never meet in one task
    hot = F.col("group_size") * HOT_SHARE >= rows.count()
    tagged = rows.join(F.broadcast(groups.filter(hot)), ["level", "name"], "left")
    rest = tagged.filter("group_size is null").select(*rows.columns).join(groups.filter(~hot), ["level", "name"])
    return tagged.filter("group_size is not null").unionByName(rest).select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256", "_row")


def deduplicated(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents` whose text no other row with a larger doc_id has, with all their columns.

    Null texts are empty ones; of rows that are equal in doc_id and text one stays; an empty table gives no rows. Columns of
    any name stay as they are. `documents` is read once: its rows are numbered in a written table.
    """
    at, = hidden(documents, "_at")
    rows = written(row_ids(documents, at))
    found = settled(documents.sparkSession, lambda: exact_duplicates(rows.select(F.col(at).alias("doc_id"), "text"), block_bytes))
    # the operator keeps the largest id; here ids are row numbers, so the right row is chosen within its group
    placed = rows.select(F.col(at).alias("_at"), "doc_id").join(found.select(F.col("doc_id").alias("_at"), "keep_id"), "_at")
    best = placed.groupBy("keep_id").agg(F.max(F.struct("doc_id", "_at")).alias("_best")).select(F.col("_best._at").alias(at))
    return rows.join(best, at, "left_semi").drop(at)
