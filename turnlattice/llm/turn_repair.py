"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

Rows of a conversation are put in order by a range sort over all keys, so that a conversation of any length is spread over
tasks, and become one character each: the class of the role and the row's first fault. A backward pass finds the cost to go
from each place and state of the grammar; a forward pass takes, of the edits that are on a cheapest way, the least letter.
Each letter leads to one state only, so that this gives the least of all cheapest edit strings. A task that plans a
conversation gets its characters, never its texts; texts meet the edits again in blocks of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlattice.llm.common import bound_batches, partitions, sliced, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of edits, and of a truncated row that stays.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States of the grammar (s?(ua)+)?: at the start, after s, after u, after a. The role that a state takes besides s, and the state after it.
START, ROLE, AFTER = 0, ["user", "user", "assistant", "user"], [2, 2, 3, 2]
#: Codes of rows: FIRST + 4 x role class (s, u, a, other) + fault.
FIRST = ord("A")
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows of a block are those whose places differ in the last BLOCK bits only.
BLOCK = 12
_WHITE = r"\x20\x09-\x0D"


def costs_to_go(codes: str) -> list[tuple[int, int, int, int]]:
    """For each place in `codes` and each state of the grammar, the least cost from there to the end."""
    out = [(0, INSERT_COST * 2, INSERT_COST, 0)]  # at the end: what has to be inserted still
    for code in reversed(codes):
        kind, fault = divmod(ord(code) - FIRST, 4)
        after, stay = out[-1], []
        for state in range(4):
            best = DELETE_COST + after[state]
            if fault in (OK, TRUNCATED):
                here = TRUNCATED_COST if fault == TRUNCATED else 0
                best = min(best, here + REROLE_COST + after[AFTER[state]])
                if (to := kept_state(state, kind)) is not None:
                    best = min(best, here + after[to])
            stay.append(best)
        user, assistant = min(stay[2], INSERT_COST + stay[3]), min(stay[3], INSERT_COST + stay[2])
        out.append((min(stay[0], INSERT_COST + user), min(stay[1], INSERT_COST + user), user, assistant))
    return out[::-1]


def kept_state(state: int, kind: int) -> int | None:
    """The state after a row of that role class is kept; None if the grammar doesn't take it."""
    if kind == 0:
        return 1 if state == START else None
    return AFTER[state] if kind < 3 and ROLE[state][0] == "sua"[kind] else None


def edits(codes: str) -> tuple[int, list[str]]:
    """The least cost, and for each row its edits: insertions before it and its own; with the last row what follows it, too."""
    to_go, state, out = costs_to_go(codes), START, []
    for i, code in enumerate(codes):
        kind, fault = divmod(ord(code) - FIRST, 4)
        letters, left = "", to_go[i]
        while True:
            here, after = left[state], to_go[i + 1]
            truncated = TRUNCATED_COST if fault == TRUNCATED else 0
            to = kept_state(state, kind)
            if DELETE_COST + after[state] == here:
                letters += DELETE
            elif INSERT_COST + left[AFTER[state]] == here:
                letters, state = letters + INSERT, AFTER[state]
                continue
            elif to is not None and fault in (OK, TRUNCATED) and truncated + after[to] == here:
                letters, state = letters + KEEP, to
            else:
                letters, state = letters + REROLE, AFTER[state]
            break
        out.append(letters)
    while to_go[-1][state]:  # nothing of this without rows
        out[-1], state = out[-1] + INSERT, AFTER[state]
    return to_go[0][START], out


@lru_cache(50_000)
def _short(codes: str) -> tuple[int, list[str]]:
    return edits(codes)


def illegal(codes: str) -> int:
    """Neighbours whose roles are not s u, u a or a u."""
    kinds = [(ord(c) - FIRST) // 4 for c in codes]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:], strict=False))


def state_after(state: int, letters: str, kind: int) -> int:
    """The state of the grammar after the edits of one row of that role class."""
    for letter in letters:
        if letter == KEEP:
            state = kept_state(state, kind)
        elif letter != DELETE:
            state = AFTER[state]
    return state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `conversations` with planted damage, by the CRC-32 of conv_id:turn modulo 20.

    0: the row goes; 1: an empty text; 2: a text without its [.!?]; 3: the row stands twice; 4: the role is user. In what is
    hashed, and as role and text, a null counts as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind != 0")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def placed(rows: DataFrame) -> DataFrame:
    """A written table of the rows (conv_id, turn, role, text; role and text not null) with `place`, which grows in a conversation.

    The order is turn (nulls first), role, text; of long texts their first 64 characters and a hash, since sorts compare whole
    keys. Equal rows are told apart by a number, so that as many of them as there may be are spread over tasks.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.substring("text", 1, 64).asc(), F.xxhash64("text").asc(), F.col("_twin").asc()]
    told = rows.select("conv_id", "turn", "role", "text").withColumn("_twin", F.monotonically_increasing_id())
    ordered = told.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return written(ordered.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), F.unhex(F.sha2("text", 256)).alias("digest")))


def _block() -> Column:
    return F.shiftright("place", BLOCK)


def _codes(rows: DataFrame) -> DataFrame:
    """conv_id, block and the codes of its rows in order."""
    role = F.substring("role", 1, 1)
    kind = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(f"[^{_WHITE}]"), BLANK).when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), TRUNCATED).otherwise(OK)
    light = rows.select("conv_id", "role", "digest", "place", kind.alias("kind"), fault.alias("fault"))
    seen = light.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n").toDF("_conv", "_role", "_digest", "first")
    told = light.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    first_fault = F.when((F.col("fault") != BLANK) & (F.col("place") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    coded = told.select("conv_id", _block().alias("block"), F.struct("place", F.chr(FIRST + 4 * F.col("kind") + first_fault).alias("code")).alias("c"))
    # a block has 2 ^ BLOCK rows at most
    return coded.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["code"]), "").alias("codes"))


def planned(rows: DataFrame) -> DataFrame:
    """The edits of the `placed` rows, a written table with a row for each block of a conversation.

    conv_id, block, state (of the grammar, before it), letters (the edits of each of its rows); in a conversation's first block
    also audit, cost, blank, duplicate, truncated and illegal. A task gets a conversation's codes, a byte a row, as it has to
    give the audit as one string anyway.
    """
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", "block", "state", "letters", "audit", "cost", "blank", "duplicate", "truncated", "illegal"]
    fields = [kind, T.LongType(), T.IntegerType(), T.ArrayType(T.StringType()), T.StringType(), *[T.LongType()] * 5]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for conv, blocks in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                codes = "".join(b["codes"] for b in blocks)
                cost, letters = (_short if len(codes) <= 32 else edits)(codes)
                faults = [(ord(c) - FIRST) % 4 for c in codes]
                told, at, state = ["".join(letters), cost, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal(codes)], 0, START
                for b in blocks:
                    end, begin = at + len(b["codes"]), state
                    for code, own in zip(b["codes"], letters[at:end], strict=True):
                        state = state_after(state, own, (ord(code) - FIRST) // 4)
                    out.append((conv, b["block"], begin, letters[at:end], *told))
                    at, told = end, [None] * 6
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    whole = _codes(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "codes"))).alias("blocks"))
    return written(whole.mapInArrow(plan, T.StructType([T.StructField(n, t) for n, t in zip(names, fields, strict=True)])))


def turns(rows: DataFrame, plans: DataFrame, whole: bool = False) -> DataFrame:
    """The repaired conversations: conv_id, place, step, edit (K, R or I), role, text; in order by place and step.

    `place` is that of the row an edit comes with. `rows` and `plans` are what `placed` and `planned` return. The rows of a
    block lie in one task, in order; `whole`: those of a conversation.
    """
    kind = rows.schema["conv_id"].dataType
    texts = rows.select("conv_id", _block().alias("block"), "place", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("array<string>").alias("letters"))
    given = plans.select("conv_id", "block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "state", "letters")
    keys = ["conv_id"] if whole else ["conv_id", "block"]
    # the edits of a block come before its rows
    met = texts.unionByName(given).repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions("conv_id", "block", "place")
    names = ["conv_id", "place", "step", "edit", "role", "text"]

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, letters = START, []
        for batch in sliced(batches):
            out = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text", "state", "letters")]
            for conv, place, role, text, begin, own in zip(*columns, strict=True):
                if own is not None:
                    state, letters = begin, own[::-1]
                    continue
                for step, letter in enumerate(letters.pop()):
                    if letter == KEEP:
                        out.append((conv, place, step, letter, role, text))
                        state = kept_state(state, "sua".find(role[:1]))
                    elif letter != DELETE:
                        out.append((conv, place, step, letter, ROLE[state], text if letter == REROLE else ""))
                        state = AFTER[state]
            values = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    return met.mapInArrow(rebuilt, T.StructType([T.StructField(n, t) for n, t in zip(names, [kind, T.LongType(), T.IntegerType(), *[T.StringType()] * 3], strict=True)]))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 of the lines role:text of each conversation in `turns(..., whole=True)`, as they come: one turn in memory at a time."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            kind = batch.schema.field("conv_id").type
            yield _pairs(done, kind)
        if digest is not None:
            yield _pairs([(current, digest.hexdigest())], kind)

    def _pairs(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha256"])

    return turns.select("conv_id", "role", "text").mapInArrow(hashed, T.StructType([turns.schema["conv_id"], T.StructField("sha256", T.StringType())]))


def repairs(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`, whose rows to be repaired are `rows` (conv_id, turn, role, text).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null conv_id is a conversation of its
    own; null turns come first and are no gap; a null role or text counts as one space. Of rows of one turn the order is role,
    then text (`placed`). A conversation without rows has zeros, an empty audit and the hash of an empty string; an empty table
    gives no rows; other columns are not read. A conversation may be of any length: only its codes, its audit and the
    hash of its texts in order come to one task, one text at a time.
    """
    bound_batches(conversations.sparkSession)
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    table = placed(filled)
    plans = planned(table)
    spans = table.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    told = plans.filter("audit is not null").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    parts = conversations.select("conv_id").distinct().unionByName(spans, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    parts = parts.unionByName(digests(turns(table, plans, whole=True)).withColumnRenamed("sha256", "repaired_sha256"), allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.groupBy("conv_id").agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))


#: DuckDB SQL for the query.
ORACLE = r"""
WITH RECURSIVE
bits(n, k, c) AS (SELECT n, 0, n::BIGINT FROM range(256) r(n) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(id, ''), lambda x: unicode(x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM hashed, crcs),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (SELECT *, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM numbered),
rows AS (SELECT *, fault IN (0, 3) AS stays, (fault = 3)::INTEGER AS t,
    CASE kind WHEN 0 THEN [1, NULL, NULL, NULL] WHEN 1 THEN [2, 2, NULL, 2] WHEN 2 THEN [NULL, NULL, 3, NULL] ELSE [NULL, NULL, NULL, NULL] END AS kept FROM faults),
sizes AS (SELECT conv_id, max(i) AS n FROM rows GROUP BY conv_id),
back(conv_id, i, v) AS (SELECT conv_id, n + 1, [0, 4, 2, 0] FROM sizes UNION ALL
  SELECT conv_id, i, [least(b[1], 2 + u), least(b[2], 2 + u), u, a] FROM (
    SELECT conv_id, i, b, least(b[3], 2 + b[4]) AS u, least(b[4], 2 + b[3]) AS a FROM (
      SELECT r.conv_id, r.i, list_transform([1, 2, 3, 4], lambda g: least(3 + v[g],
        CASE WHEN stays THEN t + 2 + v[[3, 3, 4, 3][g]] END, CASE WHEN stays THEN t + v[kept[g] + 1] END)) AS b
      FROM back JOIN rows r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1))),
forth(conv_id, i, g, audit, lines) AS (SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM sizes UNION ALL
  SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN g WHEN 'K' THEN kept[g + 1] ELSE [2, 2, 3, 2][g + 1] END, audit || letter,
    CASE letter WHEN 'D' THEN lines ELSE list_append(lines, CASE letter WHEN 'K' THEN role ELSE ['user', 'user', 'assistant', 'user'][g + 1] END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END) END
  FROM (SELECT f.*, r.role, r.text, r.kept, CASE WHEN 3 + m.v[g + 1] = h.v[g + 1] THEN 'D' WHEN 2 + h.v[[3, 3, 4, 3][g + 1]] = h.v[g + 1] THEN 'I'
      WHEN r.stays AND r.t + m.v[r.kept[g + 1] + 1] = h.v[g + 1] THEN 'K' ELSE 'R' END AS letter
    FROM forth f JOIN back h ON h.conv_id IS NOT DISTINCT FROM f.conv_id AND h.i = f.i
    LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i LEFT JOIN back m ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i + 1
    WHERE r.i IS NOT NULL OR h.v[g + 1] > 0)),
ended AS (SELECT f.conv_id, audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
  FROM forth f JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.n + 1 AND f.g IN (0, 3)),
pairs AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND (before, kind) NOT IN ((0, 1), (1, 2), (2, 1))) AS illegal FROM pairs GROUP BY conv_id),
told AS (SELECT c.*, v[1] AS cost, audit, repaired_sha256 FROM counts c JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1 JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id
"""
