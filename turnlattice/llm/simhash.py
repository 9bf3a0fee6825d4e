"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into partitions, correlated bits together. If two fingerprints differ in at most d bits and the
partitions have thresholds t_i with sum d - m + 1 (-1: not probed), some partition i differs in at most t_i bits. Each
fingerprint gets its own thresholds: a dynamic programme over the partitions takes those with the fewest expected
candidates, from the exact number of fingerprints that share its value in each partition. It probes every value within
t_i of its own, and all candidates are verified on the whole fingerprint.

A probed value that over `hot` fingerprints share is not expanded into pairs. Its fingerprints, and those that probe it,
name all fingerprints within `distance` / 2 bits of themselves; two of them differ in at most `distance` bits just when
they name a common one (for distance 2: 65 names each), and a name is shared by a bounded number. That is exact.
Links become components by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlattice.llm.common import FEW, alone, forget, hidden, row_ids, settled, unsent, written

WORDS, DISTANCE, PARTS, HOT = 3, 2, 3, 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the word shingles of a UTF-8 text, as a signed 64-bit integer."""
    found = text.lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = np.array([hashed(joined, 42)], np.uint64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        begin, end = (ends - sizes)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
        hashes = np.fromiter((hashed(joined[i:j], 42) for i, j in zip(begin, end, strict=True)), np.uint64, len(begin))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """_row, doc_id and fp of each row of `documents`; a null text counts as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = [fingerprint(texts[i].as_py() or b"", words) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(fps, pa.int64())], ["_row", "doc_id", "fp"])

    rows = row_ids(documents.select("doc_id", F.encode("text", "UTF-8").alias("text")))
    return rows.select("_row", "doc_id", "text").mapInArrow(hashed, f"_row long, doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_groups(nodes: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The bits 0 to 63 in `parts` groups of near-equal size, correlated bits together.

    Counted over all fingerprints: each task sums a 65 x 64 matrix, whatever it reads.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((65, 64)), 0
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 8192):
                bits = np.unpackbits(fps[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                both[:64] += bits.T @ bits
                both[64] += bits.sum(axis=0)
            n += len(fps)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(65 * 64)), pa.array(both.ravel()), pa.array([float(n)] * (65 * 64))], ["cell", "ones", "n"])

    cells = nodes.select("fp").mapInArrow(summed, "cell long, ones double, n double").groupBy("cell").agg(F.sum("ones"), F.sum("n")).orderBy("cell").collect()
    if not cells:
        return [list(range(64))[i::parts] for i in range(parts)]
    both, n = np.array([c[1] for c in cells]).reshape(65, 64), cells[0][2]
    mean = both[64] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    alike = np.abs((both[:64] / n - np.outer(mean, mean)) / np.outer(spread, spread))
    free, groups = set(range(64)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        group = [min(free, key=lambda b: (abs(mean[b] - 0.5), b))]  # begins with an even bit
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (alike[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


#: Links of a part of a table of links.
EDGES = 500_000


def _masks(bits: list[int], radius: int) -> list[int]:
    """Every difference of exactly `radius` of these bits, as a signed 64-bit integer."""
    masks = [sum(1 << b for b in chosen) for chosen in combinations(bits, radius)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")


def _probe(part: int, whole: int):
    """From a difference to the value that is probed in a part."""
    return lambda m: F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseAND(F.lit(whole).cast("long")).bitwiseXOR(m).alias("value"))


def links(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """Links (a, b), a > b, that connect all different fingerprints of `nodes` (fp) within `distance` bits, an even number."""
    if distance % 2:  # an odd distance has no middle: one side would name one bit more
        raise ValueError("the distance must be even")
    groups = bit_groups(nodes, parts)
    wholes = [_masks(g, len(g))[0] for g in groups]
    values = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(w).cast("long")) for w in wholes])).alias("part", "value"))
    shared = written(values.groupBy("part", "value").agg(F.count("*").alias("n")))
    # sum n^2 / N is the number of fingerprints that a value near a fingerprint's own is expected to have
    known = {r["part"]: (r["near"], r["total"]) for r in shared.groupBy("part").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("near"), F.sum("n").alias("total")).collect()}
    counts = values.join(shared, ["part", "value"]).groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"_n{i}") for i in range(parts)])

    def cost(i: int, t: int) -> Column:
        if t < 0:
            return F.lit(0.0)
        balls = [len(list(combinations(groups[i], r))) for r in range(1, t + 1)]
        near = known.get(i, (1.0, 0))[0]
        uniform = known.get(i, (1.0, 1))[1] / 2.0 ** len(groups[i])
        return F.col(f"_n{i}") + F.lit(float(sum(balls)) * (1.0 + min(near, uniform)))

    # the programme's table: the cheapest way for the first i parts to use up a sum of thresholds
    table: dict[int, Column] = {0: F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("t"))}
    for i in range(parts):
        step: dict[int, list[Column]] = {}
        for used, best in table.items():
            for t in range(-1, distance + 1):
                step.setdefault(used + t, []).append(F.struct((best["cost"] + cost(i, t)).alias("cost"), F.concat(best["t"], F.array(F.lit(t))).alias("t")))
        table = {k: F.array_min(F.array(*v)) for k, v in step.items()}
    chosen = counts.select("fp", table[distance - parts + 1]["t"].alias("t"))
    probes = []
    for i, (group, whole) in enumerate(zip(groups, wholes, strict=True)):
        by_radius = [_longs([0])]
        for r in range(1, distance + 1):
            by_radius.append(_longs(_masks(group, r)))
        flips = F.flatten(F.array(*[F.when(F.col("t")[i] >= r, m).otherwise(F.array().cast("array<bigint>")) for r, m in enumerate(by_radius)]))
        probes.append(F.transform(flips, _probe(i, whole)))
    probed = chosen.select("fp", F.explode(F.concat(*probes)).alias("p")).select("fp", "p.part", "p.value").join(shared, ["part", "value"])
    probed = written(probed)
    own = values.join(shared.filter(F.col("n") <= hot), ["part", "value"])
    pairs = probed.filter(F.col("n") <= hot).select("part", "value", F.col("fp").alias("a")).join(own.select("part", "value", F.col("fp").alias("b")), ["part", "value"])
    pairs = pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    crowd = probed.filter(F.col("n") > hot)
    members = values.join(crowd.select("part", "value").distinct(), ["part", "value"], "left_semi").select("fp")
    crowd = crowd.select("fp").unionByName(members).distinct()
    flips = [0] + [m for r in range(1, distance // 2 + 1) for m in _masks(list(range(64)), r)]
    named = crowd.select("fp", F.explode(F.transform(_longs(flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("name"))
    # at most as many fingerprints share a name as there are flips
    stars = named.groupBy("name").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a != b")
    return pairs.unionByName(stars.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the links (a, b) with the least node that it is connected to.

    Rounds over few links are one task each, without shuffles.
    """

    def star(now: DataFrame, large: bool, small: bool) -> DataFrame:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else now
        both = alone(both, small)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(unsent(least, small), "a")
        if large:
            moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return alone(moved.filter("a != b"), small).distinct()

    def state(now: DataFrame) -> tuple:
        return tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum((F.xxhash64("a", "b") % 1_000_003))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    while True:
        # parts by the number of links, so that rounds over few links are few tasks
        small = before[0] <= FEW
        following = written(star(star(now, True, small), False, small).coalesce(1 + before[0] // EDGES))
        forget(now)
        now, after = following, state(following)
        if after == before:
            break
        before = after
    leaves = alone(now, before[0] <= FEW)
    return leaves.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(leaves.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(documents: DataFrame, words: int = WORDS, distance: int = DISTANCE, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """One row for each row of `documents`: _row, doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id (null: the largest) that links reach. Null and empty texts have fingerprint zero
    and link like others. Repeated rows are in one component; an empty table gives no rows.
    """
    rows = written(fingerprints(documents, words))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, distance, parts, hot))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(least, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select("_row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of `documents` with one of each group of near-duplicates: that of the smallest doc_id; all columns.

    Null and empty texts are alike; of rows that are equal one stays; an empty table gives no rows. Columns of any name stay
    as they are. `documents` is read once: its rows are numbered in a written table.
    """
    at, = hidden(documents, "_at")
    rows = written(row_ids(documents, at))
    found = settled(documents.sparkSession, lambda: near_duplicates(rows.select(F.col(at).alias("doc_id"), "text"), words, distance).select(F.col("doc_id").alias("_at"), "component_id"))
    placed = rows.select(F.col(at).alias("_at"), "doc_id").join(found, "_at")
    best = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_at")).alias("_best")).select(F.col("_best._at").alias(at))
    return rows.join(best, at, "left_semi").drop(at)
