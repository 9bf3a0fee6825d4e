"""Removal of long repeated byte strings by distributed prefix doubling.

A string of `length` bytes is repeated if it starts at two places of the corpus. Ranks of places decide which those are. A
rank is a number from a sort in Spark: of bytes to begin with, then of pairs (rank at a place, rank at a growing offset from
it), so that equal strings have equal ranks and different ones different ranks. Places whose rank is unique drop out before
the next sort; the rounds end at `length`.

Ranking every byte's place would sort 16 bytes and more for each byte of text in every round. Places that can't repeat, or
whose answer follows from others, are left out before, which loses none:

0. Of equal rows one goes on; all are repeated as a whole.
1. Of all GRAM-byte strings in a window of `length` bytes, the one with the least hash (the leftmost of equals) anchors it, in
   every copy of the window alike. Neighbouring windows with one anchor are a run. Runs whose anchor's hash is unique have no
   repeated window. The others are sorted by (hash, SHA-256 of their bytes); equal runs are repeated as a whole, and one of
   them stands for all in what follows. Equal rows and equal runs are the places where a digest stands for bytes: of 256
   bits, for which no two different strings with one digest are known. All other ranks come from the bytes themselves.
2. Places at every `unit` bytes from the anchor are ranked by their first 2 units, and ranks are doubled (100, 200 bytes with
   a unit of 50), always within one anchor and distance from it, as equal windows agree in both. Pairs at a last offset
   give the ranks of `length` - `unit` bytes, which all windows in a cell (from one place to the next) contain, and of
   `length` bytes.
3. A window at a place of `length` repeated bytes is repeated. Windows of a run overlap, so that all between two repeated ones
   are covered. Left are the windows before the first such place and after the last one, in cells whose rank is repeated. Where
   up to PAIRS cells are equal, the bytes before and after every two of them are compared. Where more are, the windows are
   ranked by (rank of the cell, distance from its place, bytes that the cell leaves out), together with the windows in the
   same distance of all equal cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlattice.llm import chunks
from turnlattice.llm.common import forget, hidden, partitions, release, row_ids, settled, sliced, tied, utf8, written
from turnlattice.llm.sorted_ranks import ranked

#: Bytes of a repeated string, of the anchors, and of a step between ranked places.
LENGTH, GRAM, UNIT = 400, 32, 50
#: The same for passages in prose: 50 short words have 200 bytes and more.
PASSAGE = 200
#: Equal cells that are compared in pairs, rather than sorted by the bytes around them.
PAIRS = 64
_FIELDS = ["low", "high", "anchor", "gram"]
_RUNS = "_row long, runs array<struct<low int, high int, anchor int, gram long>>"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data)
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    h = words[: n - 31] * _MIX[0]
    for k in (1, 2, 3):
        h += words[8 * k : n - 31 + 8 * k] * _MIX[k]
    h ^= h >> np.uint64(32)
    h *= _MIX[4]
    h ^= h >> np.uint64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def anchored_runs(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(first window, last window, anchor's place, anchor's hash) of all runs, in order."""
    if len(data) < length:
        return []
    width = length - GRAM + 1
    h = _gram_hashes(data)
    least = _least(h, width)
    ends = [*np.flatnonzero(least[1:] != least[:-1]).tolist(), len(least) - 1]
    grams = least.view(np.int64)
    out, at, k = [], 0, 0
    while at < len(least):
        while ends[k] < at:
            k += 1
        anchor = at + int(h[at : at + width].argmin())
        last = min(anchor, ends[k])
        out.append((at, last, anchor, int(grams[at])))
        at = last + 1
    return out


def _runs(rows: DataFrame, length: int, chosen: DataFrame) -> DataFrame:
    """_row and all its runs (low, high, anchor, gram), for those `rows` (_row, data) that `chosen` names, and maybe a few more."""
    table = chunks.bounded_filter(chosen)
    if table is None:
        rows = rows.join(chosen.toDF("_row"), "_row", "left_semi")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            if table is not None:
                batch = batch.filter(pa.array(chunks.members(table.value, batch.column("_row").to_numpy())))
            numbers, data = batch.column("_row").to_pylist(), batch.column("data")
            out = [anchored_runs(data[i].as_py(), length) for i in range(len(numbers))]
            flat = [r for runs in out for r in runs]
            columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
            parts = [pa.array(c, t) for c, t in zip(columns, [*[pa.int32()] * 3, pa.int64()], strict=True)]
            yield _lists(pa.array(numbers, pa.int64()), np.array([len(runs) for runs in out], np.int64), parts)

    return rows.select("_row", "data").mapInArrow(found, _RUNS)


def _lists(rows: pa.Array, sizes: np.ndarray, parts: list[pa.Array]) -> pa.RecordBatch:
    """A batch of _row and runs, so many for each row; rows without any are left out."""
    some = sizes > 0
    offsets = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, _FIELDS))
    return pa.RecordBatch.from_arrays([rows.filter(pa.array(some)), runs], ["_row", "runs"])


def _shared(runs: DataFrame, grams: DataFrame) -> DataFrame:
    """`runs` (_row, runs) without the runs whose gram isn't in the written table `grams`, maybe but for a few.

    A row's runs stay together: they needn't be gathered again, unless there are too many grams for a broadcast filter.
    """
    table = chunks.bounded_filter(grams)
    if table is None:
        single = runs.select("_row", F.explode("runs").alias("r")).withColumn("gram", F.col("r.gram"))
        return single.join(grams, "gram", "left_semi").groupBy("_row").agg(F.collect_list("r").alias("runs"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            parts = lists.flatten().flatten()
            some = chunks.members(table.value, parts[-1].to_numpy())
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            yield _lists(batch.column("_row"), np.bincount(row[some], minlength=len(lists)), [x.filter(pa.array(some)) for x in parts])

    return runs.mapInArrow(held, _RUNS)


def _doubled(places: DataFrame, by: list[int]) -> DataFrame:
    """Pairs (run, at, by, a, b): the ranks at a place and `by` places further on, where both are left."""
    whole = places.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("at", "name"))).alias("ranks"))
    pairs = F.flatten(F.array(*[F.transform(F.map_entries("ranks"), _pair(k)) for k in by]))
    return whole.select("run", F.explode(F.filter(pairs, lambda p: p["b"].isNotNull())).alias("p")).select("run", "p.*")


def _pair(by: int):
    return lambda e: F.struct(e["key"].alias("at"), F.lit(by).alias("by"), e["value"].alias("a"), F.try_element_at(F.col("ranks"), e["key"] + by).alias("b"))


def _rank(frame: DataFrame, keys: list[str], kept: list[str] | None = None, before: DataFrame | None = None) -> DataFrame:
    """The repeated ranks of a round, read from the table that the sort has written; that of the round before goes."""
    found = ranked(frame, keys, "run", kept=kept, repeats=True)
    if before is not None:
        forget(before)
    release(frame.sparkSession)
    return tied(found.drop("again", "fresh"), found)


def _bit(e: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), e)


def _bits(first: Column, last: Column, unit: int) -> Column:
    """The bits of those distances from 1 to `unit` - 1 that lie from `first` to `last`; no bit if one of those is null."""
    low, high = F.when(first > 1, first).otherwise(1), F.when(last < unit - 1, last).otherwise(unit - 1)
    return F.when((first <= last) & (first < unit) & (last > 0), _bit(high + 1) - _bit(low)).otherwise(F.lit(0).cast("long"))


def _cut(rows: DataFrame, held: DataFrame, start: Column, end: Column) -> DataFrame:
    """_row, r and bytes for each r in `held` (_row, runs): the bytes from `start` to `end` of its row."""
    texts = chunks.within(rows.select("_row", "data"), "_row", held.select("_row")).join(held, "_row")
    return texts.select("_row", "data", F.explode("runs").alias("r")).select("_row", "r", _part("data", start, end - start).alias("bytes"))


def _part(data: str, begin: Column, size: Column) -> Column:
    return F.substring(F.col(data), begin + 1, size)


def _paired(unit: int):
    """From cells (run, place, name, asked, answered, before, after), sorted by name, of which at most PAIRS share one: run and
    place of the first and the last window of each cell that is asked for and equals an answered one of an equal cell."""
    size = unit - 1

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first bytes agree, row by row."""
        differs = a != b
        return np.where(differs.any(axis=1), differs.argmax(axis=1), size)

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, place, asked, answered = (batch.column(c).to_numpy() for c in ("name", "place", "asked", "answered"))
        # what is missing is outside of the run, where no window is answered
        before = np.frombuffer(b"".join(x.rjust(size, b"\0") for x in batch.column("before").to_pylist()), np.uint8).reshape(-1, size)[:, ::-1]
        after = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in batch.column("after").to_pylist()), np.uint8).reshape(-1, size)
        hits = np.zeros(len(name), np.int64)
        for by in range(1, PAIRS):
            i = np.flatnonzero(name[by:] == name[:-by])
            if not len(i):
                break
            j = i + by
            low, high = unit - same(after[i], after[j]), same(before[i], before[j])
            equal = np.where(low <= high, (np.int64(2) << high) - (np.int64(1) << low), 0) & answered[i] & answered[j]
            hits[i] |= equal
            hits[j] |= equal
        hits &= asked
        some = np.flatnonzero(hits)
        hits = hits[some]
        last, first = (np.frexp(x.astype(np.float64))[1] - 1 for x in (hits & -hits, hits))  # the least and the greatest distance
        run = batch.column("run").take(pa.array(some))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([run, run]), pa.array(np.concatenate([place[some] - first, place[some] - last]), pa.int32())], ["run", "place"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last name's cells wait for the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            name = batch.column("name").to_numpy()
            at = int(np.searchsorted(name, name[-1]))
            held = batch.slice(at)
            yield windows(batch.slice(0, at))
        if held is not None:
            yield windows(held)

    return compared


def repeated(rows: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Spans (_row, start, end) that cover the repeated strings of `rows` (_row, data); they may overlap.

    `length` is a multiple of `unit` above two of them, and over GRAM. `rows` is read more than once and must give the same
    _row each time; data isn't null. Rows shorter than `length` have no spans; an empty table gives none.
    """
    if length % unit or length <= 2 * unit or length <= GRAM:
        raise ValueError("the length must be a multiple of the unit, above two units and above GRAM")
    spark = rows.sparkSession
    units = length // unit
    # of equal rows, one goes on; all are repeated as a whole
    light = written(rows.filter(F.octet_length("data") >= length).select("_row", F.octet_length("data").alias("end"), F.unhex(F.sha2("data", 256)).alias("digest")))
    alike = written(light.groupBy("digest").agg(F.min("_row").alias("first"), F.count("*").alias("n")))
    copies = written(light.join(alike.filter("n > 1").select("digest"), "digest", "left_semi").select("_row", F.lit(0).alias("start"), "end"))
    runs = written(_runs(rows, length, alike.select("first")))
    grams = written(runs.select(F.explode("runs.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    held = written(_shared(runs, grams))
    release(spark)

    forget(runs, grams, light, alike)
    release(spark)

    # a sort by range reads its rows twice, so that the texts are joined before
    cut = written(_cut(rows, held, F.col("r.low"), F.col("r.high") + length).select("_row", "r.*", F.unhex(F.sha2("bytes", 256)).alias("digest")))
    release(spark)
    # a first key that few different keys share is quick to sort by
    kinds = ranked(cut, ["digest", "gram"], "_row", kept=["gram"])
    forget(held, cut)
    release(spark)
    whole = kinds.filter("again").select("_row", F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    # of equal runs, one goes on; its windows are known to be repeated, but others may equal them
    several = written(kinds.filter("fresh").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    held = chunks.within(kinds.filter("fresh"), "gram", several).withColumnRenamed("name", "run").withColumn("single", ~F.col("again"))
    held = written(held.groupBy("_row").agg(F.collect_list(F.struct("run", "low", "high", "anchor", "gram", "single")).alias("runs")))
    runs = written(_cut(rows, held, F.col("r.low"), F.col("r.high") + length).select("_row", "r.*", "bytes"))
    forget(held)
    release(spark)

    # places at every unit from the anchor, as far as the run's bytes go
    first = F.ceil((F.col("low") - F.col("anchor")) / unit).cast("int")
    last = F.floor((F.col("high") + length - F.col("anchor")) / unit).cast("int") - 2
    places = runs.select("run", "gram", "low", "anchor", "bytes", F.explode(F.sequence(first, last)).alias("at"))
    # equal windows agree in anchor and distance; where different ones share this number, the bytes tell all the same
    near = F.col("gram").bitwiseAND(F.lit(-512)).bitwiseOR(F.col("at").bitwiseAND(511))
    places = places.select("run", "at", near.alias("near"), _part("bytes", F.col("anchor") + unit * F.col("at") - F.col("low"), F.lit(2 * unit)).alias("bytes"))
    ranks = _rank(places, ["near", "bytes"])
    size = 2
    while 2 * size < units:
        ranks = _rank(_doubled(ranks, [size]).drop("by"), ["a", "b"], before=ranks)
        size *= 2
    cell, window = units - 1 - size, units - size
    ranks = _rank(_doubled(ranks, [cell, window]), ["a", "b", "by"], kept=["by"], before=ranks)

    per_run = ranks.groupBy("run").agg(
        F.min(F.when(F.col("by") == window, F.col("at"))).alias("least"),
        F.max(F.when(F.col("by") == window, F.col("at"))).alias("most"),
        F.collect_list(F.when(F.col("by") == cell, F.struct("at", "name"))).alias("cells"),
    )
    known = [(F.col("anchor") + unit * F.col(c)).alias(c) for c in ("least", "most")]
    per_run = written(per_run.join(runs.drop("gram", "bytes"), "run").select("run", "_row", "low", "high", "anchor", "single", *known, "cells"))
    forget(ranks)
    place = F.col("anchor") + unit * F.col("at")
    inside = _bits(place - F.col("high"), place - F.col("low"), unit)
    known = _bits(place - F.col("most"), place - F.col("least"), unit)
    asked = F.when(F.col("single"), inside.bitwiseAND(F.bitwise_not(known))).otherwise(F.lit(0).cast("long"))
    cells = per_run.select("run", "low", "high", "anchor", "single", "least", "most", F.explode("cells").alias("c")).select("*", "c.*")
    cells = written(cells.select("run", "at", "name", asked.alias("asked")))
    # which distances anyone asks for, by the cell's rank; equal cells answer for all of them
    wanted = written(cells.groupBy("name").agg(F.bit_or("asked").alias("wanted"), F.count("*").alias("n")).filter("wanted != 0"))
    left = written(cells.join(wanted, "name").groupBy("run").agg(F.collect_list(F.struct("at", "name", "asked", "wanted", "n")).alias("cells")))
    ends = chunks.within(runs, "run", left.select("run")).join(left, "run").select("run", "low", "high", "anchor", "bytes", F.explode("cells").alias("c")).select("*", "c.*").drop("c", "cells")
    ends = ends.select("run", "low", place.alias("place"), "name", "n", "asked", "bytes", F.col("wanted").bitwiseAND(inside).alias("answered")).filter("answered != 0")
    begin = F.greatest(F.col("place") - F.col("low") - (unit - 1), F.lit(0))
    sides = [_part("bytes", begin, F.col("place") - F.col("low") - begin).alias("before"), _part("bytes", F.col("place") + length - unit - F.col("low"), F.lit(unit - 1)).alias("after")]
    paired = ends.filter(F.col("n") <= PAIRS).select("run", "place", "name", "asked", "answered", *sides)
    paired = paired.repartition(partitions(spark), "name").sortWithinPartitions("name").mapInArrow(_paired(unit), "run long, place int")
    both = per_run.filter("single and least is not null").select("run", F.explode(F.array("least", "most")).alias("place")).unionByName(paired)
    if not wanted.filter(F.col("n") > PAIRS).isEmpty():
        both = both.unionByName(_sorted_ends(ends.filter(F.col("n") > PAIRS), length, unit))
    spans = both.groupBy("run").agg(F.min("place").alias("start"), (F.max("place") + length).alias("end")).join(per_run.select("run", "_row"), "run").select("_row", "start", "end")
    out = written(copies.unionByName(whole).unionByName(spans))
    release(spark)
    return out


def _sorted_ends(ends: DataFrame, length: int, unit: int) -> DataFrame:
    """run and place of the windows that `ends` (cells with run, low, place, name, asked, answered, bytes) ask for and that are
    repeated, by a sort of all answered windows."""
    ends = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(unit - 1))).alias("e")).filter(F.col("answered").bitwiseAND(_bit(F.col("e"))) != 0)
    rest = F.concat(_part("bytes", F.col("place") - F.col("e") - F.col("low"), F.col("e")), _part("bytes", F.col("place") + length - unit - F.col("low"), F.lit(unit) - F.col("e")))
    open_ = F.col("asked").bitwiseAND(_bit(F.col("e"))) != 0
    ends = ends.select("run", (F.col("place") - F.col("e")).alias("place"), open_.alias("open"), (F.col("name") * unit + F.col("e")).alias("cell"), rest.alias("rest"))
    return ranked(ends, ["cell", "rest"], "run", repeats=True).filter("open").select("run", "place")


def merged(sizes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of several rows (so many each) merged where they meet: the same three arrays."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((start, row))
    base = row.astype(np.int64) << 32  # a row's places come after all of the row before
    start, end = base + start[by], np.maximum.accumulate(base + end[by])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(start)) - 1
    return np.bincount(row[at], minlength=len(sizes)), (start[at] - base[at]).astype(np.int32), (end[last] - base[at]).astype(np.int32)


def _unions(spans: DataFrame) -> DataFrame:
    """_row and its spans, merged where they meet, in order."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            start, end = (x.to_numpy() for x in lists.flatten().flatten())
            sizes, start, end = merged(lists.value_lengths().to_numpy(zero_copy_only=False), start, end)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), found], ["_row", "spans"])

    return spans.groupBy("_row").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(union, "_row long, spans array<struct<start int, end int>>")


def repeated_spans(rows: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """_row and spans (start, end): all bytes of `rows` (_row, data) that repeated strings cover; rows without any are left out."""
    return settled(rows.sparkSession, lambda: _unions(repeated(rows, length, unit)))


def longer_spans(rows: DataFrame, spans: DataFrame, length: int, unit: int = UNIT) -> DataFrame:
    """repeated_spans for a greater length, from the spans of a smaller one: a repeated string lies whole in one of those."""

    def within() -> DataFrame:
        parts = spans.select("_row", F.explode(F.filter("spans", lambda s: s["end"] - s["start"] >= length)).alias("s"))
        parts = written(row_ids(parts.select(F.col("_row").alias("_whole"), "s.*")))
        asked = written(parts.groupBy(F.col("_whole").alias("_row")).agg(F.collect_list(F.struct(F.col("_row").alias("part"), "start", "end")).alias("runs")))
        cut = written(_cut(rows, asked, F.col("r.start"), F.col("r.end")).select(F.col("r.part").alias("_row"), F.col("bytes").alias("data")))
        release(rows.sparkSession)
        found = repeated(cut, length, unit).withColumnsRenamed({"start": "_from", "end": "_to"})
        placed = found.join(parts, "_row").select(F.col("_whole").alias("_row"), (F.col("start") + F.col("_from")).alias("start"), (F.col("start") + F.col("_to")).alias("end"))
        return _unions(placed)

    return settled(rows.sparkSession, within)


def removed(documents: DataFrame, length: int = LENGTH, passage: int | None = PASSAGE, unit: int = UNIT) -> DataFrame:
    """One row for each row of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes.

    Every byte that a repeated string of `length` bytes covers counts as removed. n_passage_bytes counts the bytes that
    repeated strings of `passage` bytes cover, a smaller length whose ranks come first; None: as for `length`. A null text is
    an empty one; texts that are shorter than `length` lose nothing. Equal rows lose all that is `length` long. An empty
    table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    rows = written(row_ids(documents.select("doc_id", utf8().alias("data"))))
    short = repeated_spans(rows, passage or length, unit)
    spans = longer_spans(rows, short, length, unit) if passage else short
    kind = documents.schema["doc_id"].dataType.simpleString()
    # texts of which nothing goes are not moved
    marked = chunks.broadcast_filter(spans.select("_row"))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = chunks.members(marked.value, batch.column("_row").to_numpy()).tolist()
            data = [x.as_buffer() for x in batch.column("data")]
            kept = pc.if_else(pa.array(some, pa.bool_()), batch.column("data"), pa.scalar(None, batch.column("data").type))
            digests = pa.array([None if s else hashlib.sha256(d).hexdigest() for d, s in zip(data, some, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array([d.size for d in data], pa.int64()), kept, digests], ["_row", "doc_id", "n_bytes", "data", "digest"])

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["n_bytes", "data", "digest", "spans"]).to_pylist():
                spans = [(s["start"], s["end"]) for s in r["spans"] or ()]
                if r["data"] is not None:
                    ends = [0, *(x for s in spans for x in s), r["n_bytes"]]
                    r["digest"] = hashlib.sha256(b"".join(r["data"][a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))).hexdigest()
                out.append((r["n_bytes"], sum(b - a for a, b in spans), len(spans), r["digest"]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)), batch.column("n_passage_bytes")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    passages = short.select("_row", covered.alias("n_passage_bytes"))
    texts = rows.select("_row", "doc_id", "data").mapInArrow(light, f"_row long, doc_id {kind}, n_bytes long, data binary, digest string")
    whole = texts.join(spans, "_row", "left").join(passages, "_row", "left").withColumn("n_passage_bytes", F.coalesce("n_passage_bytes", F.lit(0).cast("long")))
    return whole.mapInArrow(result, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")


def without_repeats(documents: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """`documents` with all their columns and the texts without repeated strings; a character goes if all its bytes do.

    A null text stays null and an emptied one is empty; repeated rows lose alike; an empty table gives no rows. Columns of any
    name stay as they are. `documents` is read once: its rows are numbered in a written table.
    """
    at, short = hidden(documents, "_at", "_short")
    table = written(row_ids(documents, at))
    rows = table.select(F.col(at).alias("_row"), utf8().alias("data"))
    spans = repeated_spans(rows, length, unit)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.select(["data", "spans"]).to_pylist():
                data, begin, kept = r["data"], 0, []
                for s in r["spans"]:
                    start, end = s["start"], s["end"]
                    while start < end and 0x80 <= data[start] < 0xC0:
                        start += 1
                    while end > start and end < len(data) and 0x80 <= data[end] < 0xC0:
                        end -= 1
                    kept.append(data[begin:start])
                    begin = end
                texts.append(b"".join([*kept, data[begin:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], [at, short])

    found = chunks.within(rows, "_row", spans.select("_row")).join(spans, "_row").mapInArrow(shorten, f"`{at}` long, `{short}` string")
    return table.join(found, at, "left").withColumn("text", F.coalesce(short, "text")).drop(at, short)
