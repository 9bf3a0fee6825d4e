"""Integer names for equal keys, from a distributed sort.

Names are ranks in a sort of the keys themselves, so that no hash can collide. The sort is split by range on (keys, row), so
that a key which a third of all rows share is spread over as many tasks as its rows fill; only the first and the last key
of each partition go to the driver, in a row a partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlattice.llm.common import partitions, tied, written

#: Names within a partition are below 2 ^ SHIFT, partitions above it.
SHIFT = 40


def _differs(one: list[pa.Array], other: list[pa.Array]) -> pa.Array:
    """Where two lists of columns differ, row by row."""
    out = pc.not_equal(one[0], other[0])
    for a, b in zip(one[1:], other[1:], strict=True):
        out = pc.or_(out, pc.not_equal(a, b))
    return out


def _local_names(keys: list[str], lead: int, kept: list[str], once: list[str], repeats: bool):
    """Names within one sorted partition: the number of different keys before; then a row with the partition's edges.

    _flags: 1 for the first row of its key, 2 if it isn't the only one. _edge is for the driver: names, the first and the last
    key, and if different keys share the first `lead` of them there. The keys in `kept` stay, those in `once` in fresh rows only.
    `repeats`: rows whose key no other row has are left out, but for the first and the last one, as others may go on with those.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, first, last = TaskContext.get().partitionId(), 0, None, None
        clashes: set = set()
        held = None  # a batch waits for the first key of the next one
        fields: list = []

        def done(batch: pa.RecordBatch, following: list | None) -> pa.RecordBatch:
            nonlocal count, first, last
            n, columns = batch.num_rows, [batch.column(k) for k in keys]
            edges = [[c[i].as_py() for c in columns] for i in (0, n - 1)]
            heads, tails = [c.slice(1) for c in columns], [c.slice(0, n - 1) for c in columns]
            step = _differs(heads, tails)
            if lead < len(keys):
                both = pc.and_not(step, _differs(heads[:lead], tails[:lead]))
                clashes.update(zip(*(c.filter(both).to_pylist() for c in heads[:lead]), strict=True))
                if last is not None and edges[0] != last and edges[0][:lead] == last[:lead]:
                    clashes.add(tuple(last[:lead]))
            fresh = pa.concat_arrays([pa.array([edges[0] != last]), step])
            local = pc.add(pc.cumulative_sum(fresh.cast(pa.int64())), count - 1)
            again = pc.invert(pc.and_(fresh, pa.concat_arrays([step, pa.array([edges[1] != following])])))
            first, last, count = first or edges[0], edges[1], local[-1].as_py() + 1
            own = [batch.column(f.name) if f.name not in once else pc.if_else(fresh, batch.column(f.name), pa.scalar(None, f.type)) for f in fields]
            flags = pc.add(fresh.cast(pa.int8()), pc.multiply(again.cast(pa.int8()), pa.scalar(2, pa.int8())))
            out = pa.RecordBatch.from_arrays([*own, pc.add(local, part << SHIFT), flags, pa.nulls(n, pa.binary())], [*(f.name for f in fields), "_place", "_flags", "_edge"])
            if not repeats:
                return out
            stays = pc.or_(again, pc.equal(local, 0))
            return out.filter(stays if following is not None else pa.concat_arrays([stays.slice(0, n - 1), pa.array([True])]))

        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(f) for f in batch.schema.names if f not in keys or f in kept or f in once]
            if held is not None:
                yield done(held, [batch.column(k)[0].as_py() for k in keys])
            held = batch
        if held is not None:
            yield done(held, None)
            mixed = tuple(first[:lead]) in clashes or tuple(last[:lead]) in clashes
            edge = pickle.dumps((count, first, last, mixed))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in fields), pa.array([part << SHIFT], pa.int64()), pa.nulls(1, pa.int8()), pa.array([edge])], [*(f.name for f in fields), "_place", "_flags", "_edge"])

    return name


def ranked(frame: DataFrame, keys: list[str], row: str, ranges: list[str] | None = None, kept: list[str] | None = None, once: list[str] | None = None, repeats: bool = False) -> DataFrame:
    """`frame` with its non-null `keys` replaced by `name`, `fresh` and `again`.

    name: an integer; equal keys have equal names, different keys different ones. again: another row has the same keys.
    fresh: one row of each key. `row` is a non-null column that tells the rows of one key apart. `ranges`: the first of
    `keys`, if the others follow from them all but always; only they are sampled for the bounds of partitions then.
    `kept`: keys that stay as columns; `once`: keys that stay in fresh rows only.
    `repeats`: only rows with `again` are returned.

    To `forget` the frame is to delete the written table that it reads.
    """
    spark, kept, once, lead = frame.sparkSession, kept or [], once or [], len(ranges or keys)
    fields = [f for f in frame.schema if f.name not in keys or f.name in [*kept, *once]]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("_place", T.LongType()), T.StructField("_flags", T.ByteType()), T.StructField("_edge", T.BinaryType())])
    by_range = frame.repartitionByRange(partitions(spark), *(ranges or keys), row).sortWithinPartitions(*keys, row)
    local = written(by_range.mapInArrow(_local_names(keys, lead, kept, once, repeats), schema))
    bases, total, last, mixed = [], 0, None, False
    for r in local.filter("_edge is not null").select("_place", "_edge").orderBy("_place").collect():
        count, first, end, clash = pickle.loads(r["_edge"])
        mixed = mixed or clash or (last is not None and first != last and first[:lead] == last[:lead])
        if bases and first == last:
            bases[-1][4] = True
        bases.append([r["_place"] >> SHIFT, total - (first == last), count - 1, first == last, False])
        total, last = total - (first == last) + count, end
    if lead < len(keys) and mixed:
        return ranked(frame, keys, row, kept=kept, once=once, repeats=repeats)
    base = spark.createDataFrame(bases, "_part long, _base long, _end long, _head boolean, _tail boolean")
    # a row for each partition at most, so the broadcast has a bound
    placed = local.filter("_edge is null").withColumn("_part", F.shiftright("_place", SHIFT)).withColumn("_local", F.col("_place").bitwiseAND(F.lit((1 << SHIFT) - 1))).join(F.broadcast(base), "_part")
    at_head, at_tail = F.col("_head") & (F.col("_local") == 0), F.col("_tail") & (F.col("_local") == F.col("_end"))
    flag = lambda bit: F.col("_flags").bitwiseAND(F.lit(bit).cast("byte")) != 0
    out = placed.select(*(f.name for f in fields), (F.col("_base") + F.col("_local")).alias("name"), (flag(1) & ~at_head).alias("fresh"), (flag(2) | at_head | at_tail).alias("again"))
    return tied(out.filter("again") if repeats else out, local)
