"""The exact solve: 16 layers of states by categories used, from the last to the first, each one Spark job."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.functions import dice
from turnlattice.operators import states as state_rules
from turnlattice.operators import universe
from turnlattice.operators.states import states
from turnlattice.plans import kernel
from turnlattice.sources.shared import shared_folder

SCHEMA = "state_index int, mask int, upper int, layer int, value double, lower double, upper_bound double"


def _version(single_pair: bool, policy: bool) -> str:
    """A digest of the rules and of the code that computes the tables: tables of other rules or code are not taken up again."""
    parts = [inspect.getsource(m) for m in (kernel, universe, dice, state_rules)] + [SCHEMA, str(single_pair), str(policy)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def solve(spark: SparkSession, path: str | None = None, single_pair: bool = False, policy: bool = False, resume: bool = True) -> DataFrame:
    """Values and bounds of all states, written by layer under `path` (in the shared folder if none is given).

    A layer whose `_SUCCESS` is there is not computed again if `resume`; the folder's name holds a digest of rules and code. A task gets the values of the next layer as a
    broadcast of 16 MiB, which is fixed by the model. `policy` adds a column of 756 action codes a state, which stays in the
    tables and never goes to the driver.
    """
    path = f"{path or f'{shared_folder(spark)}/solve'}/{'pair' if single_pair else 'plain'}{'-policy' if policy else ''}-{_version(single_pair, policy)}"
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(hadoop)
    done = {n for n in range(16) if resume and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/layer={n}/_SUCCESS"))}
    schema = SCHEMA + (", policy binary" if policy else "")
    if len(done) < 16:
        model = spark.sparkContext.broadcast(kernel.tables(spark, single_pair))
        index = f"{path}-index-{uuid.uuid4().hex}"  # one of its own, as sessions may solve at the same time
        states(spark).repartition(8, "layer").write.mode("overwrite").partitionBy("layer").parquet(index)
        following = None
        for layer in range(15, -1, -1):
            if layer not in done:
                given = spark.sparkContext.broadcast(following)

                def backed(batches: Iterator[pa.RecordBatch], given=given, layer=layer) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        mask, upper = batch.column("mask").to_numpy().astype(np.int64), batch.column("upper").to_numpy().astype(np.int64)
                        values, codes = kernel.backup(model.value, given.value, mask, upper, policy) if layer < 15 else (np.zeros(len(mask)), np.zeros((len(mask), 756), np.uint8))
                        low, high = kernel.envelope(values, mask)
                        more = [pa.array([c.tobytes() for c in codes], pa.binary())] if policy else []
                        names = ["state_index", "mask", "upper", "layer", "value", "lower", "upper_bound"] + ["policy"] * policy
                        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:4]] + [pa.array(values), pa.array(low), pa.array(high), *more], names)

                rows = spark.read.parquet(index).filter(F.col("layer") == layer).select("state_index", "mask", "upper", F.lit(layer).alias("layer"))
                rows.repartition(64 if 3 <= layer <= 13 else 4, "mask").mapInArrow(backed, schema).write.mode("overwrite").parquet(f"{path}/layer={layer}")
            solved = spark.read.parquet(f"{path}/layer={layer}").select("mask", "upper", "value").toPandas()
            following = kernel.dense(solved, "value")
        files.delete(jvm.org.apache.hadoop.fs.Path(index), True)
    tables = [f"{path}/layer={n}" for n in range(16)]
    return spark.read.schema(schema).parquet(*tables)
