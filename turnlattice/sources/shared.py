"""Tables that an operator writes on its way: in the folder that driver and executors share, gone when Python ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a range partition should have; an estimate beyond KNOWN_BYTES says that Catalyst doesn't know.
PARTITION_BYTES, KNOWN_BYTES = 128 << 20, 1 << 50


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnlattice-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    """A place of its own in the shared folder, which goes when Python ends."""
    path = f"{shared_folder(spark)}/turnlattice-{uuid.uuid4().hex}"
    atexit.register(delete, weakref.ref(spark), path)
    return path


def written(frame: DataFrame) -> DataFrame:
    """`frame` as a Parquet table in the shared folder, read again: positions and random choices hold from then on."""
    path = fresh_path(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def delete(session: weakref.ref, path: str) -> None:
    spark = session()
    if spark is not None and spark.sparkContext._jsc is not None:
        files, place = filesystem(spark, path)
        files.delete(place, True)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of `path`, and the path in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def range_partitions(frame: DataFrame) -> int:
    """How many range partitions `frame` should have: by Catalyst's estimate of its bytes if it has one, and those of any shuffle at least."""
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // PARTITION_BYTES) if size <= KNOWN_BYTES else least
