"""Small helpers that the operators share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes of an Arrow batch, by which Spark hands rows to Python; with texts, ten thousand rows are a lot of memory.
BATCH_BYTES = 4 << 20

#: Rows of a few numbers each that one task takes.
FEW = 200_000

#: The written tables by the frames that read them, and those that the innermost `settled` of this thread has seen.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lets Arrow batches in `spark` end at BATCH_BYTES, unless a session has a setting of its own; no result depends on it.

    The setting stays, since frames that operators return are run after they have returned.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if re.fullmatch(r"\d+b", spark.conf.get(name)):  # a default is told in bytes
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only on a local master without it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnlattice-"))
    return context.getCheckpointDir()


def hidden(frame: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores before it until no column of `frame` has that name (in any case)."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def written(frame: DataFrame) -> DataFrame:
    """`frame` as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors.

    The table goes when the session's Python ends.
    """
    spark = frame.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/turnlattice-{uuid.uuid4().hex}"
    with _whole_partitions(spark):
        frame.write.option("compression", "zstd").parquet(path)  # a quarter less than the default for texts, in the same time
    if (own := _OWN.get()) is not None:
        own.append(path)
    atexit.register(_remove, weakref.ref(spark), path)
    out = spark.read.schema(frame.schema).parquet(path)
    _PATHS[out] = path
    return out


@contextmanager
def _whole_partitions(spark: SparkSession) -> Iterator[None]:
    """Lets Spark put small shuffle partitions together up to the advisory size, rather than keep one for each core: many of the
    tables written on the way are small, and each part is a task and two files."""
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` has returned and nothing reads any more."""
    for table in tables:
        _remove(weakref.ref(table.sparkSession), _PATHS.pop(table))


def tied(frame: DataFrame, table: DataFrame) -> DataFrame:
    """`frame`, to forget which is to delete the written table that `table` reads."""
    _PATHS[frame] = _PATHS[table]
    return frame


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """build() as a written table. The tables that it wrote on its way are deleted, and shuffle files with them.

    Tables that other threads write meanwhile stay.
    """
    own: list[str] = []
    token = _OWN.set(own)
    try:
        frame = build()
    finally:
        _OWN.reset(token)
    out = written(frame)
    for path in own:
        _remove(weakref.ref(spark), path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of stages that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(session: weakref.ref, path: str) -> None:
    spark = session()
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def with_answers(frame: DataFrame, added: list[T.StructField], begin: Callable[[], Callable[[pa.Array], list[tuple]]]) -> DataFrame:
    """`frame` with the columns `added`, in place of those that have such names already.

    begin() is called once in each task; what it returns gives a tuple of the new values for each of a batch's texts. Columns
    of any type and name stay; they have plain names within, as Spark takes dots and back quotes in names apart.
    """
    rest = frame.drop(*(f.name for f in added))
    plain = [f"c{i}" for i in range(len(rest.columns))]
    text = rest.columns.index("text")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = begin()
        for batch in batches:
            columns = list(zip(*answer(batch.column(text)), strict=True)) if batch.num_rows else [[] for _ in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*plain, *names])

    names = [f"n{i}" for i in range(len(added))]
    kinds = [{"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}[f.dataType.simpleString()] for f in added]
    fields = [T.StructField(n, f.dataType) for n, f in zip([*plain, *names], [*rest.schema, *added], strict=True)]
    return rest.toDF(*plain).mapInArrow(answered, T.StructType(fields)).toDF(*rest.columns, *(f.name for f in added))


def few(*tables: DataFrame) -> bool:
    """If the rows of these written tables together are one task's work."""
    return sum(t.count() for t in tables) <= FEW


def alone(frame: DataFrame, small: bool) -> DataFrame:
    """`frame` in one part if it is `small`: it is grouped without a shuffle then, and so are frames in one part joined.

    The driver keeps account of each task of a shuffle.
    """
    return frame.coalesce(1) if small else frame


def unsent(frame: DataFrame, small: bool) -> DataFrame:
    """`frame` for a join with another in one part, if it is `small`: by merging rather than by a broadcast, whose table stays
    in the driver until garbage is collected."""
    return frame.hint("merge") if small else frame


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str = "text") -> Column:
    """The bytes of a text; a null text counts as empty."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def row_ids(frame: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a number for each row. It holds within one plan; write the frame before it is read twice."""
    return frame.withColumn(name, F.monotonically_increasing_id())


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for work that makes Python objects of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def octet_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Fixed values of that format: these bytes stand for themselves, the others follow in order from U+0100 on.
    """
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
