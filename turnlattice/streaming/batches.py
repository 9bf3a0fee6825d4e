"""Batches that are folded as they arrive, each exactly once: a file stream, partial sums of each batch under its number, and a
durable mark that is set when they are complete.

A batch's partial sums replace what an attempt before has left under the same number, so that a batch that was written but
not marked when the driver was lost is written again, alike; sums without a mark don't count. Sums of all marked batches
merge to those of all rows that have arrived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from turnlattice.sources.shared import filesystem

SCHEMA = "run_id string, game_index long, final_score int, bonus int"
#: How the sums of two parts merge, by the first word of a column's name after its group keys.
MERGE = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def moments(value: str, **more: Column) -> dict[str, Column]:
    """Sums of a number that merge: n, sum_x, sum_sq, min_x, max_x; and more, whose names begin with n, sum, min or max."""
    x = F.col(value)
    return {"n": F.count(x), "sum_x": F.sum(x), "sum_sq": F.sum(x * x), "min_x": F.min(x), "max_x": F.max(x)} | more


class Fold:
    """Sums of groups over all batches of a stream, under `path`: sums/batch=<number> and marks/<number>."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], sums: dict[str, Column]) -> None:
        if odd := [c for c in sums if c.split("_")[0] not in MERGE]:
            raise ValueError(f"names tell how sums merge: {odd}")
        self.spark, self.path, self.by, self.sums = spark, path, by, sums

    def partial(self, batch: DataFrame) -> DataFrame:
        return batch.groupBy(*self.by).agg(*[c.alias(n) for n, c in self.sums.items()])

    def _mark(self, number: int) -> str:
        return f"{self.path}/marks/{number:012d}"

    def marked(self) -> list[int]:
        files, place = filesystem(self.spark, f"{self.path}/marks")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(place)) if files.exists(place) else []

    def take(self, batch: DataFrame, number: int) -> None:
        """Folds one batch, unless its mark is there: the sums are written whole, then the mark."""
        files, mark = filesystem(self.spark, self._mark(number))
        if files.exists(mark):
            return
        self.partial(batch).write.mode("overwrite").parquet(f"{self.path}/sums/batch={number}")
        self.written(number)
        files.create(mark, True).close()

    def written(self, number: int) -> None:
        """Called between the sums and the mark of a batch; for tests that lose the driver there."""

    def start(self, stream: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """Folds what has arrived since the last start, then stops. Batches and their numbers are those of the checkpoint."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.take(batch, number))
        return writer.option("checkpointLocation", checkpoint or f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def result(self) -> DataFrame:
        """The merged sums of all marked batches: by, and a column for each sum."""
        done = self.marked()
        if not done:
            raise ValueError(f"{self.path}: no batch has been folded yet")
        rows = self.spark.read.parquet(*[f"{self.path}/sums/batch={k}" for k in done])
        return rows.groupBy(*self.by).agg(*[MERGE[n.split("_")[0]](n).alias(n) for n in self.sums])


def fold_files(spark: SparkSession, source: str, schema: str | StructType, path: str, by: list[str], sums: dict[str, Column], files_a_batch: int = 100, change: Callable[[DataFrame], DataFrame] | None = None) -> Fold:
    """Folds all Parquet files under `source` that haven't been folded into `path` yet, and returns the fold."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    fold = Fold(spark, path, by, sums)
    fold.start(change(stream) if change else stream).awaitTermination()
    return fold


def games(spark: SparkSession, source: str, path: str) -> DataFrame:
    """n, sums, least, greatest and bonus_count of each run over all finished batches of games under `source`."""
    score = moments("final_score", sum_bonus=F.sum("bonus"))
    return fold_files(spark, source, SCHEMA, path, ["run_id"], score, 1, lambda g: g.withColumn("final_score", F.col("final_score").cast("long"))).result()
