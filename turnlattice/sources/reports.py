"""Reports (CSV, JSON lines, Markdown, LaTeX) and the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.operators.statistics import latest

LEDGER = "build_id string, key string, value string, at timestamp, step long"


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled where needed, nulls empty."""
    frame.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_lines(frame: DataFrame, path: str) -> None:
    """One JSON object a row."""
    frame.write.mode("overwrite").json(path)


def markdown(frame: DataFrame, most: int = 1000) -> str:
    """A report's rows as a Markdown table; fails on more than `most` rows, as it goes to the driver."""
    rows = frame.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |\n"
    return line(frame.columns) + line(["---"] * len(frame.columns)) + "".join(line(r) for r in rows)


def latex(frame: DataFrame, most: int = 1000) -> str:
    """The same as a LaTeX tabular."""
    rows = frame.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    line = lambda cells: " & ".join(str(c).replace("%", "\\%") for c in cells) + r" \\"
    body = "\n".join(line(r) for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(frame.columns)}}}\n\\hline\n{line(frame.columns)} \\hline\n{body}\n\\hline\n\\end{{tabular}}\n"


def record(spark: SparkSession, path: str, build_id: str, entries: dict[str, str], step: int) -> None:
    """Appends to the ledger; nothing is overwritten."""
    rows = spark.createDataFrame([(build_id, k, v) for k, v in entries.items()], "build_id string, key string, value string")
    rows.withColumn("at", F.current_timestamp()).withColumn("step", F.lit(step).cast("long")).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str, build_id: str) -> DataFrame:
    """The latest value of each key of a build."""
    return latest(spark.read.schema(LEDGER).parquet(path).filter(F.col("build_id") == build_id), "key", "step", "at").select("key", "value")
