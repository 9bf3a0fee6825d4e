"""Staged runs: a graph of stages with bounded settings, an append-only ledger, and resumption after a loss.

A stage makes one table from those that it needs. Its result is written whole, counted and digested, and only then told
complete in the ledger; a run that starts again takes up complete stages made with the same settings and makes the others.
Nothing in the ledger is ever changed: the state of a stage is its latest entry.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.operators import digests
from turnlattice.operators.statistics import latest
from turnlattice.sources.shared import filesystem, shared_folder

#: The tables of the ledger; each has also run, step (grows with each entry) and at (microseconds).
LEDGER = {
    "settings": "key string, value string",
    "stages": "stage string, status string, settings string, rows long, digest string",
    "checks": "id string, stage string, required boolean, passed boolean, detail string",
    "artifacts": "stage string, path string, rows long, digest string",
    "events": "level string, code string, stage string, message string",
}
COMPLETE, RUNNING, FAILED, PAUSED = "COMPLETE", "RUNNING", "FAILED_RECOVERABLE", "PAUSED"
#: The share of a stage's weight that its state stands for.
SHARE = {COMPLETE: 1.0}


@dataclass(frozen=True)
class Bound:
    """A whole number with a default and the least and greatest that it may be; or a yes or no, if they are None."""

    default: int | bool
    least: int | None = None
    most: int | None = None


def resolved(given: dict, bounds: dict[str, Bound]) -> dict:
    """All settings, `given` ones over defaults; fails on an unknown name, another type or a number out of bounds."""
    for name, value in given.items():
        if name not in bounds:
            raise ValueError(f"no such setting: {name}")
        b = bounds[name]
        if b.least is None and not isinstance(value, bool):
            raise ValueError(f"{name}: true or false")
        if b.least is not None and (isinstance(value, bool) or not isinstance(value, int) or not b.least <= value <= b.most):
            raise ValueError(f"{name}: a whole number from {b.least} to {b.most}")
    return {name: given.get(name, b.default) for name, b in bounds.items()}


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    """A stage's name, its weight in the progress, the stages it needs, and what it makes of the run."""

    name: str
    weight: float
    build: Callable[[Run], DataFrame]
    needs: tuple[str, ...] = ()


def ordered(stages: list[Stage]) -> list[Stage]:
    """Each stage after those it needs, else as given; fails on a name that is missing or twice, and on a circle."""
    known = {s.name: s for s in stages}
    if len(known) < len(stages) or any(n not in known for s in stages for n in s.needs):
        raise ValueError("a stage is there twice, or a needed one isn't there")
    out: list[Stage] = []
    while len(out) < len(stages):
        done = {s.name for s in out}
        ready = [s for s in stages if s.name not in done and set(s.needs) <= done]
        if not ready:
            raise ValueError("stages need each other in a circle")
        out.append(ready[0])
    return out


def table_digest(frame: DataFrame) -> tuple[int, str]:
    """Rows and the multiset digest of a table of plain columns: the same whatever the order and the partitions."""
    shown = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in frame.columns]
    rows = frame.select(F.sha2(digests.encoded(shown), 256).alias("_digest"))
    row = rows.agg(*digests.summed(F.lit(1).cast("long"), [digests._lane(F.col("_digest"), k) for k in range(digests.LANES)])).first()
    return row["n"] or 0, "-".join(f"{int(row[f'lane{k}'] or 0):016x}" for k in range(digests.LANES))


class Lost(Exception):
    """A run that was stopped on purpose after a stage."""


@dataclass
class Run:
    """A run under `path`: out/<stage> has results, ledger/<table> what happened. `given` are settings within `bounds`."""

    spark: SparkSession
    path: str
    stages: list[Stage]
    bounds: dict[str, Bound] = field(default_factory=dict)
    given: dict = field(default_factory=dict)
    name: str = "run"

    def __post_init__(self) -> None:
        self.stages, self.settings = ordered(self.stages), resolved(self.given, self.bounds)
        self.hash = settings_hash(self.settings)

    def tell(self, table: str, **entry) -> None:
        """Appends one entry to a table of the ledger."""
        now = time.time_ns() // 1000
        kinds = f"run string, step long, at long, {LEDGER[table]}"
        names = [f.split(" ")[0] for f in LEDGER[table].split(", ")]
        rows = self.spark.createDataFrame([(self.name, now, now, *(entry.get(n) for n in names))], kinds)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger/{table}")

    def ledger(self, table: str) -> DataFrame:
        """All entries of a table of the ledger, oldest first."""
        kinds = f"run string, step long, at long, {LEDGER[table]}"
        files, place = filesystem(self.spark, f"{self.path}/ledger/{table}")
        if not files.exists(place):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(f"{self.path}/ledger/{table}").filter(F.col("run") == self.name).orderBy("step")

    def states(self) -> DataFrame:
        """The latest entry of each stage."""
        return latest(self.ledger("stages"), "stage", "step")

    def status(self) -> DataFrame:
        """stage, weight, status and progress (0 to 1) of every stage, in order: stages without an entry are pending."""
        weights = self.spark.createDataFrame([(i, s.name, float(s.weight)) for i, s in enumerate(self.stages)], "ordinal int, stage string, weight double")
        share = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in SHARE.items()], F.lit(0.0))
        joined = weights.join(self.states().select("stage", "status"), "stage", "left")
        return joined.select("ordinal", "stage", "weight", F.coalesce("status", F.lit("PENDING")).alias("status"), share.alias("progress"))

    def progress(self) -> float:
        """The weighted share of the stages that are complete."""
        row = self.status().agg((F.sum(F.col("weight") * F.col("progress")) / F.sum("weight")).alias("p")).first()
        return row["p"]

    def table(self, stage: str) -> DataFrame:
        """The result of a complete stage."""
        return self.spark.read.parquet(f"{self.path}/out/{stage}")

    def check(self, stage: str, id: str, passed: bool, detail: str = "", required: bool = True) -> None:
        """Records a check; a required one that didn't pass fails the stage."""
        self.tell("checks", id=id, stage=stage, required=required, passed=passed, detail=detail)
        if required and not passed:
            raise ValueError(f"check {id} failed: {detail}")

    def run(self, stop_after: str | None = None) -> DataFrame | None:
        """Makes all stages that aren't complete; the last one's result. `stop_after` ends the run after a stage, as a loss would."""
        done = {r["stage"] for r in self.states().filter((F.col("status") == COMPLETE) & (F.col("settings") == self.hash)).collect()}  # a row a stage
        for key, value in self.settings.items():
            self.tell("settings", key=key, value=json.dumps(value))
        made = set()
        for s in self.stages:
            if s.name not in done or made & set(s.needs):
                self._make(s)
                made.add(s.name)
            if s.name == stop_after:
                self.tell("events", level="info", code="PAUSED", stage=s.name, message="stopped on purpose")
                return None
        return self.table(self.stages[-1].name)

    def _make(self, s: Stage) -> None:
        self.tell("stages", stage=s.name, status=RUNNING, settings=self.hash)
        try:
            place = f"{self.path}/out/{s.name}"
            s.build(self).write.mode("overwrite").parquet(place)
            rows, digest = table_digest(self.spark.read.parquet(place))
        except Exception as e:
            self.tell("stages", stage=s.name, status=FAILED, settings=self.hash)
            self.tell("events", level="error", code="STAGE_FAILED", stage=s.name, message=str(e)[:2000])
            raise
        self.tell("artifacts", stage=s.name, path=f"out/{s.name}", rows=rows, digest=digest)
        self.tell("stages", stage=s.name, status=COMPLETE, settings=self.hash, rows=rows, digest=digest)

    def verify(self) -> DataFrame:
        """stage, rows, digest, and if the result is still as the ledger tells, of each complete stage."""
        out = []
        for r in self.states().filter(F.col("status") == COMPLETE).collect():  # a row a stage
            files, place = filesystem(self.spark, f"{self.path}/out/{r['stage']}")
            found = table_digest(self.table(r["stage"])) if files.exists(place) else None
            out.append((r["stage"], r["rows"], r["digest"], found == (r["rows"], r["digest"])))
        return self.spark.createDataFrame(out, "stage string, rows long, digest string, same boolean")


def preflight(spark: SparkSession, sf_dir: str, tables: dict[str, list[str]]) -> DataFrame:
    """id, passed and detail of each check before a run: the shared folder, and that each table is there, has its columns and rows."""
    out = []
    try:
        shared_folder(spark)
        out.append(("shared_folder", True, "driver and executors share it"))
    except ValueError as e:
        out.append(("shared_folder", False, str(e)))
    for name, columns in tables.items():
        files, place = filesystem(spark, f"{sf_dir}/{name}.parquet")
        if not files.exists(place):
            out.append((f"table_{name}", False, "missing"))
            continue
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        lacking = sorted(set(columns) - set(frame.columns))
        out.append((f"table_{name}", not lacking, f"lacks {lacking}" if lacking else "there"))
        out.append((f"rows_{name}", not frame.isEmpty(), "has rows" if not frame.isEmpty() else "empty"))
    return spark.createDataFrame(out, "id string, passed boolean, detail string")


# a run over the driver's tables

ORDER_BOUNDS = {"least_orders": Bound(2, 1, 1000)}
#: Settings of the research run: games and states that a profile asks for, and what it may ask for at most.
RESEARCH_BOUNDS = {
    "optimal_runs": Bound(10, 1, 10),
    "games_per_run": Bound(1_000_000, 1_000, 1_000_000),
    "pilot_games": Bound(50_000, 1_000, 500_000),
    "paired_games": Bound(500, 1, 100_000),
    "visit_games": Bound(200, 1, 100_000),
    "states_per_layer": Bound(32, 2, 1_000),
    "rebuild": Bound(True),
}
PROFILES = {
    "smoke": {"optimal_runs": 1, "games_per_run": 1_000, "pilot_games": 1_000, "paired_games": 10, "visit_games": 10, "states_per_layer": 2, "rebuild": False},
    "reduced": {"optimal_runs": 2, "games_per_run": 1_000, "pilot_games": 1_000, "states_per_layer": 8},
    "official": {},
}


def profile(name: str, **given) -> dict:
    """The settings of a profile, with those that are `given`; the official one takes none."""
    if name not in PROFILES or (name == "official" and given):
        raise ValueError("smoke or reduced with settings, or official as it is")
    return resolved(PROFILES[name] | given, RESEARCH_BOUNDS)


def order_stages(sf_dir: str) -> list[Stage]:
    """Customers by what they have paid: preflight, spending of each, who has enough orders, and a report with shares by nation."""

    def checked(run: Run) -> DataFrame:
        found = preflight(run.spark, sf_dir, {"orders": ["o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_nationkey"]})
        for r in found.collect():  # a row a check
            run.check("preflight", r["id"], r["passed"], r["detail"])
        return found

    def spending(run: Run) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        return run.spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(cents).alias("cents"))

    def regular(run: Run) -> DataFrame:
        return run.table("spending").filter(F.col("orders") >= run.settings["least_orders"])

    def report(run: Run) -> DataFrame:
        customers = run.spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        return run.table("regular").join(customers, "o_custkey").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))

    return [Stage("preflight", 1, checked), Stage("report", 3, report, ("regular",)), Stage("spending", 10, spending, ("preflight",)), Stage("regular", 2, regular, ("spending",))]
