"""Folds that lose the driver between sums and mark, and the audit of exported files by ranges."""

import json
import os

import pytest
from pyspark.sql import functions as F

from turnlattice.plans import exchange_queries
from turnlattice.sources import formats, records
from turnlattice.streaming import batches

EVENTS = "k string, x long"


class Lost(Exception):
    pass


def arrive(spark, path, first, n):
    rows = [(f"k{i % 5}", i * i % 97) for i in range(first, first + n)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
    return rows


def sums(rows):
    out = {}
    for k, x in rows:
        out.setdefault(k, []).append(x)
    return {k: (len(v), sum(v), sum(x * x for x in v), min(v), max(v)) for k, v in out.items()}


def test_lost_between_sums_and_mark(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "fold")
    rows = [r for i in range(4) for r in arrive(spark, source, i * 50, 50)]
    attempts = []

    def lost(self, number):
        attempts.append(number)
        if attempts.count(2) == 1 and number == 2:
            raise Lost

    monkeypatch.setattr(batches.Fold, "written", lost)
    with pytest.raises(Exception, match="Lost"):
        batches.fold_files(spark, source, EVENTS, path, ["k"], batches.moments("x"), 1)
    assert os.path.exists(f"{path}/sums/batch=2") and batches.Fold(spark, path, ["k"], batches.moments("x")).marked() == [0, 1]
    rows += arrive(spark, source, 900, 30)  # more arrives meanwhile
    fold = batches.fold_files(spark, source, EVENTS, path, ["k"], batches.moments("x"), 1)
    assert attempts.count(2) == 2 and fold.marked() == [0, 1, 2, 3, 4]
    assert {r.k: tuple(r)[1:] for r in fold.result().collect()} == sums(rows)
    again = batches.fold_files(spark, source, EVENTS, path, ["k"], batches.moments("x"), 1)  # nothing new
    assert {r.k: tuple(r)[1:] for r in again.result().collect()} == sums(rows)


def test_a_batch_counts_once(spark, tmp_path):
    fold = batches.Fold(spark, str(tmp_path / "f"), ["k"], batches.moments("x"))
    with pytest.raises(ValueError, match="no batch"):
        fold.result()
    one = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], EVENTS)
    for _ in range(3):
        fold.take(one, 0)
    fold.take(one, 1)
    assert {r.k: (r.n, r.sum_x) for r in fold.result().collect()} == {"a": (4, 6), None: (2, 10)}
    with pytest.raises(ValueError, match="merge"):
        batches.Fold(spark, "p", ["k"], {"average": F.avg("x")})


LAYOUT = records.Layout(b"T1234567" + bytes(8), (("a", "<i8"),), count_at=8, count_size=8)


@pytest.mark.parametrize("range_bytes", [7, 100, 1 << 20])
def test_all_planted_faults(spark, tmp_path, range_bytes):
    lines = [json.dumps({"i": i, "t": "é" * (i % 40)}, ensure_ascii=False).encode() for i in range(60)]
    want = set()
    for i, bad, fault in ((0, b"{", "not JSON"), (17, b"[1]", "no object"), (18, b"", "not JSON"), (33, b'{"a":NaN}', "not JSON"), (59, b'{"a":"\xff"}', "not UTF-8")):
        lines[i] = bad
        want.add(("bad.jsonl", sum(len(x) + 1 for x in lines[:i]), fault))
    (tmp_path / "bad.jsonl").write_bytes(b"\n".join(lines))
    (tmp_path / "good.jsonl").write_bytes(b'{"a":1}\n{}\n')
    rows = [b"a,b,c"] + [b'1,"x, ""y""",z\r' for _ in range(30)]
    for i, bad, fault in ((4, b"1,2", "columns"), (9, b'1,"2,3', "quotes"), (30, b"\xff,1,2", "not UTF-8")):
        rows[i] = bad
    want |= {("bad.csv", sum(len(x) + 1 for x in rows[:i]), f) for i, f in ((4, "columns"), (9, "quotes"), (30, "not UTF-8"))}
    (tmp_path / "bad.csv").write_bytes(b"\n".join(rows) + b"\n")
    (tmp_path / "good.csv").write_bytes(b"one\n1\n2\n")
    records.write_records(spark.range(50).select(F.col("id").alias("index"), F.col("id").alias("a")), str(tmp_path / "good.bin"), LAYOUT, single=True)
    data = (tmp_path / "good.bin").read_bytes()
    for name, content, fault in (("cut.bin", data[:-3], (len(data) - 3, "cut off")), ("long.bin", data + b"xx", (len(data), "longer than its header tells")), ("head.bin", b"X" + data[1:], (0, "header")), ("empty.jsonl", b"", (0, "empty"))):
        (tmp_path / name).write_bytes(content)
        want.add((name, *fault))
    files = formats.listed(spark, str(tmp_path), {".jsonl": "jsonl", ".csv": "csv", ".bin": "t"})
    files = files.unionByName(spark.createDataFrame([(str(tmp_path / "none.csv"), "csv"), (str(tmp_path / "good.csv"), "odd")], "file string, format string"))
    want |= {("none.csv", 0, "missing"), ("good.csv", 0, "unknown format")}
    found = [(r.file.rsplit("/", 1)[1], r.offset, r.fault) for r in formats.audited(spark, files, {"t": LAYOUT}, range_bytes).collect()]
    assert sorted(found) == sorted(want)


def test_exports_are_sound(spark, tmp_path):
    frame = spark.range(300).select("id", F.concat(F.lit('say "hi", '), F.col("id")).alias("t"))
    frame.repartition(3).write.json(str(tmp_path / "j"))
    frame.repartition(3).write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    files = formats.listed(spark, str(tmp_path), {".json": "jsonl", ".csv": "csv"})
    assert files.count() == 6 and formats.audited(spark, files, range_bytes=100).count() == 0


def test_export_whose_first_partition_has_no_rows(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("5-LOW").alias("o_orderpriority"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 10))  # one row group over several splits: it is read where its middle lies
    try:
        found = {(r.format, r.fault): r.n for r in exchange_queries.export_faults(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    columns = sum(k % 997 == 5 for k in range(40_000))
    quotes = sum(k % 1009 == 7 and k % 997 != 5 for k in range(40_000))
    assert found == {("csv", "columns"): columns, ("csv", "quotes"): quotes, ("jsonl", "not JSON"): sum(k % 991 == 3 for k in range(40_000))}
