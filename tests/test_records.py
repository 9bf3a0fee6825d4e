"""Record files: tasks write at known offsets, ranges are read back, and what is cut off or changed is found."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlattice.operators import selection
from turnlattice.sources import binary, records

LAYOUT = records.Layout(b"TESTFILE" + bytes(16), (("key", "<i8"), ("price", "<f8"), ("name", "S7"), ("raw", "V3"), ("flags", "u1", 2)), count_size=8)


def frame(spark, n=5000):
    ids = spark.range(n).repartition(6)
    return ids.select(F.col("id").alias("index"), (F.col("id") * 3 - 7).alias("key"), (F.col("id") / 7).alias("price"), F.concat(F.lit("é"), (F.col("id") % 1000).cast("string")).alias("name"), F.encode(F.lpad(F.hex(F.col("id") % 4096), 3, "0"), "UTF-8").alias("raw"), F.array((F.col("id") % 256).cast("int"), F.lit(255)).alias("flags"))


@pytest.mark.parametrize("single", [True, False])
def test_round_trip(spark, tmp_path, single):
    path = str(tmp_path / "t.bin")
    rows = frame(spark)
    records.write_records(rows, path, LAYOUT, single)
    back = records.read_records(spark, path, LAYOUT, split_bytes=3000)
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 4  # read by ranges
    names = ["index", "key", "price", "name", "raw", "flags"]
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(map(tuple, rows.select(*names).collect()))
    few = records.read_records(spark, path, LAYOUT, ["price", "index"])
    assert few.columns == ["price", "index"] and few.count() == 5000
    if single:
        size = len(LAYOUT.header) + 5000 * LAYOUT.record.itemsize
        data = open(path, "rb").read()
        assert len(data) == size and LAYOUT.count(data[:24]) == 5000
        own = np.frombuffer(data, LAYOUT.record, offset=24)
        assert (own["key"] == np.arange(5000) * 3 - 7).all()
    assert [f for f in os.listdir(tmp_path) if f != "t.bin"] == []
    with pytest.raises(Exception, match="already"):
        records.write_records(rows, path, LAYOUT, single)
    records.write_records(frame(spark, 10), path, LAYOUT, single, overwrite=True)
    assert records.read_records(spark, path, LAYOUT).count() == 10


def test_empty(spark, tmp_path):
    for single in (True, False):
        path = str(tmp_path / f"{single}")
        records.write_records(frame(spark, 5).limit(0), path, LAYOUT, single)
        assert records.read_records(spark, path, LAYOUT).count() == 0


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("fault", ["gap", "repeat", "null", "long", "wide"])
def test_faults_leave_nothing(spark, tmp_path, single, fault):
    rows = frame(spark, 300)
    rows = {
        "gap": lambda: rows.filter("index != 77"),
        "repeat": lambda: rows.unionByName(rows.filter("index = 5")),
        "null": lambda: rows.withColumn("key", F.when(F.col("index") != 250, F.col("key"))),
        "long": lambda: rows.withColumn("name", F.when(F.col("index") == 250, "12345678").otherwise(F.col("name"))),
        "wide": lambda: rows.withColumn("flags", F.array(F.lit(1), F.lit(256))),
    }[fault]()
    with pytest.raises(Exception, match="gap or a repeat|null|fit"):
        records.write_records(rows, str(tmp_path / "t"), LAYOUT, single)
    assert os.listdir(tmp_path) == []


def test_cut_off_files_fail(spark, tmp_path):
    whole, parts = str(tmp_path / "w"), str(tmp_path / "p")
    records.write_records(frame(spark, 400), whole, LAYOUT, single=True)
    records.write_records(frame(spark, 400), parts, LAYOUT)
    data = open(whole, "rb").read()
    for bad in (data[:-1], data[: -LAYOUT.record.itemsize], data + b"\0", b"X" + data[1:], data[:10]):
        open(whole, "wb").write(bad)
        with pytest.raises(Exception, match="cut off|format"):
            records.read_records(spark, whole, LAYOUT).count()
    part = f"{parts}/{sorted(n for n in os.listdir(parts) if n.startswith('part-'))[-1]}"
    os.truncate(part, os.path.getsize(part) - LAYOUT.record.itemsize)
    with pytest.raises(Exception, match="the header tells"):
        records.read_records(spark, parts, LAYOUT).count()
    os.remove(f"{parts}/part-{0:020d}")
    with pytest.raises(Exception, match="missing"):
        records.read_records(spark, parts, LAYOUT).count()
    with pytest.raises(Exception, match="no such file"):
        records.read_records(spark, str(tmp_path / "none"), LAYOUT).count()


def test_games_and_policies(spark, tmp_path):
    ids = spark.range(1000)
    values = [(F.col("id") % (300 if kind == "<u2" else 200)).cast("int").alias(name) if not more and kind != "<f4" else F.array(*[F.lit(i) for i in range(more[0])]).alias(name) if more else (F.col("id") / 4).cast("float").alias(name) for name, kind, *more in binary.GAME_FIELDS]
    games = ids.select(F.col("id").alias("game_index"), *values)
    os.mkdir(tmp_path / "games")
    binary.write_games(games, str(tmp_path / "games/a.bin"), "greedy", 77)
    binary.write_games(games.limit(0), str(tmp_path / "games/b.bin"), "random")
    back = binary.read_games(spark, str(tmp_path / "games"))
    assert back.drop("file").exceptAll(games).count() == 0 and back.count() == 1000
    head = open(tmp_path / "games/a.bin", "rb").read(64)
    assert head[:8] == b"YTZSIM02" and head[20:26] == b"greedy" and int.from_bytes(head[40:48], "little") == 77
    policy = ids.filter("id < 40").select(F.col("id").cast("int").alias("state_index"), F.encode(F.repeat(F.char(F.col("id") + 65), 756), "UTF-8").alias("policy"))
    digest = binary.write_policy(policy, str(tmp_path / "p.bin"))
    assert digest == hashlib.sha256(open(tmp_path / "p.bin", "rb").read()).hexdigest()
    assert binary.read_policy(spark, str(tmp_path / "p.bin")).exceptAll(policy).count() == 0


def test_any_table_by_its_order(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k), "n", b"abc", [1, 2]) for k in (5, 3, 9, 3)], "key long, price double, name string, raw binary, flags array<int>")
    records.write_records(selection.numbered(rows, "key", name="index"), str(tmp_path / "t"), LAYOUT)
    assert [r.key for r in records.read_records(spark, str(tmp_path / "t"), LAYOUT).orderBy("index").collect()] == [3, 3, 5, 9]


def test_inventory_and_audit(spark, tmp_path):
    os.makedirs(tmp_path / "r/sub")
    for name, data in (("a", b"one"), ("sub/b", b"two" * 10), ("c", b"x"), ("d", b"y"), ("e", b"")):
        (tmp_path / "r" / name).write_bytes(data)
    found = binary.inventory(spark, str(tmp_path / "r"))
    rows = {r.path: r for r in found.collect()}
    assert rows["sub/b"].size == 30 and rows["a"].sha256 == hashlib.sha256(b"one").hexdigest() and len(rows) == 5
    listed = spark.createDataFrame([(r.path, r.sha256) for r in rows.values()] + [("gone", "0" * 64), ("../out", "0" * 64), ("/abs", "0" * 64), ("a", "short"), ("a", None)], "path string, sha256 string")
    (tmp_path / "r/c").write_bytes(b"changed")
    os.remove(tmp_path / "r/d")
    faults = sorted(map(tuple, binary.audited_inventory(listed, str(tmp_path / "r")).collect()))
    assert faults == sorted([("c", "changed"), ("d", "missing"), ("e", "empty"), ("gone", "missing"), ("../out", "no relative path"), ("/abs", "no relative path"), ("a", "no hash"), ("a", "no hash")])
