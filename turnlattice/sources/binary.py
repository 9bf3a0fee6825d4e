"""The fixed binary formats for exchange: values, bounds, policies and games, as layouts of the record source."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.sources.records import Layout, _open, read_records, write_records

#: Fixed values of the formats: magic words, header sizes, record sizes, and the hash of the canonical rules.
VALUES, BOUNDS, POLICY, GAMES = b"YTZVAL02", b"YTZBND02", b"YTZPOL02", b"YTZSIM02"
HEADER, GAMES_HEADER, POLICY_BYTES, GAME_BYTES = 128, 64, 756, 48
CANONICAL_RULES = "d122c68b140b42a4509c8fc3f2252661b8bf51a791d630996706458b05825018"
KINDS = {VALUES: (1, ["value"]), BOUNDS: (2, ["lower", "upper_bound"])}
GAME_FIELDS = (("final_score", "<u2"), ("upper_total", "u1"), ("bonus", "u1"), ("alike_rolls", "u1"), ("alike_score", "u1"), ("early_scores", "u1"), ("rerolls", "u1"), ("keeper_counts", "u1", 5), ("ties", "u1"), ("least_margin", "<f4"), ("category_scores", "u1", 15), ("fill_turns", "u1", 15))
#: Bytes that are hashed at a time.
PIECE = 1 << 20


def table_layout(magic: bytes, rules: str = CANONICAL_RULES) -> Layout:
    """Of values or bounds."""
    header = struct.pack("<8sHHIBBBB4x32s72x", magic, 2, HEADER, 0, 15, 63, 1, KINDS[magic][0], bytes.fromhex(rules))
    return Layout(header, tuple((c, "<f8") for c in KINDS[magic][1]))


def policy_layout(rules: str = CANONICAL_RULES) -> Layout:
    return Layout(struct.pack("<8sHHIHxxxxxx32s72x", POLICY, 2, HEADER, 0, POLICY_BYTES, bytes.fromhex(rules)), (("policy", f"V{POLICY_BYTES}"),))


def games_layout(policy: str = "", seed: int = 0) -> Layout:
    """Of games; policy and seed differ from file to file."""
    header = struct.pack("<8sHHIH2x20sQ16x", GAMES, 2, GAMES_HEADER, 0, GAME_BYTES, policy.encode()[:20], seed)
    return Layout(header, GAME_FIELDS, checked=18)


def check_header(data: bytes, magic: bytes, rules: str = CANONICAL_RULES) -> int:
    """The number of states of a whole file; fails on another format, version or rules, and on a length that doesn't fit."""
    layout = policy_layout(rules) if magic == POLICY else table_layout(magic, rules)
    count = layout.count(data[:HEADER])
    if len(data) != HEADER + count * layout.record.itemsize:
        raise ValueError(f"not a {magic.decode()} file of these rules, or cut off")
    return count


def _by_index(frame: DataFrame) -> DataFrame:
    return frame.withColumnRenamed("state_index", "index")


def write_table(frame: DataFrame, path: str, magic: bytes, rules: str = CANONICAL_RULES) -> str:
    """Writes values or bounds of states 0, 1, .. by tasks; returns the file's SHA-256."""
    write_records(_by_index(frame), path, table_layout(magic, rules), single=True, overwrite=True)
    return _digest(frame.sparkSession, path)


def write_policy(frame: DataFrame, path: str, rules: str = CANONICAL_RULES) -> str:
    """Writes state_index and policy (756 codes a state) by tasks; returns the file's SHA-256."""
    write_records(_by_index(frame), path, policy_layout(rules), single=True, overwrite=True)
    return _digest(frame.sparkSession, path)


def write_games(frame: DataFrame, path: str, policy: str = "", seed: int = 0) -> None:
    """Writes games 0, 1, .. (game_index and the fields of a record) as one file."""
    write_records(frame.withColumnRenamed("game_index", "index"), path, games_layout(policy, seed), single=True, overwrite=True)


def read_table(spark: SparkSession, path: str, magic: bytes, rules: str = CANONICAL_RULES) -> DataFrame:
    """state_index and the columns of a values or bounds file."""
    columns = KINDS[magic][1]
    return read_records(spark, path, table_layout(magic, rules), ["index", *columns]).select(F.col("index").cast("int").alias("state_index"), *columns)


def read_policy(spark: SparkSession, path: str, rules: str = CANONICAL_RULES) -> DataFrame:
    """state_index and policy (756 bytes) of a policy file."""
    return read_records(spark, path, policy_layout(rules), ["index", "policy"]).select(F.col("index").cast("int").alias("state_index"), "policy")


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """The games of record files: file, game_index and the fields of a record. The margin is 0 where it wasn't known."""
    return read_records(spark, path, games_layout()).withColumnRenamed("index", "game_index")


def digests(paths: DataFrame) -> DataFrame:
    """path, size and sha256 of the files named in `path`; size and sha256 are null where there is none.

    A task reads a file piece by piece, so that it may be of any size.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                files, place = _open(path)
                info = files.get_file_info(place)
                if info.type != pyarrow.fs.FileType.File:
                    out.append((path, None, None))
                    continue
                digest = hashlib.sha256()
                with files.open_input_stream(place) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                out.append((path, info.size, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string()], strict=True)], ["path", "size", "sha256"])

    return paths.select("path").mapInArrow(hashed, "path string, size long, sha256 string")


def _digest(spark: SparkSession, path: str) -> str:
    return digests(spark.createDataFrame([(path,)], "path string")).first()["sha256"]


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path (below `root`), size and sha256 of all files under a folder; the driver lists names, tasks read the files."""
    files, place = _open(root)
    names = [i.path for i in files.get_file_info(pyarrow.fs.FileSelector(place, recursive=True)) if i.type == pyarrow.fs.FileType.File]
    scheme = f"{root.split('://')[0]}://" if "://" in root else ""
    listed = spark.createDataFrame([(f"{scheme}{n}",) for n in sorted(names)], "path string")
    spread = listed.repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    return digests(spread).withColumn("path", F.substring("path", len(f"{scheme}{place.rstrip('/')}/") + 1, 1 << 20))


def audited_inventory(listed: DataFrame, root: str) -> DataFrame:
    """path and fault of the entries of an inventory (path, sha256) that are not as listed under `root`: no relative path, no hash, missing, empty or changed."""
    relative = F.col("path").rlike(r"^(?!/)(?!.*\\)(?!.*(^|/)\.\.?(/|$))[^:]+$")
    hashed = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    told = listed.select("path", F.col("sha256").alias("_listed"), F.coalesce(relative, F.lit(False)).alias("_relative"), hashed.alias("_hashed"))
    there = digests(told.filter("_relative").select(F.concat(F.lit(f"{root.rstrip('/')}/"), "path").alias("path")).distinct())
    there = there.select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20).alias("path"), "size", "sha256")
    fault = F.when(~F.col("_relative"), "no relative path").when(~F.col("_hashed"), "no hash").when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty").when(F.col("sha256") != F.col("_listed"), "changed")
    return told.join(there, "path", "left").select("path", fault.alias("fault")).filter("fault is not null")
