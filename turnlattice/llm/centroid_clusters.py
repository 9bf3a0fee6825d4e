"""Centroid clustering with Elkan's bounds, in exact integers.

Each vector keeps an upper bound of its distance to its own centroid and a lower bound to each of the k centroids. When the
centroids move, bounds move by as much. A distance is computed only where neither the bounds nor half the distance between
two centroids tell that the other centroid is farther, strictly: equal distances are always computed, so that ties go to the
smaller number. Bounds are kept in 32 bits and always rounded to the safe side; distances that decide are integers.

Vectors and their bounds are a written table, one map over it a round; only the sums of each cluster are shuffled, a row for
each task and cluster. The driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlattice.llm.common import bound_batches, forget, written

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
#: Components have to lie below this, so that squared distances fit in 64 bits.
MOST = 1 << 27
#: What bounds are widened by, relative to what they are made from: more than any rounding of 32-bit numbers.
SLACK = 4e-7


def above(x: np.ndarray) -> np.ndarray:
    return (x * (1 + SLACK)).astype(np.float32)


def below(x: np.ndarray) -> np.ndarray:
    return (x * (1 - SLACK)).astype(np.float32)


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[vector, centre] squared, in integers."""
    out = np.empty((len(vectors), len(centres)), np.int64)
    for j, centre in enumerate(centres):
        step = vectors - centre
        out[:, j] = np.einsum("ij,ij->i", step, step)
    return out


def begun(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, upper, lower) with all distances computed."""
    squared = distances(vectors, centres)
    own = squared.argmin(axis=1)  # of equals the first
    lower = below(np.sqrt(squared))
    return own, above(np.sqrt(squared[np.arange(len(own)), own])), lower


def moved(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) after the centroids went from `before` to `centres`."""
    step = centres - before
    shift = np.sqrt(np.einsum("ij,ij->i", step, step)) * (1 + SLACK)
    return above(upper.astype(np.float64) + shift[own]), np.maximum(0, below(lower * (1 - SLACK) - shift)).astype(np.float32)


def reassigned(vectors: np.ndarray, centres: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(own, upper, lower, distances computed) for centroids that the bounds hold for."""
    own, upper, lower, k = own.copy(), upper.copy(), lower.copy(), len(centres)
    half = below(np.sqrt(distances(centres, centres)) / 2)
    half[np.arange(k), np.arange(k)] = np.inf
    open_rows = np.flatnonzero(upper >= half.min(axis=1)[own])
    computed = 0
    for tight in (False, True):
        mine = own[open_rows]
        asked = (upper[open_rows, None] >= lower[open_rows]) & (upper[open_rows, None] >= half[mine])
        asked[np.arange(len(mine)), mine] = False
        some = asked.any(axis=1)
        open_rows, asked = open_rows[some], asked[some]
        if not tight:
            step = vectors[open_rows] - centres[own[open_rows]]
            exact = np.einsum("ij,ij->i", step, step)
            computed += len(exact)
            upper[open_rows] = above(np.sqrt(exact))
            lower[open_rows, own[open_rows]] = below(np.sqrt(exact))
        else:
            exact = exact[some]
    best = np.full(asked.shape, np.iinfo(np.int64).max)
    best[np.arange(len(open_rows)), own[open_rows]] = exact
    i, j = np.nonzero(asked)
    step = vectors[open_rows[i]] - centres[j]
    best[i, j] = np.einsum("ij,ij->i", step, step)
    lower[open_rows[i], j] = below(np.sqrt(best[i, j]))
    own[open_rows] = best.argmin(axis=1)
    upper[open_rows] = above(np.sqrt(best.min(axis=1, initial=np.iinfo(np.int64).max)))
    return own, upper, lower, computed + len(i)


def _array(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def integers(vectors: DataFrame, column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and `vector` = floor(scale x) of the vectors with `size` components, none of them null or non-finite."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter((F.size(column) == size) & finite).select("vec_id", scaled.alias("vector"))


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, column: str = "embedding", size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another size or hold a null or non-finite component are left out. The first centroids are the k
    vectors of the least SHA-256 of `seed:vec_id` (a null id: nothing after the colon), those of one id in order of their
    components; with fewer vectors there are fewer centroids. An empty cluster keeps its centroid. Ties go to the smaller
    number, repeated rows are answered each and count each, a table without kept vectors gives no rows, and no other column
    is read. Components that reach MOST after scaling fail, since their distances don't fit in 64 bits.
    """
    bound_batches(vectors.sparkSession)
    kept = integers(vectors, column, size, scale)
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centres = np.array([r["vector"] for r in kept.select(key.alias("_key"), "vector").orderBy("_key", "vector").limit(k).collect()], np.int64).reshape(-1, size)
    if not len(centres):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centres)
    fields = f"vec_id {kind}, vector array<int>, cluster int, upper float, lower array<float>, distance long"

    def row(batch: pa.RecordBatch, vector: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
        step = vector - centres[own]
        columns = [_lists(vector, pa.int32()), pa.array(own, pa.int32()), pa.array(upper), _lists(lower, pa.float32()), pa.array(np.einsum("ij,ij->i", step, step))]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), *columns], ["vec_id", "vector", "cluster", "upper", "lower", "distance"])

    def first(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = _array(batch.column("vector"), size, np.int64)
            if (np.abs(vector) >= MOST).any():
                raise ValueError(f"a component reaches {MOST} after scaling")
            yield row(batch, vector, *begun(vector, centres), centres)

    state = written(kept.mapInArrow(first, fields))
    for _ in range(rounds):
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("vector")[i].cast("long")) for i in range(size)]).alias("sums")).collect()  # k rows
        before, centres = centres, centres.copy()
        for r in sums:
            centres[r["cluster"]] = [s // r["n"] for s in r["sums"]]

        def again(batches: Iterator[pa.RecordBatch], before=before, centres=centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vector, own = _array(batch.column("vector"), size, np.int64), batch.column("cluster").to_numpy().astype(np.int64)
                upper, lower = moved(own, batch.column("upper").to_numpy(), _array(batch.column("lower"), k, np.float32), before, centres)
                own, upper, lower, _ = reassigned(vector, centres, own, upper, lower)
                yield row(batch, vector, own, upper, lower, centres)

        following = written(state.mapInArrow(again, fields))
        forget(state)
        state = following
    inertia = {r["cluster"]: r["sum"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    per_cluster = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return state.select("vec_id", "cluster", "distance", per_cluster([inertia.get(j, 0) for j in range(k)], "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), per_cluster(names, "string").alias("centroid_sha256"))


def _oracle() -> str:
    """DuckDB SQL for the query: every distance computed in every round."""
    squared = "list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        f"WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS cv FROM kept "
        f"ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM (SELECT row, vec_id, v, c, {squared} AS d FROM (SELECT row_number() OVER () AS row, * FROM kept), c{r}) GROUP BY row, vec_id)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT best.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m, cv) AS cv FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c) USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c = best.c"""


ORACLE = _oracle()
