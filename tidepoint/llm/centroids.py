"""Centroid clustering of integer vectors, with a bisector tournament for each vector.

For centroids a < b, vector x is nearer to b exactly if 2(b - a).x > |b|^2 - |a|^2. The integer normals 2(b - a) and
thresholds of all pairs are computed once a round and sent to the tasks (k is a parameter, so their size is bounded). A
vector's champion starts as centroid 0 and meets the others in order: k - 1 sign tests, where zero leaves the smaller number
in place. Only the winner's distance is computed. Tasks add up their vectors for each cluster exactly and Spark adds the sums;
the driver sees k sums a round.

Vectors become floor(scale * component). Arithmetic is exact at every size: batches whose products fit run on 64-bit
integers, others on Python integers, and sums travel as limbs of 36 bits.

Defined results: a vector is kept if it has exactly `dims` components, all of them numbers and finite, other rows (null, empty,
shorter, longer) take no part and are not in the result; ties go to the smaller centroid; repeated rows all count; with fewer
kept vectors than k there are as many centroids as vectors, with none an empty result; a null id hashes as the empty text, and
rows with equal ids start in order of their vectors; an empty cluster keeps its centroid; a distance or inertia beyond 64 bits
is null; columns beside id and vector are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import stored, table

LIMBS, LIMB_BITS = 8, 36
LONG = 2**63 - 1


def kept_vectors(vectors: DataFrame, dims: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, vector of the rows whose vector has `dims` components, all finite."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    return rows.where((F.size("vector") == dims) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) as (rows, dims): int64 where all fit in 62 bits, else Python integers."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    if not len(values) or np.abs(values).max() < 2.0**61 / scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[_floor(x, scale) for x in row] for row in values.tolist()], object)


def _floor(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normals (k, k, dims) and thresholds (k, k) in Python integers; entry [a, b] holds for a < b."""
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None]


def tournament(vectors: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    champion = np.zeros(len(vectors), np.int64)
    for rival in range(1, len(thresholds)):
        for holder in range(rival):
            rows = np.flatnonzero(champion == holder)
            if len(rows):
                beaten = vectors[rows] @ normals[holder, rival] > thresholds[holder, rival]
                champion[rows[beaten.astype(bool)]] = rival
    return champion


def _placer(centroids: list[list[int]], dims: int, scale: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function from a vector column to (integers, cluster, squared distance)."""
    exact = np.array(centroids, object).reshape(-1, dims)
    normals, thresholds = bisectors(exact)
    reach = max((abs(x) for c in centroids for x in c), default=0)

    def place(column: pa.Array):
        v = integers(column, dims, scale)
        most = int(np.abs(v).max()) if len(v) else 0
        # 64-bit products are safe while dims * (2 * (most + reach))^2 stays below 2^62.
        if v.dtype != object and dims * 4 * (most + reach) ** 2 < 2**62:
            c = exact.astype(np.int64)
            cluster = tournament(v, normals.astype(np.int64), thresholds.astype(np.int64))
        else:
            v, c = v.astype(object), exact
            cluster = tournament(v, normals, thresholds)
        apart = v - c[cluster]
        return v, cluster, (apart * apart).sum(axis=1)

    return place


def limbs(value: int) -> list[int]:
    """Base 2^36 with a signed top limb: sums of limbs are limbs of sums."""
    low = [(value >> (LIMB_BITS * i)) & ((1 << LIMB_BITS) - 1) for i in range(LIMBS - 1)]
    return [*low, value >> (LIMB_BITS * (LIMBS - 1))]


def _sums(place: Callable, k: int, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            v, cluster, _ = place(batch["vector"])
            for c in range(k):
                mine = v[cluster == c]
                counts[c] += len(mine)
                wide = mine.dtype == object or len(mine) and int(np.abs(mine).max()) * len(mine) >= 2**62
                added = mine.astype(object).sum(axis=0) if wide else mine.sum(axis=0)
                if len(mine):
                    totals[c] = [a + int(b) for a, b in zip(totals[c], added)]
        rows = [(c, d, counts[c], limbs(totals[c][d])) for c in range(k) if counts[c] for d in range(dims)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
            *(pa.array([r[3][i] for r in rows], pa.int64()) for i in range(LIMBS)),
        ], names=["cluster", "dim", "n", *(f"limb{i}" for i in range(LIMBS))])

    return run


def start(vectors: DataFrame, k: int, dims: int, scale: int, seed: str) -> list[list[int]]:
    """The integer vectors of the k rows with the smallest sha256 of seed + id."""
    first = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "vector").limit(k)
    return [[_floor(float(x), scale) for x in r["vector"]] for r in first.collect()]


def fit(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: str) -> list[list[int]]:
    """The centroids after `rounds` rounds over a table of `kept_vectors`."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale is a power of two, so that products with doubles are exact")
    centroids = start(vectors, k, dims, scale, seed)
    fields = ", ".join(["cluster int", "dim int", "n long", *(f"limb{i} long" for i in range(LIMBS))])
    for _ in range(rounds if centroids else 0):
        parts = vectors.select("vector").mapInArrow(_sums(_placer(centroids, dims, scale), len(centroids), dims), fields)
        # k * dims rows reach the driver, whatever the table's size.
        for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), *(F.sum(f"limb{i}").alias(f"limb{i}") for i in range(LIMBS))).collect():
            centroids[r["cluster"]][r["dim"]] = sum(r[f"limb{i}"] << (LIMB_BITS * i) for i in range(LIMBS)) // r["n"]
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> DataFrame:
    """id, cluster, distance (squared) of every row of a table of `kept_vectors`."""
    place = _placer(centroids, dims, scale)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = place(batch["vector"])
            far = distance.tolist()
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.array(cluster.astype(np.int32)), pa.array([d if d <= LONG else None for d in far], pa.int64()),
            ], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {kind}, cluster int, distance long")


def clustered(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:",
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance of every kept vector, stored; the final centroids)."""
    kept = kept_vectors(vectors, dims, id_column, vector_column)
    centroids = fit(kept, k, rounds, dims, scale, seed)
    return stored(assign(kept, centroids, dims, scale), "clusters"), centroids


def _long(total) -> F.Column:
    return F.when(total <= LONG, total).cast("long")


def with_inertia(placed: DataFrame) -> DataFrame:
    """`placed` with cluster_inertia and inertia, null where a distance or the sum is beyond 64 bits."""
    spark = placed.sparkSession
    sums = placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.bool_or(F.col("distance").isNull()).alias("lost")).collect()
    known = [None if r["lost"] else int(r["total"]) for r in sums]
    whole = None if None in known else sum(known)
    within = lambda x: x if x is not None and x <= LONG else None
    rows = [(r["cluster"], within(t), within(whole)) for r, t in zip(sums, known)]
    # One row a cluster.
    return placed.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long")), "cluster", "left")


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Lloyd rounds as chained common table expressions."""
    near = """SELECT v.vec_id, v.x, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT, c.cluster)) AS cluster
FROM v CROSS JOIN c{0} c GROUP BY v.vec_id, v.x"""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INT AS cluster, x FROM v
QUALIFY cluster < {k})"""]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED ({near.format(r)}),
s{r} AS (SELECT cluster, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} CROSS JOIN range(1, {dims + 1}) d(i) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f""",
a AS ({near.format(rounds)}),
d AS (SELECT a.vec_id, a.cluster, list_sum(list_transform(list_zip(a.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (cluster))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM d
"""


@query("op12_centroids", _sql())
def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    placed, centroids = clustered(table(spark, sf, "embeddings"))
    marks = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    return with_inertia(placed).join(F.broadcast(spark.createDataFrame(marks, "cluster int, centroid_sha256 string")), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
