"""Centroid clustering of integer vectors by a tournament of bisector tests.

1. Vectors of the right length without null or non-finite components become integers, stored once.
2. Before a round every pair i < j of centroids gets an integer normal c_j - c_i and a threshold, the floor of half the
   difference of their squared lengths. A vector is nearer to j exactly if its product with the normal exceeds the threshold;
   equality and everything below favour the smaller number.
3. A vector's champion starts as centroid 0 and meets 1, 2, ... in turn, so k - 1 sign tests name its centroid. Tasks add the
   vectors of each champion and send one row per centroid and component; Spark sums them, and no vector leaves its task.
4. The last assignment computes one exact distance per vector, to the winner.

Between rounds only the k centroids are on the driver. All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

# Fixed values of the contract.
CENTROIDS = 8
ROUNDS = 10
LENGTH = 64
SCALE = 1024
SALT = "3:"
# Squared distances, products with normals and sums of a task stay inside 64 bits up to this component.
SMALL = 2**27


def scaled(vectors: DataFrame, id_col: str, vector_col: str, length: int, scale: int) -> DataFrame:
    """Rows (vec_id, x) of the vectors that count, x as whole numbers."""
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == length)
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("x"))


def bisectors(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Normals [i, j] and thresholds [i, j] of all pairs; entries with i >= j are never read."""
    c = np.array(centroids, object)
    lengths = (c * c).sum(1)
    return c[None, :, :] - c[:, None, :], (lengths[None, :] - lengths[:, None]) // 2


def fitted(values: np.ndarray, limit: int) -> np.ndarray:
    """64-bit integers if all lie within ``limit``, else Python integers."""
    return values.astype(np.int64) if not values.size or max(values.max(), -values.min()) <= limit else values.astype(object)


def champions(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the centroid nearest to each row, by k - 1 sign tests; ties go to the smaller number."""
    best = np.zeros(len(x), np.int64)
    for j in range(1, len(normals)):
        beaten = ((x * normals[best, j]).sum(1) > thresholds[best, j]).astype(bool)
        best[beaten] = j
    return best


def matrices(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], length: int):
    """(batch, vectors, champions) for every batch that has rows."""
    normals, thresholds = bisectors(centroids)
    small = max(abs(v) for c in centroids for v in c) <= SMALL
    for batch in batches:
        if not batch.num_rows:
            continue
        x = fitted(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, length), SMALL)
        if small and x.dtype != object:
            sides = normals.astype(np.int64), thresholds.astype(np.int64)
        else:
            sides, x = (normals, thresholds), x.astype(object)
        yield batch, x, champions(x, *sides)


def partial_sums(centroids: list[list[int]], length: int) -> Callable:
    """Per task one row (cluster, place, total) for every component of every centroid, and its number of vectors at place ``length``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centroids), length + 1), object)
        for _, x, best in matrices(batches, centroids, length):
            for c in np.unique(best):
                own = x[best == c]
                totals[c, :length] += own.sum(0).astype(object)
                totals[c, length] += len(own)
        used = np.flatnonzero(totals[:, length])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(used, length + 1), pa.int32()), pa.array(np.tile(np.arange(length + 1), len(used)), pa.int32()),
            pa.array([str(v) for v in totals[used].ravel()], pa.string()),
        ], ["cluster", "place", "total"])
    return run


def moved(stored: DataFrame, centroids: list[list[int]], length: int) -> list[list[int]]:
    """The centroids after one round: componentwise floor of sum by count, empty ones as they were."""
    parts = stored.select("x").mapInArrow(partial_sums(centroids, length), "cluster int, place int, total string")
    # One row per centroid and component, whatever the number of vectors.
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = {(r["cluster"], r["place"]): int(r["total"]) for r in rows}
    return [
        [sums[c, d] // sums[c, length] for d in range(length)] if (c, length) in sums else old
        for c, old in enumerate(centroids)
    ]


def assigned(stored: DataFrame, centroids: list[list[int]], length: int) -> DataFrame:
    """Rows (vec_id, cluster, distance), the squared distance exact."""
    kind = stored.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.array(centroids, object)
        for batch, x, best in matrices(batches, centroids, length):
            off = x - (centres if x.dtype == object else centres.astype(np.int64))[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array((off * off).sum(1).tolist(), pa.int64())],
                ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def bisector_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    length: int = LENGTH, scale: int = SCALE, salt: str = SALT,
) -> DataFrame:
    """One row per vector that counts: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector counts if it has exactly ``length`` components, none of them null or non-finite; a
    null vector or one of another length gives no row. The first centroids are the ``k`` vectors
    with the smallest SHA-256 of salt and id (a null id is the empty text; rows that repeat an id
    are ordered by their components); fewer vectors than ``k`` make as many centroids. Rows that
    repeat are assigned one by one. An empty table gives no rows. Squared distances and their sums must fit into 64 bits,
    else the job ends with an error. Other columns are not read.
    """
    stored = materialise(scaled(vectors, id_col, vector_col, length, scale))
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [list(r["x"]) for r in stored.orderBy(name, "x").limit(k).collect()]
    if not centroids:
        return stored.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(n) for n in (
            "distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(stored, centroids, length)
    rows = materialise(assigned(stored, centroids, length))
    sums = dict(rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = F.array(*[F.lit(int(sums.get(c, 0))).cast("long") for c in range(len(centroids))])
    return rows.select(
        "vec_id", "cluster", "distance", of_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(int(sum(sums.values()))).cast("long").alias("inertia"), F.array(*map(F.lit, hashes))[F.col("cluster")].alias("centroid_sha256"),
    )


def op12_bisector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector_clusters(table(spark, sf_dir, "embeddings"))


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds written out as common table expressions, distances by definition."""
    def nearest(centres: str) -> str:
        return f"""SELECT n, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM vectors v CROSS JOIN {centres} c GROUP BY n"""

    parts = [f"""vectors AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, sha256('{SALT}' || vec_id) AS name,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY name) - 1 AS c, x FROM vectors ORDER BY name LIMIT {k})"""]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED ({nearest(f'c{r}')}), l{r} AS (
  SELECT best.c AS c, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM a{r} JOIN vectors USING (n)
), s{r} AS (SELECT c, d, sum(v) AS s, count(*) AS m FROM l{r} GROUP BY c, d), m{r} AS (
  SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY d) AS x FROM s{r} GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)""")
    last = f"c{rounds}"
    parts.append(f"final AS MATERIALIZED ({nearest(last)})")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string({last}.x, ',')) AS centroid_sha256
FROM final JOIN vectors USING (n) JOIN {last} ON {last}.c = best.c"""


ORACLE = oracle()
