"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities.

A component x becomes the integer floor(256 * x).  Equal vectors are grouped first, with the number of rows that have them, so a vector that many rows share is one row of all
rounds.  A round assigns each distinct vector to its nearest centroid (ties: the smaller number) and adds up components times multiplicity by cluster;
a non-empty centroid becomes the floor of sum over count, an empty one stays.  Assignments are joined back to the rows at the end.

Only the ``k`` centroids go to all tasks and back to the driver, whatever the number of vectors.  Sums are exact: a task adds in integers and gives each sum in limbs of
40 bits, which Spark adds as longs and the driver puts together; sums of up to 4 million tasks stay exact.  Distances are exact too: in double precision while they stay below
2 ** 53, else in Python integers.  The join back sends the most frequent vectors by broadcast and shuffles the rest.

Edge cases: vectors that are null, of another length, or hold null or non-finite components (256-fold included) take no part; rows that repeat a
vec_id each count; a null vec_id takes part but is the last choice for a start (among equal hashes the smaller vector comes first); with fewer than ``k`` vectors each is a centroid; distances and inertias beyond a long are held at its limit; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, table

K, DIM, ROUNDS, SEED = 40, 64, 5, 2
LIMB, MOST = 40, (1 << 63) - 1


def quantised(x: Column) -> Column:
    """floor(256 * x) as a double, which holds it exactly; -0.0 becomes 0.0."""
    y = x.cast("double") * 256
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)


def vectors(df: DataFrame, dim: int) -> DataFrame:
    """vec_id, vector."""
    v = F.col("embedding")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf")))
    return df.select("vec_id", "embedding").filter(v.isNotNull() & good).select("vec_id", F.transform(v, quantised).alias("vector"))


def _exact(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether squared distances stay exact in double precision."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    return 4.0 * most * most * max(x.shape[1], 1) < 2.0**53


def assign(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of whole numbers, and the squared distance (held at a long's limit)."""
    c = np.array([[float(v) for v in row] for row in centroids])
    if _exact(x, c):
        square = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)
        best = square.argmin(axis=1)
        return best, square[np.arange(len(x)), best].astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    found = [min((sum((a - b) ** 2 for a, b in zip(row, mean, strict=True)), i) for i, mean in enumerate(centroids)) for row in whole]
    return np.array([i for _, i in found], np.int64), np.array([min(d, MOST) for d, _ in found], np.int64)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _limbs(total: int) -> list[int]:
    """``total`` as the sum of limb[i] << (LIMB * i); all but the last are from 0 to 2 ** LIMB - 1."""
    out = []
    while not -(1 << (LIMB - 1)) <= total < 1 << (LIMB - 1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round over ``distinct`` (vector, n)."""
    dim = len(centroids[0])
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("part", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dim + 1), object)  # the last one counts rows
        for batch in batches:
            x, n = _rows(batch.column("vector"), dim), batch.column("n").to_numpy()
            best, _ = assign(x, centroids)
            small = np.abs(x).max(initial=0) * float(n.sum()) < 2.0**62
            y = x.astype(np.int64) if small else np.array([[int(v) for v in row] for row in x], object)
            for c in np.unique(best):
                mine = best == c
                weighted = (y[mine] * n[mine, None]).sum(axis=0)
                total[c] = total[c] + np.array([*(int(v) for v in weighted), int(n[mine].sum())], object)
        rows = [(c, d, i, limb) for c in range(len(centroids)) for d in range(dim + 1) if total[c, dim] for i, limb in enumerate(_limbs(int(total[c, d])))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    added = distinct.mapInArrow(sums, "cluster int, place int, limb int, part long").groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part"))
    total: dict[tuple[int, int], int] = {}
    for r in added.collect():  # k * (dim + 1) sums
        total[r.cluster, r.place] = total.get((r.cluster, r.place), 0) + (r.part << (LIMB * r.limb))
    return [[total[c, d] // total[c, dim] for d in range(dim)] if total.get((c, dim)) else old for c, old in enumerate(centroids)]


def cluster(df: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, vector, cluster, distance of every vector that takes part, and the final centroids."""
    scratch = Scratch(df.sparkSession, "clustering")
    rows = scratch.keep(vectors(df, dim), "rows")
    distinct = scratch.keep(rows.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "distinct")
    chosen = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
    centroids = [[int(v) for v in r.vector] for r in chosen]
    if not centroids:
        return rows.select("vec_id", "vector", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(distinct, centroids)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = assign(_rows(batch.column("vector"), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("n"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vector", "n", "cluster", "distance"])

    nearest = scratch.keep(distinct.mapInArrow(near, "vector array<double>, n long, cluster int, distance long"), "nearest")
    return join_hot(rows, nearest, ["vector"], "n", rows.count()), centroids


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster and distance, with the cluster's and the whole inertia and the hash of the cluster's centroid."""
    scratch = Scratch(spark, "clusters")
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = scratch.keep(found.select("vec_id", "cluster", "distance"), "assigned")
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    long = lambda total: F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("sum"))  # k rows
    whole = inertia.agg(F.sum("sum").alias("all"))
    per = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string").join(inertia, "cluster").crossJoin(whole)
    per = per.select("cluster", long(F.col("sum")).alias("cluster_inertia"), long(F.col("all")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """SQL of round i: c{i} to c{i + 1}."""
    return f"""
d{i} AS (SELECT v.vec_id, v.x, c.cluster, CAST(list_sum(list_transform(range(1, {DIM + 1}), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))) AS BIGINT) AS distance FROM v, c{i} c),
a{i} AS (SELECT vec_id, any_value(x) AS x, min((distance, cluster)) AS best FROM d{i} GROUP BY vec_id),
s{i} AS (SELECT cluster, j, sum(x) AS total, count(*) AS n FROM (SELECT best[2] AS cluster, unnest(range(1, {DIM + 1})) AS j, unnest(x) AS x FROM a{i}) GROUP BY cluster, j),
m{i} AS (SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster)),"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, x
  FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT {K})),{"".join(map(_round, range(ROUNDS)))}
d AS (SELECT v.vec_id, c.cluster, CAST(list_sum(list_transform(range(1, {DIM + 1}), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))) AS BIGINT) AS distance FROM v, c{ROUNDS} c),
a AS (SELECT vec_id, min((distance, cluster)) AS best FROM d GROUP BY vec_id)
SELECT vec_id, c.cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY c.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} c ON c.cluster = best[2]
"""
