"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are floor(256 * x) of each component.  Rows are numbered, as a vec_id may repeat, and dealt into shards of about ``shard_bytes`` by a hash of that number; each shard builds one
KD-tree (median splits on the widest side, leaves of ``leaf`` rows, tight bounding boxes), which is kept as one row.  Every query first searches one
shard, its home; its kth score and id then go with it to other shards, in waves that grow ``GROWTH``-fold, and after each wave the best kth of all
shards so far goes on.  In a shard the tree is walked best box first: a box whose bound (the sum over dimensions of the larger of
query * low and query * high) is under the query's kth score is skipped, and the walk ends at the first such box.  A box that only ties
is skipped if all its ids are larger than the kth id.  Results are exact; pruning only saves work.

Every query meets every shard because the search is exact.  They meet by the shard's number: a shard's tree is moved once a wave and
held by one task, through which the queries stream, a row each; a task holds a tree and a batch of queries.
Arithmetic is exact: in double precision while the squared sum stays below 2 ** 53, else in Python integers.

Edge cases: vectors that are null, or hold null, NaN or infinite components, take no part; vectors are compared with vectors of the same length;
null ids take no part; rows that repeat an id are rows like others: each is a candidate, the query's own row alone is not, and each with an id that asks is a query; ties go to the smaller vec_id;
fewer candidates than k give all; an empty table gives no rows; extra columns are ignored.  Scores beyond a long are held at its limits and tie there.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

K, SHARD_BYTES, GROWTH, LEAF = 5, 16 << 20, 4, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(df: DataFrame) -> DataFrame:
    """vec_id, dim, vector (array<double>, floored to whole numbers when packed)."""
    v = F.col("embedding")
    finite = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.select("vec_id", "embedding").filter(finite).select("vec_id", F.size("embedding").alias("dim"), v.cast("array<double>").alias("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0))
    return np.floor(flat * 256.0)


def build(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Rows in leaf order, and per node: box, children (or -1) and range of rows."""
    order = np.arange(len(ids))
    low, high, left, right, begin, end, least = [], [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        me = len(low)
        part = x[order[a:b]]
        lo, hi = part.min(axis=0), part.max(axis=0)
        low.append(lo), high.append(hi), left.append(-1), right.append(-1), begin.append(a), end.append(b), least.append(ids[order[a:b]].min())
        if b - a > leaf and (hi > lo).any():
            axis = int(np.argmax(hi - lo))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            todo.append((me, a, a + mid, b))
        return me

    todo: list[tuple[int, int, int, int]] = []
    node(0, len(ids))
    while todo:
        me, a, m, b = todo.pop()
        left[me], right[me] = node(a, m), node(m, b)
    return {"ids": ids[order], "rows": rows[order], "x": x[order], "low": np.array(low), "high": np.array(high), "left": np.array(left), "right": np.array(right), "begin": np.array(begin), "end": np.array(end), "least": np.array(least)}


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if x.size == 0 or np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2.0**53:
        return x @ q
    y = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, y, strict=True)), LEAST), MOST) for row in x], dtype=object)


def search(tree: dict, own: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``best``: (score, -vec_id) of results so far, at most k; returns it with this tree's rows taken in, but for row ``own``."""
    bound = np.maximum(tree["low"] * q, tree["high"] * q).sum(axis=1)
    bound = np.clip(bound + np.abs(bound) * 1e-12, LEAST, MOST)  # never below the exact bound
    heap = [(-bound[0], 0)]
    best = sorted(best, reverse=True)
    while heap:
        b, at = heapq.heappop(heap)
        if len(best) == k and (-b < best[-1][0]):
            break
        if len(best) == k and -b == best[-1][0] and tree["least"][at] > -best[-1][1]:
            continue
        if tree["left"][at] >= 0:
            for child in (tree["left"][at], tree["right"][at]):
                heapq.heappush(heap, (-bound[child], int(child)))
            continue
        a, e = tree["begin"][at], tree["end"][at]
        ids = tree["ids"][a:e]
        score = _product(tree["x"][a:e], q)
        use = tree["rows"][a:e] != own
        if len(best) == k:
            use &= score >= best[-1][0]
        found = np.flatnonzero(use)
        if len(found) > k:
            found = found[np.lexsort((ids[found], -score[found]))[:k]] if score.dtype != object else np.array(sorted(found, key=lambda i: (-score[i], ids[i]))[:k])
        best = sorted([*best, *((int(score[i]), -int(ids[i])) for i in found)], reverse=True)[:k]
    return best


def top_k(df: DataFrame, every: int = 50, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by ``every``, against all rows."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.keep(integer_vectors(df).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = vectors.count()
    # by length, so that a shard's bytes are bounded whatever the length
    shards = F.greatest(F.lit(1), F.ceil(F.lit(n) * F.greatest("dim", F.lit(1)) * 8 / shard_bytes)).cast("int")
    most = vectors.agg(F.max(shards)).first()[0] or 0

    def trees(key, t):
        made = build(t.column("vec_id").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("vector").combine_chunks(), key[1].as_py()))
        return pa.table({"shard": [key[0].as_py()], "dim": [key[1].as_py()], "tree": pa.array([pickle.dumps(made)], pa.binary())}, pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("tree", pa.binary())]))

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "row"), shards).cast("int"))
    forest = scratch.keep(dealt.groupBy("shard", "dim").applyInArrow(trees, "shard int, dim int, tree binary"), "trees")
    queries = vectors.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "dim", "vector", shards.alias("shards"), F.pmod(F.xxhash64(F.lit(2), "row"), shards).cast("int").alias("home"))
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (shard, dim), the tree's row before the queries'."""
        held, tree = None, None
        for batch in batches:
            shard, dim, rows, ids, kth_score, kth_id, made = (batch.column(c) for c in ("shard", "dim", "query", "query_id", "kth_score", "kth_id", "tree"))
            out = []
            for i, at in enumerate(zip(shard.to_pylist(), dim.to_pylist(), strict=True)):
                if made[i].is_valid:
                    held, tree = at, pickle.loads(made[i].as_py())
                elif held == at:
                    q, best = _matrix(batch.column("vector").slice(i, 1), at[1])[0], []
                    own = rows[i].as_py()
                    if kth_score[i].is_valid:  # k rows as good as the kth: only better ones come in
                        best = [(kth_score[i].as_py(), -kth_id[i].as_py())] * k
                    out += [(own, ids[i].as_py(), -v, s) for s, v in search(tree, own, q, k, best) if not best or (s, v) > best[0]]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], schema=schema)

    best, begin, end = None, 0, 1
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    while begin < most:
        turns = F.when(F.col("shards") > begin, F.sequence(F.lit(begin), F.least("shards", F.lit(end)) - 1))
        asked = queries.withColumn("turn", F.explode(turns))
        asked = asked.select("query", "query_id", "dim", "vector", F.pmod(F.col("home") + F.col("turn"), "shards").alias("shard"))
        kth = None if best is None else best.filter(F.col("rank") == k).select("query", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
        asked = asked.withColumns({"kth_score": F.lit(None).cast("long"), "kth_id": F.lit(None).cast("long")}) if kth is None else asked.join(kth, "query", "left")
        units = asked.withColumn("tree", F.lit(None).cast("binary")).unionByName(forest, allowMissingColumns=True)
        units = units.repartition("shard", "dim").sortWithinPartitions("shard", "dim", F.col("query").asc_nulls_first())
        found = units.select("shard", "dim", "query", "query_id", "vector", "kth_score", "kth_id", "tree").mapInArrow(seek, "query long, query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = scratch.keep(found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k), f"best-{begin}")
        begin, end = end, end * GROWTH
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
