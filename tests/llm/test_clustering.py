import hashlib
import math
import random

import numpy as np
import pytest

from cinderlake.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster int, n long, vector string"


def brute(rows, k, dim, rounds, seed=2):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(256 * float(np.float32(c))) for c in x]))
    hashed = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", x) for i, x in kept)
    means = [x for _, _, x in hashed[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for c in range(len(means)):
            mine = [x for (_, x), a in zip(kept, of) if a == c]
            if mine:
                means[c] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted(((i, nearest(x)[1], min(nearest(x)[0], 2**63 - 1)) for i, x in kept), key=repr), means


def run(spark, rows, k, dim, rounds):
    df = spark.createDataFrame([(i, x, 1, 5, "v") for i, x in rows], SCHEMA).repartition(3)
    found, means = clustering.cluster(df, k, dim, rounds)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=repr), means


@pytest.mark.parametrize("k, rounds", [(7, 5), (40, 3), (500, 2), (3, 0)])
def test_against_brute_force(spark, k, rounds):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(200)]
    rows += [(1000 + i, [0.25, -0.5, 0.0, 1.0]) for i in range(100)]  # a third of all rows
    rows += [(2000 + i, [-0.0, 0.0, -1e-9, 1e-9]) for i in range(5)]
    rows += [(3000, None), (3001, []), (3002, [1.0, None, 0.0, 0.0]), (3003, [float("nan")] * 4), (3004, [float("-inf")] * 4), (3005, [1.0] * 5), (None, [0.1] * 4), (7, [0.9] * 4), (7, [0.9] * 4)]
    assert run(spark, rows, k, 4, rounds) == brute(rows, k, 4, rounds)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(10 + i, [float(s), 0.0]) for i, s in enumerate((1, -1, 1, -1))]
    got = run(spark, rows, 8, 2, 5)
    assert got == brute(rows, 8, 2, 5) and len({c for _, c, _ in got[0]}) < 8  # equal starts: the smaller number takes all


def test_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e30, -3e20, 2.0**40, 5.0, -0.001]) * rng.random() for _ in range(3)]) for i in range(60)]
    assert run(spark, rows, 5, 3, 4) == brute(rows, 5, 3, 4)


def test_limbs():
    for v in (0, 1, -1, 2**39 - 1, 2**39, -(2**39), -(2**39) - 1, 10**60, -(10**60), 2**63, 2**120 - 1):
        limbs = clustering._limbs(v)
        assert sum(x << (40 * i) for i, x in enumerate(limbs)) == v and all(abs(x) < 2**40 for x in limbs)


def test_edges(spark):
    assert run(spark, [], 40, 64, 5) == ([], [])
    assert run(spark, [(1, [0.5, 0.5])], 40, 2, 5) == brute([(1, [0.5, 0.5])], 40, 2, 5)
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, means = brute(rows, 40, 64, 5)
    got = clustering.op13_clustering(spark, sf).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest() for r in got)
