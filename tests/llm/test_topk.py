import math
import random

import numpy as np
import pytest

from cinderlake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, every, k):
    vec = []
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            vec.append((i, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a, (q, x) in enumerate(vec):
        if q % every == 0:
            best = sorted((-sum(c * d for c, d in zip(x, y)), i) for b, (i, y) in enumerate(vec) if b != a and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, x, 1, "r") for i, x in rows], SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, **options).collect())


def test_repeated_ids(spark):
    """Rows with one id are all candidates, and all queries where the id asks."""
    rows = [(50, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (1, [0.9, 0.0])]
    assert run(spark, rows, every=50) == [(50, 1, 1, 58880), (50, 2, 1, 58880), (50, 3, 1, 32768)]
    rng = random.Random(5)
    rows = [(rng.randrange(40), [rng.choice([0.5, -0.25, 1.0]) for _ in range(3)]) for _ in range(300)]
    assert run(spark, rows, every=10, shard_bytes=40 * 24) == brute(rows, 10, 5)


@pytest.mark.parametrize("shard_bytes", [50 * 48, topk.SHARD_BYTES])
def test_against_brute_force(spark, shard_bytes):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # a very common vector
    rows += [(2000, None), (2010, []), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2030, [float("nan")] * 6), (2040, [float("inf")] * 6), (2050, [1.0, 2.0]), (2060, [0.5, 1.0]), (None, [0.1] * 6), (10, [0.9] * 6), (2070, [])]
    assert run(spark, rows, every=10, shard_bytes=shard_bytes) == brute(rows, 10, 5)


def test_large_components(spark):
    rows = [(i, [float(2**21 + i), float(-(2**17) * i)]) for i in range(60)]
    assert run(spark, rows, every=20) == brute(rows, 20, 5)
    held = run(spark, [(i, [1e30 * (i + 1)]) for i in range(9)])
    assert held == [(0, n + 1, n + 1, 2**63 - 1) for n in range(5)]


def test_long_vectors(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(5000)]) for i in range(30)]
    assert run(spark, rows, every=10, shard_bytes=200_000) == brute(rows, 10, 5)


def test_a_tree_is_moved_once_a_shard(spark, monkeypatch):
    """All queries of a shard stream past one copy of its tree, in waves."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plans, keep = [], topk.Scratch.keep

    def noted(self, frame, name, **options):
        if name.startswith("best"):
            plans.append(frame._jdf.queryExecution().toString())
        return keep(self, frame, name, **options)

    monkeypatch.setattr(topk.Scratch, "keep", noted)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every=10, shard_bytes=1600).collect())
    assert got == brute(rows, 10, 5)
    assert len(plans) == 3  # 12 shards: the home, 3 more, the other 8
    for plan in plans:
        physical = plan.split("== Physical Plan ==")[1]
        assert "Union" in physical and "MapInArrow" in physical and "CartesianProduct" not in physical and "NestedLoop" not in physical


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 50, 5)
    assert run(spark, rows[:0]) == []
    assert run(spark, rows[1:]) == []


def test_pruning_visits_fewer_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (16, 3))
    x = np.floor(np.concatenate([c + rng.normal(0, 5, (250, 3)) for c in centres]))
    tree = topk.build(np.arange(len(x)), np.arange(len(x)), x, leaf=64)
    seen, real = 0, topk._product

    def counted(a, q):
        nonlocal seen
        seen += len(a)
        return real(a, q)

    topk._product = counted
    try:
        got = topk.search(tree, -1, x[0], 5, [])
    finally:
        topk._product = real
    want = sorted(((int(s), -i) for i, s in enumerate(x @ x[0])), reverse=True)[:5]
    assert got == want and seen < len(x) / 4
