import random
from collections import Counter

import numpy as np
import pytest

from cinderlake.llm.common import table
from cinderlake.llm.mixing import mix, mix_documents, op6_mixing, schedule, targets

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, slot string, rank int"


def in_one_pass(weights, slots):
    """Earliest deadline first, slot by slot, with whole-number weights."""
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(slots):
        i = min((-(-(d + 1) * total // w), i) for i, (d, w) in enumerate(zip(done, weights, strict=True)) if d * total // w <= t)[1]
        out.append((i + 1, done[i], t))
        done[i] += 1
    return out


def scheduled(spark, weights, slots, segment):
    rows = spark.createDataFrame([(f"s{i:03d}", float(w), 10**9) for i, w in enumerate(weights)], "source string, weight double, blocks long")
    row = targets(rows)
    whole = [x.w for x in row.first()["list"]]
    got = sorted((r.rank, r.block, r.slot) for r in schedule(spark, row, slots, segment).collect())
    return whole, [x for x in got if x[2] < slots]


@pytest.mark.parametrize("seed", range(6))
def test_segments_give_the_schedule_of_one_pass(spark, seed):
    rng = random.Random(seed)
    n, segment = rng.choice([1, 2, 3, 7, 20]), rng.choice([5, 8, 32])
    weights = [rng.choice([rng.random(), rng.randrange(1, 4), 0.01, 1e-4]) for _ in range(n)] if seed else [0.099] * 5 + [0.0101] * 50
    whole, got = scheduled(spark, weights, 40 * segment, segment)
    assert got == sorted(in_one_pass(whole, 40 * segment))


def test_deviation_over_a_million_slots(spark):
    """Every source is less than one block off the weights as given, at every slot."""
    weights = [0.5003, 0.2994, 0.2003 - 1e-5, 1e-5]
    _, got = scheduled(spark, weights, 1_000_000, 512)
    assert sorted(x[2] for x in got) == list(range(1_000_000))
    total = sum(weights)
    for rank, w in enumerate(weights, 1):
        own = np.array(sorted((b, s) for r, b, s in got if r == rank))
        assert (own[:, 0] == np.arange(len(own))).all()
        ideal = w / total * own[:, 1]
        # behind by less than one just before the block, ahead by less than one just after it
        assert (ideal - own[:, 0]).max() < 1 - 1e-9 and (own[:, 0] + 1 - ideal - w / total).max() < 1 - 1e-9


def test_given_weights(spark):
    rows = [(i, f"text {i}", s, "x", 1) for s, n in (("a", 5000), ("b", 3000), ("c", 1000), (None, 400), ("zero", 30), ("unlisted", 9)) for i in range(n)]
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), (None, 0.05), ("zero", 0.0)], "source string, weight double")
    got = mix(spark.createDataFrame(rows, SCHEMA), weights, block=4, segment=64).collect()
    assert Counter((r.source, r.doc_id) for r in got) == Counter((r[2], r[0]) for r in rows)
    blocks = {}
    for r in got:
        blocks.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(b) == 1 for b in blocks.values())
    assert min(r.slot for r in got if r.source in ("zero", "unlisted")) > max(r.slot for r in got if r.source not in ("zero", "unlisted"))
    seen = Counter()
    for slot in range(1000):  # while every source has blocks
        ((source, block),) = blocks[slot]
        assert block == seen[source]
        seen[source] += 1
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15), (None, 0.05)):
            assert abs(seen[s] - w * (slot + 1)) < 1, (s, slot)


def test_documents_all_stay_in_order(spark):
    docs = table(spark, SF, "documents")
    order = {r.doc_id: (r.slot, r.place) for r in op6_mixing(spark, SF).collect()}
    got = [r.doc_id for r in mix_documents(docs).select("doc_id").collect()]
    assert got == sorted(order, key=order.get) and len(got) == docs.count()
    assert mix_documents(docs).columns == docs.columns


def test_edges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice(["x", "y", None, ""]), rng.choice(["a", None]), "s", 0) for _ in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mix(df, block=2).count() == 60 and mix_documents(df).count() == 60
    assert mix(df.limit(0)).count() == 0
    long = spark.createDataFrame([(k, "very long " * 300_000, None, "s", 0) for k in range(3)], SCHEMA)
    assert [(r.slot, r.place) for r in mix(long).orderBy("slot", "place").collect()] == [(0, 0), (0, 1), (0, 2)]
