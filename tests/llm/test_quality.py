import math
import re
import zlib

import numpy as np
import pyarrow as pa

from cinderlake.llm import quality
from cinderlake.llm.common import table

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, label int"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.op5_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.98
    assert (s[y == 1] >= 0.3).mean() > 0.99 and (s[y == 0] < 0.3).mean() > 0.9
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and 0.75 * docs.count() < good.count() < docs.count()


def test_same_weights_on_a_rerun_and_sparse_dots(spark):
    docs = spark.createDataFrame([(i, ("fine words here " if i % 2 else "bad !! ### ") * (1 + i % 3), "x", 0) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (999, 1)], "doc_id long, label int")
    a, b = (quality.train(docs, labels, parts=2) for _ in range(2))
    assert np.array_equal(a, b)
    got = {r.doc_id: r.score for r in quality.score(docs, a).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))


def test_updates_against_one_coordinate_at_a_time():
    """FTRL-proximal as a dictionary of coordinates: w from z and n, then g, sigma, z and n."""
    rng = np.random.default_rng(5)
    rows = [(np.append(np.sort(rng.choice(50, 6, replace=False)), quality.SIZE), np.append(rng.random(6), 1.0), int(rng.random() < 0.4)) for _ in range(120)]
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    for k in np.random.default_rng(9).permutation(len(rows)):
        at, x, y = rows[k]
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at.tolist(), x.tolist(), strict=True))))
        w = {i: weight(i) for i in at.tolist()}
        for i, v in zip(at.tolist(), x.tolist(), strict=True):
            g = (p - y) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    zero = np.zeros(quality.SIZE + 1)
    got, squares = quality.ftrl(rows, zero, zero, seed=9)
    assert max(abs(got[i] - weight(i)) + abs(squares[i] - n.get(i, 0.0)) for i in [*range(60), quality.SIZE]) < 1e-9
    # a pass that goes on from a state without new rows changes nothing
    again, same = quality.ftrl([], got, squares, seed=1)
    assert np.allclose(again, got, atol=1e-12) and np.array_equal(same, squares)


def test_scores_against_a_dictionary():
    """Each text's dot product, gram by gram."""
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, quality.SIZE + 1)
    texts = ["a b a b c", "", None, "so so !! very--good 12", "é É x", "one", "word " * 50_000]
    got = quality.dots(pa.array(texts, pa.string()), weights)
    for text, score in zip(texts, got, strict=True):
        ones, twos = quality.features(pa.array([text], pa.string()))
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^\s0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        assert len(ones.hash) == len(words) and len(twos.hash) == max(0, len(words) - 1)
        total = sum(weights[h] for h in [*ones.hash.tolist(), *twos.hash.tolist()]) / math.sqrt(max(1, 2 * len(words) - 1)) + weights[-1]
        assert abs(total - score) < 1e-6


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 0), (2, "", "x", 0), (None, "word " * 200_000, "x", 0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, label int")
    weights = quality.train(docs, labels)
    assert [r.score for r in quality.score(docs, weights).collect()] == [0.5] * 3
    assert quality.score(docs.limit(0), weights).count() == 0
