import random
import re

import pytest

from cinderlake.llm.jaccard_join import choose_bands, jaccard_join, keep_one
from cinderlake.llm.common import table

SCHEMA = "doc_id long, text string, fp_a string, block int"
SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            A, B = sets[a], sets[b]
            if A == B or (A and B and len(A & B) >= 0.8 * len(A | B)):
                links[a].add(b), links[b].add(a)
    label = {}
    for i in ids:
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += links[x]
    return {i: (min(j for j in ids if sets[j] == sets[i]), label[i], len(links[i])) for i in ids}


def result(df):
    return {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in df.collect()}


def test_bands():
    bands, rows = choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_documents_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert result(jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("options", [{"block": 7}, {"block": 1000}, {"block_shingles": 700}])
def test_hot_group_in_blocks(spark, options):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(base)) for i in range(20)] + [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "One, two")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert result(jaccard_join(docs, **options)) == brute(rows)


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**7)}" for _ in range(250_000)]
    near = [w if k % 400 else "changed" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[100_000:])), (4, " ".join(words)), (5, "w" * 3_000_000)]
    got = result(jaccard_join(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)))
    assert got == {1: (1, 1, 2), 2: (2, 1, 2), 3: (3, 3, 0), 4: (1, 1, 2), 5: (5, 5, 0)}


def test_recall_by_similarity(spark):
    """Pairs at each similarity from 0.8 on are found; below it none is."""
    rng, rows, want = random.Random(8), [], {}
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        near = list(words)
        for at in rng.sample(range(0, 200, 8), k % 7):
            near[at] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[2 * k + 1] = len(a & b) / len(a | b)
    got = result(jaccard_join(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)))
    for low, high in ((0.7, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        hit = [got[i][1] == i - 1 for i, j in want.items() if low <= j < high]
        print(f"similarity {low} to {high}: {sum(hit)} of {len(hit)} found")
        assert hit and all(hit) if low >= 0.8 else not any(hit)


def test_empty_null_repeated(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1)] * 3 + [(None, "a b c d e f", "x", 1), (2, "A b c d e f!", None, 2)], SCHEMA)
    assert result(jaccard_join(docs)) == {1: (1, 1, 1), 2: (1, 1, 1)}
    assert sorted(r.doc_id or 0 for r in keep_one(docs).collect()) == [0, 1, 1, 1]
