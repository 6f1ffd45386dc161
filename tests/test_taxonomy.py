"""Classification by a taxonomy table against a plain one-text reader; phrases against plain containment."""

import random
import re

import pytest

from cinderlake.operators import taxonomy as T


def plain(rows, taxonomy, top=3):
    by = {}
    for c, k in taxonomy:
        if c is not None and k is not None:
            by.setdefault(k.lower(), set()).add(c)
    out = []
    for i, text in rows:
        clean = re.sub(r"[^a-z0-9\s-]", " ", (text or "").lower())
        terms = [w for w in clean.split() if len(w) > 2 and w not in T.STOPWORDS] + [k for k in by if " " in k and k in clean]
        n = {}
        for t in terms:
            for c in by.get(t, ()):
                n[c] = n.get(c, 0) + 1
        conf = {c: min(m / max(max(n.values()), len(terms)) + 0.02 * c.count("."), 0.99) * (0.7 if m < len(terms) / 2 else 1) for c, m in n.items()}
        total = max(1, sum(conf.values()))
        best = sorted(conf, key=lambda c: (-round(conf[c] / total, 9), c))[:top]
        out += [(i, c, n[c], round(conf[c] / total, 9), r + 1) for r, c in enumerate(best)]
    return sorted(out, key=repr)


def run(spark, rows, taxonomy, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, rank int").repartition(3)
    tax = spark.createDataFrame(taxonomy, "class string, keyword string")
    return sorted(((r.doc_id, r["class"], r.matches, round(r.confidence, 9), r["rank"]) for r in T.classify(docs, tax, **options).collect()), key=repr)


HAZARDS = [("flood", "flood"), ("flood", "water"), ("flood.coastal", "storm surge"), ("flood.coastal", "coastal"), ("flood.river", "river flood"), ("flood.river", "River"), ("fire", "wildfire"), ("fire.urban.interface", "wildland urban interface"), ("storm", "storm surge"), ("storm", "wind")]


def test_hazard_texts(spark):
    rows = [(1, "Storm surge and coastal flood: water, water!"), (2, "A wildfire at the wildland-urban interface"), (3, "fire in the wildland urban interface"), (4, "riverine RIVER flooding"), (5, "nothing here"), (6, None), (7, ""), (None, "wind"), (1, "wind"), (8, "suburban storm surges")]
    got = run(spark, rows, HAZARDS + [(None, "wind"), ("x", None), ("flood", "FLOOD")])
    assert got == plain(rows, HAZARDS)
    assert ("flood.coastal" in {g[1] for g in got if g[0] == 8}) and not any(g[0] in (5, 6, 7) for g in got)


@pytest.mark.parametrize("shard", [7, 1000])
def test_many_patterns(spark, shard):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    taxonomy = [(f"c{rng.randrange(9)}.{rng.randrange(3)}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 1, 2, 3])))) for _ in range(300)]
    rows = [(i, rng.choice([" ", "-", ". "]).join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(150)] + [(900 + i, "abc bca " * 2000) for i in range(3)]
    assert run(spark, rows, taxonomy, shard=shard) == plain(rows, taxonomy)


def test_a_hundred_thousand_patterns(spark):
    taxonomy = spark.range(100_000).selectExpr("concat('k', id % 100) AS class", "concat('word', id, ' next', id) AS keyword")
    docs = spark.createDataFrame([(1, "word77777 next77777 word1 next2"), (2, "word9 next99")], "doc_id long, text string")
    assert {(r.doc_id, r["class"]) for r in T.classify(docs, taxonomy).collect()} == {(1, "k77"), (2, "k9")}


def test_empty(spark):
    assert run(spark, [], HAZARDS) == [] and run(spark, [(1, "wind")], []) == []
