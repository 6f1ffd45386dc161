import random
import re

from cinderlake.llm.common import table
from cinderlake.llm.decontaminate import contamination, drop_contaminated

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def grams(text):
    """Runs of 1 to 5 words."""
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)}


def brute(docs, items, threshold=0.8):
    sets = {}
    for i, t in items:
        sets[i] = sets.get(i, set()) | shingles(t)
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    out = set()
    for d, t in docs:
        hits = {}
        for x in grams(t):
            for i in where.get(x, ()):
                hits[i] = hits.get(i, 0) + 1
        out |= {(d, i, n) for i, n in hits.items() if n >= threshold * len(sets[i])}
    return out


def result(df):
    return {(r.doc_id, r.item_id, r.common) for r in df.collect()}


def test_documents_against_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert expected and result(contamination(docs, items)) == expected


def test_items_of_all_sizes_in_long_documents(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(k, " ".join(word() for _ in range(5 + k * 3))) for k in range(60)] + [(90, "too short"), (91, None), (92, ""), (93, "Solo"), (94, "a b c d"), (94, "one two three four five six"), (95, "ends, here")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(rng.randrange(3000))]
        at = rng.randrange(len(body) + 1)
        text = items[k][1].split()
        if k % 3 == 2 and len(text) > 60:
            text[30] = "changed"
        docs.append((k, " ".join(body[:at] + text + body[at:]), 1))
    docs += [(100, None, 1), (101, "", 1), (102, "is too SHORT now", 1), (103, "solo", 1), (104, "so. low a b c d", 1), (105, "it ends", 1), (105, "here", 1), (None, "x " + items[5][1], 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute([d[:2] for d in docs if d[0] is not None], items)
    assert len(expected) == 62 and result(contamination(frame, bench)) == expected
    assert sorted(r.doc_id for r in drop_contaminated(frame, bench).collect()) == [100, 101, 104, 105, 105]


def test_repeats_boilerplate_and_long_texts(spark):
    """Boilerplate that all items share, repeated items and documents, short passages inside a very long text."""
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(10**6)}"
    common = " ".join(f"boiler{k}" for k in range(12))
    items = [(k, common + " " + " ".join(word() for _ in range(rng.choice([6, 9, 30])))) for k in range(80)] * 2
    items += [(200 + k, " ".join(word() for _ in range(5 + k % 4))) for k in range(40)]
    filler = " ".join(word() for _ in range(300_000))
    docs = [(k, f"{common} and {word()} {items[k][1] if k % 4 == 0 else common}") for k in range(80)] * 2
    docs += [(500, filler + " " + " ".join(f"{t} {word()}" for _, t in items[160:]) + " " + filler)]
    expected = brute(docs, items)
    assert len(expected) == 60
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(contamination(frame, spark.createDataFrame(items, "item_id long, text string"))) == expected


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert contamination(docs, items).count() == 0
    assert contamination(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
