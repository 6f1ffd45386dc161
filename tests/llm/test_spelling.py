import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from cinderlake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, form string"


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, mark=97, letters=5, times=3, ratio=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % mark == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= times}
    near = {w: [v for v in n if distance_one(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = spelling.variants(df.repartition(3), **options).collect()
    assert len({r.word for r in got}) == len(got)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("mark", [97, 3])
def test_against_brute_force(spark, mark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    base += ["wordword", "aaaaaa", "aaaaa", "Éclair", "eclair", "ÉCLAIR", "cafés×÷"]
    rows = []
    for i in range(300):
        words = []
        for w in rng.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=30):
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abz") + w[p:], w[:p] + rng.choice("abz") + w[p + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    got = run(spark, rows, mark=mark)
    assert got == brute(rows, mark) and sum(r[1] is not None for r in got) > 20 and any(r[1] != r[2] and r[1] for r in got)


def test_chain_of_forms(spark):
    """A root many forms away."""
    words = ["abcdefgh", "bbcdefgh", "bccdefgh", "bcddefgh", "bcdeefgh"]
    rows = [(1, " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k)))]
    got = run(spark, rows, mark=10**9 + 7)
    assert got == brute(rows, 10**9 + 7) and {r[2] for r in got} == {words[-1]}


def test_edges(spark):
    long = "longrun" * 3000
    rows = [(None, "nulls nulls nulls"), (1, None), (2, ""), (3, "a b c"), (4, long), (5, f"{long} {long}x"), (6, f"{long}x-{long}x"), (7, "twice again"), (7, "twice again"), (7, "twice again")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set() and run(spark, [(1, "12 !")]) == set()


def test_blocks(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 10)
    text = "abc defghijklmnopqrst uv" * 5
    parts = list(spelling.blocks(text))
    assert "".join(parts) == text and len(parts) > 3
    assert [w for p in parts for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_keys_of_each_word():
    words = ["abc", "aab", "ab", "é", "", "bbbb", "ac"]
    keys, ends = spelling.delete_keys(pa.array(words))
    of, by = {}, {}
    for i, w in enumerate(words):
        mine = keys[ends[i] : ends[i + 1]].tolist()
        strings = [w, *dict.fromkeys(w[:k] + w[k + 1 :] for k in range(len(w)))]
        assert len(mine) == len(strings) == len(set(strings)) or w == ""
        for s, k in zip(strings, mine, strict=False):
            assert of.setdefault(s, k) == k and by.setdefault(k, s) == s


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]+", t or ""))
    rows = [(i, t) for i, t in rows if t][: 200 if len(n) < 10**5 else 50]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variants(df).collect()
    assert len(got) > 300
    want = {r[0]: r for r in brute(rows)} if len(got) < 6000 else None
    if want:
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == set(want.values())
    whole = spelling.op12_spelling(spark, sf)
    assert whole.columns == ["word", "form", "root", "n", "n_near", "form_n"] and whole.count() >= len(got)
