import hashlib
import random
import re
import time

import numpy as np

from cinderlake.llm import pii
from cinderlake.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_base(text):
    """The contract's patterns, as they stand."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_on_random_text():
    rng = random.Random(1)
    parts = ["a", "é", "@", ".", "@b.", "c-d", "1", "25", "255", "0", "+", "+1", " ", "-", "(", ")", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "\n", "x@y.z", "300.", "%_"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "+1 ", "a@", "@", "1 ", "a1"):
        pii.base_spans(unit * 300_000)


def test_added_spans_take_linear_time():
    weights = np.frombuffer(pii.train()).reshape(len(pii.KINDS), -1)
    for unit, n in (("a" * 260 + "1", 40_000), ("a@", 300_000), ("=1", 300_000), ("1 ", 30_000)):
        start = time.time()
        pii.added_spans(unit * n, [], weights)
        assert time.time() - start < 10, unit


def every_segmentation(n, segs):
    """All sets of non-overlapping segments over n chunks."""
    if n == 0:
        yield []
        return
    for rest in every_segmentation(n - 1, segs):
        yield rest
    for s in segs:
        if s[1] == n:
            for rest in every_segmentation(s[0], segs):
                yield [*rest, s]


def test_decoder_against_all_segmentations():
    weights = np.frombuffer(pii.train()).reshape(len(pii.KINDS), -1)
    rng, parts = random.Random(8), ["call", "(441)", "555-3597", "10.0.0.1", "token", "=", "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6", "4111", "1111", "x@y.z", "+1", "2024"]
    for _ in range(150):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        chunks = pii.chunks_of(text, 0, len(text))
        segs = [(i, j, y, float(weights[y, f].sum())) for i, j, f in pii.segments(text, chunks) for y in range(len(pii.KINDS))]
        best = max(sum(s[3] for s in one) for one in every_segmentation(len(chunks), [max((s for s in segs if s[:2] == ij), key=lambda s: s[3]) for ij in {s[:2] for s in segs}]))
        got = pii.decode(text, chunks, weights)
        at = {(chunks[i][0], chunks[j - 1][1], y): w for i, j, y, w in segs}
        assert abs(sum(at[a, b, y] for a, y, b in got) - best) < 1e-9 and all(x[2] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_planted_data_is_found(spark):
    """The tables' assigned hexadecimal tokens are all found, and no other secret is."""
    planted = found = extra = 0
    for d in table(spark, "/root/testdata/sf0.1", "documents").select("text").collect():
        text = d.text or ""
        want = {(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', text, re.I)}
        base = pii.base_spans(text)
        got = {(a, e) for a, y, e in pii.added_spans(text, base, np.frombuffer(pii.train()).reshape(len(pii.KINDS), -1)) if pii.KINDS[y] == "secret"}
        planted, found, extra = planted + len(want), found + len(want & got), extra + len(got - want)
    print(f"secrets planted {planted}, found {found}, others {extra}")
    assert planted > 50 and found == planted and extra == 0


def test_decoder_on_unseen_sentences():
    weights = np.frombuffer(pii.train()).reshape(len(pii.KINDS), -1)
    rng, right, wrong = random.Random(77), 0, 0
    for _ in range(200):
        text, gold = pii._sentence(rng)
        got = set(pii.decode(text, pii.chunks_of(text, 0, len(text)), weights))
        right, wrong = right + len(got & gold), wrong + len(got ^ gold)
    assert wrong <= 0.03 * right


def test_windows_give_the_same_as_whole_texts():
    weights = np.frombuffer(pii.train()).reshape(len(pii.KINDS), -1)
    rng = random.Random(5)
    for _ in range(40):
        text = (" plain words" * rng.randrange(60)).join(pii._sentence(rng)[0] for _ in range(4))
        whole = [x for x in pii.decode(text, pii.chunks_of(text, 0, len(text)), weights) if x[1] >= 4]
        assert pii.added_spans(text, [], weights) == whole


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in pii.op9_pii(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base, r = brute_base(d.text), rows[d.doc_id]
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        assert set(said) <= set(r.spans.split(",")) or not said
        spans = [x.split(":")[0] for x in r.spans.split(",") if x]
        assert (r.n_secret, r.n_local_phone, r.n_spans) == (spans.count("secret"), spans.count("local_phone"), len(spans))
    assert sum(r.n_secret for r in pii.op9_pii(spark, "/root/testdata/sf0.01").collect()) > 9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "é mail a@b.co", 3), (3, "call (441) 555-3597 now", 4)] * 2, "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find(docs).collect())
    assert got == sorted([(0, [("email", 7, 13)]), (1, []), (2, []), (3, [("local_phone", 5, 19)])] * 2)
    assert pii.find(docs.limit(0)).count() == 0
