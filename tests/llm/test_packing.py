import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cinderlake.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
FILES = VOCABULARY, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, start int, ids string, part string"


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def held(pieces, size=2048):
    """Sequences as lists of pieces; every rule that holds for any input is asserted."""
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0 and 0 <= p.start and p.start + p.length <= p.doc_tokens
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        at = 0
        for p in s:
            assert p.offset == at
            at += p.length
        assert at == size or at < size and at & (at - 1) == 0
    return sequences


def documents(pieces):
    """The ids of each document, from its pieces; ids of repeated rows are told apart by how often each place is held."""
    out = defaultdict(lambda: defaultdict(list))
    for p in pieces:
        for k, i in enumerate(np.frombuffer(p.ids, "<u4").tolist()):
            out[p.doc_id, p.doc_tokens][p.start + k].append(i)
    return out


def make(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("size, windows, fan, parts", [(64, 3, 2, 9), (2048, 64, 256, 3), (32, 1, 256, 1), (64, 8, 3, 30)])
def test_round_trip(spark, whole, size, windows, fan, parts):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "word", "Zürich", "日本語", "1234", "!?", "'s", "<|endoftext|>", " ", "tail ", "\x1c", "naïve "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(120)]
    pieces = packing.pack(make(spark, rows, parts), *FILES, size=size, open_windows=windows, fan=fan).collect()
    got = documents(pieces)
    for i, text in rows:
        want = whole(text)
        assert [v for _, v in sorted(got[i, len(want)].items())] == [[x] for x in want]
    sequences = held(pieces, size)
    total = sum(p.length for p in pieces)
    assert sum(sum(p.length for p in s) == size for s in sequences.values()) == total // size  # no padding but powers of two
    assert len(sequences) - total // size == bin(total % size).count("1")


def test_edges(spark, whole):
    long = "x" * 30000 + " " + "many words of one text " * 3000
    rows = [(1, None), (2, ""), (None, "no id"), (3, long), (4, "twice"), (4, "twice"), (5, " "), (6, "a ")]
    pieces = packing.pack(make(spark, rows), *FILES).collect()
    held(pieces)
    got = documents(pieces)
    assert got[1, 1] == {0: [1]} and got[2, 1] == {0: [1]}
    for i, text, times in ((None, "no id", 1), (3, long, 1), (4, "twice", 2), (5, " ", 1), (6, "a ", 1)):
        want = whole(text)
        assert [v for _, v in sorted(got[i, len(want)].items())] == [[x] * times for x in want]
    assert packing.pack(make(spark, [], 1), *FILES).count() == 0


def test_documents_stay_whole_where_they_fit():
    """Best fit: 30 rests of 700 ids go two to a window; only emitted windows are filled by a cut."""
    packer = packing.Packer(2048, 4)
    for i in range(12):
        packer.add(i, bytes(4 * 1000))
    assert len(packer.windows) <= 4 and all(len(w) >= 2 for w in packer.done)
    packer = packing.Packer(10, 2)
    for i, n in enumerate([6, 7, 3, 4]):
        packer.add(i, bytes(4 * n))
    assert [[p[0] for p in w] for w in packer.done] == [[1, 2], [0, 3]] and not packer.windows


def test_encoder_against_whole_texts(whole):
    rng = random.Random(9)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "Foo", "é", "日本", "12", "!", "\x1c", " ", "<|endoftext|>", "'s", "　", "​", ".", "w" * 60]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    encode = packing.Encoder(*FILES)
    for _ in range(2):  # the second time from the table
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(pa.array(texts))] == [whole(t)[:-1] for t in texts]


def test_query(spark, whole):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: whole(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op11_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and sum(r.length for r in rows) == sum(map(len, texts.values()))
    for r in rows:
        ids = texts[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
