import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.llm.common import table
from cinderlake.llm.sharding import even_out, first_places, in_sequence, op4_sharding, shard, shard_documents

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, shard string, size int"


def check(rows, texts, tolerance):
    """rows: (doc_id, size, crc, shard, slot)"""
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    assert set(by) <= set(range(8))
    for s in by.values():
        assert sorted(r[4] for r in s) == list(range(len(s)))
    load = [sum(r[1] for r in by.get(k, [])) for k in range(8)]
    assert max(load) - min(load) <= tolerance * sum(load) / 8, load
    return by


def taken(df):
    return [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]


def test_documents(spark):
    texts = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows = op4_sharding(spark, SF)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(taken(rows), texts, 0.005)


def follow_plainly(sums, shards, got):
    """Largest first: each crate must be at a shard with the highest dot product of its vector and the residual capacity, of those it fits."""
    totals = [max(sum(v[d] for v in sums), 1) for d in range(3)]
    vectors = [[v[d] / totals[d] for d in range(3)] for v in sums]
    room = [[1.0 / shards] * 3 for _ in range(shards)]
    for i in sorted(range(len(sums)), key=lambda i: -max(vectors[i])):
        v = vectors[i]
        fit = [s for s in range(shards) if all(room[s][d] - v[d] >= -1e-12 for d in range(3))]
        score = [sum(r * x for r, x in zip(room[s], v, strict=True)) if fit else min(room[s]) for s in range(shards)]
        best = max(score[s] for s in fit or range(shards))
        assert (not fit or got[i] in fit) and score[got[i]] >= best - 1e-15
        room[got[i]] = [r - x for r, x in zip(room[got[i]], v, strict=True)]


def test_placements_against_a_plain_packer():
    rng = random.Random(2)
    for shards, n in ((8, 300), (3, 40), (5, 4), (8, 0)):
        sums = [(rng.randrange(1, 10**6), rng.randrange(10**5), rng.randrange(1, 99)) for _ in range(n)]
        array = np.array(sums, np.int64).reshape(-1, 3)
        got = first_places(array, shards)
        follow_plainly(sums, shards, got)
        load = lambda place: np.bincount(place, weights=array[:, 0], minlength=shards)
        after = load(even_out(array, got.copy(), shards)) if n else load(got)
        assert np.ptp(after) <= np.ptp(load(got))


def test_groups_stay_together_and_hot_groups_are_spread(spark):
    rng = random.Random(1)
    texts = [(i, f"text {rng.randrange(600)} " * rng.randrange(1, 30)) for i in range(2000)] + [(5000 + i, "one text of a third of all rows " * 12) for i in range(1000)]
    texts += [(None, None), (9, ""), (9, ""), (9, "other")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], SCHEMA)
    by = check(taken(shard(df)), texts, 0.02)
    where = {}
    for s, rows in by.items():
        for r in rows:
            where.setdefault((r[1], r[2]), set()).add(s)
    hot = (len("one text of a third of all rows " * 12) + 1, zlib.crc32(b"one text of a third of all rows " * 12))
    assert len(where[hot]) == 8
    small = [k for k in where if k != hot and sum(1 for rows in by.values() for r in rows if (r[1], r[2]) == k) <= 2]
    assert all(len(where[k]) == 1 for k in small)


def test_documents_keep_their_columns(spark):
    texts = [(1, "a"), (1, "a"), (2, None), (None, "b"), (None, "b")]
    df = spark.createDataFrame([(i, t, "mine", 7) for i, t in texts], SCHEMA)
    out = shard_documents(df)
    assert out.columns == ["doc_id", "text", "size", "shard", "slot"] and out.count() == 5
    assert out.groupBy("shard", "slot").count().filter("count > 1").count() == 0


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [200, 1000, 10000])
def test_a_group_with_room_is_never_cut(spark, n):
    """Groups of up to a sixteenth of the table are in one shard, whatever the size of the table; larger ones are cut."""
    rng = random.Random(n)
    texts = [(i, f"own text {i} " * rng.randrange(1, 9)) for i in range(n // 2)]
    for g in range(9):
        texts += [(n + i, f"group {g} " * (g + 1)) for i in range(n * (g + 1) // 180)]  # up to a twentieth of the rows
    texts += [(3 * n + i, "large") for i in range(n // 4)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], SCHEMA)
    by = check(taken(shard(df)), texts, 0.02 if n > 200 else 0.1)
    where, rows, size = {}, {}, {}
    for s, held in by.items():
        for r in held:
            key = (r[1], r[2])
            where.setdefault(key, set()).add(s)
            rows[key] = rows.get(key, 0) + 1
            size[key] = size.get(key, 0) + r[1]
    total, weight = sum(rows.values()), sum(size.values())
    cut = {k for k in where if len(where[k]) > 1}
    assert all(rows[k] > total / 16 or size[k] > weight / 16 for k in cut)
    assert (len("large") + 1, zlib.crc32(b"large")) in cut


def test_no_table_has_torn_small_groups(spark):
    for sf in ("sf0.001", "sf0.01"):
        held = shard(table(spark, f"/root/testdata/{sf}", "documents")).toPandas()
        groups = held.groupby(["text_a", "text_b"]).agg(n=("shard", "size"), size=("size", "sum"), shards=("shard", "nunique"))
        whole = (groups.n <= len(held) / 16) & (groups["size"] <= held["size"].sum() / 16)
        assert (groups[whole].shards == 1).all()


def test_sequence_of_split_files(spark, tmp_path):
    """A task's files follow each other by their number, also past ten."""
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("s").alias("source"))
    df.repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 3).parquet(str(tmp_path / "docs"))
    got = in_sequence(spark.read.parquet(str(tmp_path / "docs"))).orderBy("at").collect()
    assert [r.doc_id for r in got] == list(range(100)) and len({r["at"] for r in got}) == 100
    out = shard_documents(spark.read.parquet(str(tmp_path / "docs")), order=in_sequence(spark.read.parquet(str(tmp_path / "docs"))), shards=3).collect()
    for s in range(3):
        mine = sorted((r.slot, r.doc_id) for r in out if r.shard == s)
        assert [i for i, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)
    assert in_sequence(df).orderBy("at").first().doc_id == 0  # of a plan
