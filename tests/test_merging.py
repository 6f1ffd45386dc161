"""Versioned merges and the box index against plain readers."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from cinderlake.functions import expr as E
from cinderlake.operators import boxindex as B
from cinderlake.operators.merging import VersionedTable, bucket

SCHEMA = "k long, s string, v double"
CHANGES = "k long, s string, v double, op string, at long, extra string"


def plain(state, changes):
    state = dict(state)
    last = {}
    for k, s, v, op, at in changes:
        if k is not None and op is not None and (k not in last or at > last[k][-1]):
            last[k] = (s, v, op, at)
    for k, (s, v, op, _) in last.items():
        if op == "delete":
            state.pop(k, None)
        elif op == "upsert":
            state[k] = (s, v)
        elif k in state:
            state[k] = (s if s is not None else state[k][0], v if v is not None else state[k][1])
    return state


def rows(df):
    return {r.k: (r.s, r.v) for r in df.collect()}


def changes(spark, made):
    return spark.createDataFrame([(*c, "x") for c in made], CHANGES)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_merges_against_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    path, state = str(tmp_path / "t"), {k: (f"s{k}", float(k)) for k in range(200)}
    t = VersionedTable(spark, path)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(spark.createDataFrame([(k, *x) for k, x in state.items()] + [(None, "no key", 1.0)], SCHEMA), ["k"], 8)
    with pytest.raises(FileExistsError):
        t.create(spark.createDataFrame([], SCHEMA), ["k"], 8)
    past = [dict(state)]
    for n in range(3):
        made = [(rng.randrange(260), rng.choice([None, "new", "other"]), rng.choice([None, rng.random()]), rng.choice(["upsert", "update", "delete"]), at) for at in range(120)]
        made += [(7, "hot", float(at), "upsert", 1000 + at) for at in range(60)] + [(None, "x", 1.0, "upsert", 1), (5, "x", 1.0, None, 9999)]
        assert t.merge(changes(spark, made)) == n + 1
        state = plain(state, made)
        past.append(dict(state))
    for version, want in enumerate(past):
        assert rows(t.read(version)) == want
    assert rows(t.read()) == state and t.read().columns == ["k", "s", "v"]
    assert t.forget(keep=2) > 0 and t.versions() == [2, 3] and rows(t.read(2)) == past[2] and rows(t.read()) == state
    t.merge(changes(spark, [(k, None, None, "delete", 1) for k in state]))
    assert rows(t.read()) == {}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    t = VersionedTable(spark, path)
    base = spark.range(1000).selectExpr("id AS k", "'a' AS s", "1.0D AS v")
    t.create(base, ["k"], 16)
    before, parts = files(path), t.manifest()["parts"]
    t.merge(changes(spark, [(3, "b", 2.0, "upsert", 1), (5000, "c", 3.0, "upsert", 1)]))
    after, now = files(path), t.manifest()["parts"]
    touched = {str(r[0]) for r in spark.createDataFrame([(3,), (5000,)], "k long").select(bucket(["k"], 16)).collect()}
    assert {k: after[k] for k in before} == before and {b for b in now if now[b] != parts.get(b)} == touched
    assert len(after) - len(before) == len(touched) and t.read().count() == 1001


def test_of_two_writers_one_runs_again(spark, tmp_path):
    path = str(tmp_path / "t")
    first, second = VersionedTable(spark, path), VersionedTable(spark, path)
    first.create(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA), ["k"], 4)
    tries, merged = [], second._merged

    def slow(held, *rest):
        tries.append(held["version"])
        if len(tries) == 1:
            first.merge(changes(spark, [(1, "first", None, "update", 1)]))
        return merged(held, *rest)

    second._merged = slow
    old = first.read(0)
    assert second.merge(changes(spark, [(1, None, 9.0, "update", 1), (3, "c", 3.0, "upsert", 1)])) == 2
    assert tries == [0, 1] and rows(first.read()) == {1: ("first", 9.0), 2: ("b", 2.0), 3: ("c", 3.0)}
    assert rows(old) == {1: ("a", 1.0), 2: ("b", 2.0)}
    second._commit = lambda manifest: False
    with pytest.raises(RuntimeError, match="came first"):
        second.merge(changes(spark, []), attempts=2)


BOXES = "w double, s double, e double, n double, start timestamp, end timestamp, id long"


def boxes(spark, count, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        w, s = rng.uniform(-180, 178), rng.uniform(-90, 88)
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(300))
        e = w + rng.random() * 2
        out.append((w, s, e - 360 if e > 180 else e, s + rng.random(), day if i % 9 else None, day + dt.timedelta(days=3), i))
    return out, spark.createDataFrame(out + [(None, 0.0, 1.0, 1.0, None, None, -1)], BOXES)


def test_index_against_a_scan(spark, tmp_path):
    path = str(tmp_path / "i")
    made, df = boxes(spark, 4000)
    crossing = [(179.5, 0.0, -179.0, 1.0, dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2), 9000)]
    df = df.unionByName(spark.createDataFrame(crossing, BOXES))
    B.build(df, path, leaf=50, fan=8)
    good = df.dropna(subset=["w", "s", "e", "n"]).cache()
    names = os.listdir(f"{path}/rows")
    assert sum(n.endswith(".parquet") for n in names) >= 60
    times = (dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1))
    for box in ((10, 10, 30, 25), (-180, -90, 180, 90), (175, -20, -170, 20), (0.5, 0.5, 0.5, 0.5), (100, -80, 101, -79)):
        for spatial in E.SPATIAL:
            for temporal, t in (("overlaps", None), ("overlaps", times), ("during", times), ("before", times), ("contains", times)):
                asked = [F.lit(float(v)) for v in box]
                want = good.filter(E.SPATIAL[spatial]([F.col(c) for c in "wsen"], asked))
                if t:
                    want = want.filter(E.TEMPORAL[temporal](F.col("start"), F.col("end"), F.lit(t[0]), F.lit(t[1])))
                if spatial == "intersects" or temporal == "overlaps":
                    assert sorted(r.id for r in B.search(spark, path, box, t, spatial, temporal).collect()) == sorted(r.id for r in want.collect()), (box, spatial, temporal)
    read = B.files_for(spark, path, (10, 10, 30, 25))
    assert 0 < len(read) < len(names) / 8
    windows = spark.createDataFrame([(i, *(float(v) for v in b)) for i, b in enumerate(((10, 10, 30, 25), (175, -20, -170, 20), (-50, -5, -48, 0)))], "q long, qw double, qs double, qe double, qn double")
    got = {(r.q, r.id) for r in B.search_many(spark, path, windows).collect()}
    want = {(q.q, r.id) for q in windows.collect() for r in good.filter(E.boxes_intersect([F.col(c) for c in "wsen"], [F.lit(q.qw), F.lit(q.qs), F.lit(q.qe), F.lit(q.qn)])).collect()}
    assert got == want and len(want) > 30


def test_index_of_few_boxes(spark, tmp_path):
    B.build(boxes(spark, 0)[1], str(tmp_path / "none"))
    assert B.search(spark, str(tmp_path / "none"), (0, 0, 1, 1)).count() == 0
    B.build(boxes(spark, 3)[1], str(tmp_path / "few"))
    assert B.search(spark, str(tmp_path / "few"), (-180, -90, 180, 90)).count() == 3


def test_hilbert_neighbours_touch(spark):
    df = spark.range(64).selectExpr("id div 8 AS x", "id % 8 AS y")
    cells = [(r.x, r.y) for r in B.with_hilbert(df, "x", "y", "d", 3).orderBy("d").collect()]
    assert len(set(cells)) == 64 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(cells, cells[1:]))
