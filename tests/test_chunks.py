"""The chunked array store: slices, appended steps, commits by metadata, the open layout."""

import datetime as dt
import json
import os
import random
import zlib

import numpy as np
import pytest

from cinderlake.sources import chunks as C

DAY = 86400
SCHEMA = "variable string, time timestamp, row int, col int, value double, step string"


def cells(days, h=9, w=14, variables=("a", "b"), seed=0):
    rng = random.Random(seed)
    return [(v, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), r, c, float(rng.randrange(100))) for v in variables for d in days for r in range(h) for c in range(w) if rng.random() < 0.8 or (r, c) == (h - 1, w - 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)


def got(df):
    return sorted((r.time, r.row, r.col, r.value) for r in df.collect())


def listing(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if not f.startswith(".z") and "/time" not in d}


@pytest.mark.parametrize("chunks", [(1, 4, 5), (3, 16, 2), (2, 512, 512)])
def test_slices_equal_a_filter(spark, tmp_path, chunks):
    path, rows = str(tmp_path / "s"), cells(range(7))
    C.write_store(frame(spark, rows), path, chunks)
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    for variable, times, r, c in (("a", None, None, None), ("b", (start + DAY, start + 4 * DAY), (2, 7), (0, 5)), ("a", (start + 1, start + 2), None, None), ("a", None, (100, 200), None)):
        want = [x[1:] for x in rows if x[0] == variable and (r is None or r[0] <= x[2] < r[1]) and (c is None or c[0] <= x[3] < c[1]) and (times is None or times[0] <= x[1].replace(tzinfo=dt.timezone.utc).timestamp() < times[1])]
        assert got(C.read_store(spark, path, variable, times, r, c)) == sorted(want)


def test_only_chunks_of_the_slice_are_opened(spark, tmp_path):
    path, rows = str(tmp_path / "s"), cells(range(4))
    C.write_store(frame(spark, rows), path, (1, 4, 5))
    for name in ("a/0.0.0", "a/3.2.2", "b/1.1.1"):
        with open(f"{path}/{name}", "wb") as f:
            f.write(b"no chunk")
    start = int(dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc).timestamp())
    assert len(got(C.read_store(spark, path, "a", (start, start + 2 * DAY)))) == sum(r[0] == "a" and r[1].day in (2, 3) for r in rows)
    with pytest.raises(Exception, match="header"):
        C.read_store(spark, path, "a").collect()


def test_append_touches_new_chunks_only(spark, tmp_path):
    path, rows, more = str(tmp_path / "s"), cells(range(3)), cells([5, 9], seed=1)
    C.write_store(frame(spark, rows), path, (1, 4, 5))
    before = listing(path)
    C.append(frame(spark, more), path)
    after = listing(path)
    assert {k: after[k] for k in before} == before and len(after) > len(before)
    assert {int(os.path.basename(k).split(".")[0]) for k in set(after) - set(before)} == {3, 4}
    assert got(C.read_store(spark, path, "b")) == sorted(r[1:] for r in rows + more if r[0] == "b")


def test_what_is_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    path, rows, more = str(tmp_path / "s"), cells(range(2)), cells([4], seed=1)
    C.write_store(frame(spark, rows), path, (1, 4, 5))
    commit = C._commit

    def fails(store, before):
        raise RuntimeError("lost")

    monkeypatch.setattr(C, "_commit", fails)
    with pytest.raises(RuntimeError, match="lost"):
        C.append(frame(spark, more), path)
    assert os.path.exists(f"{path}/a/2.0.0") and got(C.read_store(spark, path, "a")) == sorted(r[1:] for r in rows if r[0] == "a")
    monkeypatch.setattr(C, "_commit", lambda store, before: commit(store, b"another state"))
    with pytest.raises(RuntimeError, match="another writer"):
        C.append(frame(spark, more), path)
    monkeypatch.setattr(C, "_commit", commit)
    C.append(frame(spark, more), path)
    assert got(C.read_store(spark, path, "a")) == sorted(r[1:] for r in rows + more if r[0] == "a")


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        C.open_store(path)
    C.write_store(frame(spark, cells(range(3))), path, (2, 4, 5))
    with pytest.raises(FileExistsError):
        C.write_store(frame(spark, cells(range(3))), path)
    with pytest.raises(ValueError, match="not full"):
        C.append(frame(spark, cells([7])), path)
    other = str(tmp_path / "t")
    C.write_store(frame(spark, cells(range(3))), other, (1, 4, 5))
    for bad, said in ((cells([2]), "not after"), (cells([8], h=10), "outside"), (cells([8], variables=("z",)), "outside")):
        with pytest.raises(ValueError, match=said):
            C.append(frame(spark, bad), other)


def test_layout_read_without_the_library(spark, tmp_path):
    path, rows = str(tmp_path / "s"), [*cells(range(2), 3, 4, ("a",)), ("a", None, 0, 0, 1.0), (None, dt.datetime(2024, 1, 1), 0, 0, 1.0), ("a", dt.datetime(2024, 1, 1), -1, 0, 1.0), ("a", dt.datetime(2024, 1, 1), None, 0, 1.0)]
    C.write_store(frame(spark, rows), path, (1, 2, 3))
    with open(f"{path}/a/.zarray") as f:
        meta = json.load(f)
    assert meta["shape"] == [2, 3, 4] and meta["chunks"] == [1, 2, 3] and meta["zarr_format"] == 2
    whole = np.full((2, 4, 6), np.nan)
    for t in range(2):
        for y in range(2):
            for x in range(2):
                if os.path.exists(f"{path}/a/{t}.{y}.{x}"):
                    with open(f"{path}/a/{t}.{y}.{x}", "rb") as f:
                        whole[t, 2 * y : 2 * y + 2, 3 * x : 3 * x + 3] = np.frombuffer(zlib.decompress(f.read()), meta["dtype"]).reshape(1, 2, 3)[0]
    want = {(r[1].day - 1, r[2], r[3]): r[4] for r in rows[:-4]}
    assert {tuple(map(int, p)): whole[tuple(p)] for p in np.argwhere(~np.isnan(whole))} == want
    empty = str(tmp_path / "e")
    C.write_store(frame(spark, []), empty)
    assert C.open_store(empty).times == []
