"""Raster files: directories, windows by byte range, the tiled sink and its checks, ingest of a stream of files."""

import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.sources import raster as R
from cinderlake.sources import tiff


def strips(path, array, rows_per_strip, deflate, big=False, order="<", predictor=1, bands_apart=False, nodata=None):
    """A plain striped file, written without the library."""
    h, w, bands = array.shape
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    planes = [array[:, :, b : b + 1] for b in range(bands)] if bands_apart else [array]
    data = []
    for p in planes:
        for r in range(0, h, rows_per_strip):
            s = p[r : r + rows_per_strip]
            if predictor == 2:
                s = np.concatenate([s[:, :1], np.diff(s, axis=1)], axis=1)
            raw = s.astype(array.dtype.newbyteorder(order)).tobytes()
            data.append(zlib.compress(raw) if deflate else raw)
    word, start = ("Q", 16) if big else ("I", 8)
    offsets, at = [], start
    for d in data:
        offsets.append(at)
        at += len(d)
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [array.dtype.itemsize * 8] * bands), (259, "H", [8 if deflate else 1]), (262, "H", [1]), (273, word, offsets), (277, "H", [bands]), (278, "I", [rows_per_strip]),
            (279, word, [len(d) for d in data]), (284, "H", [2 if bands_apart else 1]), (317, "H", [predictor]), (339, "H", [kind] * bands), (33550, "d", [30.0, 30.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 500000.0, 4100000.0, 0.0])]
    if nodata is not None:
        tags.append((42113, "s", str(nodata).encode() + b"\0"))
    codes = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    entries, extra, room = b"", b"", 8 if big else 4
    after = at + (8 if big else 2) + len(tags) * (20 if big else 12) + room
    for tag, code, values in tags:
        raw = values if code == "s" else struct.pack(order + code * len(values), *values)
        entries += struct.pack(order + "HH" + word, tag, codes[code], len(values))
        entries += raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + word, after + len(extra))
        extra += raw if len(raw) > room else b""
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    with open(path, "wb") as f:
        f.write(head + b"".join(data) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + word, 0) + extra)


def whole(df, band=0, level=0):
    rows = df.filter((F.col("band") == band) & (F.col("level") == level)).collect()
    out = np.full((max(r.row_end for r in rows), max(r.col_end for r in rows)), np.nan)
    for r in rows:
        out[r.row_start : r.row_end, r.col_start : r.col_end] = np.frombuffer(r.data, "<f8").reshape(r.row_end - r.row_start, r.col_end - r.col_start)
    return out


@pytest.mark.parametrize(
    "dtype, bands, deflate, big, order, predictor, apart",
    [("f4", 1, False, False, "<", 1, False), ("f4", 3, True, False, "<", 1, False), ("u2", 2, True, True, ">", 2, True), ("i2", 1, True, False, ">", 2, False), ("u1", 3, False, True, "<", 1, True), ("f8", 2, True, True, "<", 1, False)],
)
def test_strips_come_back(spark, tmp_path, dtype, bands, deflate, big, order, predictor, apart):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 200, (37, 53, bands)).astype(dtype)
    strips(tmp_path / "a.tif", a, 8, deflate, big, order, predictor, apart)
    files = R.raster_files(spark, str(tmp_path))
    tiles = R.read_blocks(R.raster_blocks(files)).cache()
    for b in range(bands):
        assert (whole(tiles, b) == a[:, :, b]).all()
    told = R.describe(files, square=False, overviews=False, planes=False).first()
    assert told.ok and (told.width, told.height, told.bands, told.dtype) == (53, 37, bands, dtype) and (told.x_step, told.west, told.north) == (30.0, 500000.0, 4100000.0)


def test_a_window_reads_few_bytes(spark, tmp_path):
    a = np.random.default_rng(1).random((2000, 400, 1)).astype("f4")
    a[5, 5, 0] = -9999
    strips(tmp_path / "a.tif", a, 16, False, nodata=-9999)
    size = os.path.getsize(tmp_path / "a.tif")
    blocks = R.raster_blocks(R.raster_files(spark, str(tmp_path)))
    got = R.read_blocks(R.in_window(blocks, 100, 130, 10, 20))
    used = blocks.agg(F.max("bytes_read")).first()[0] + got.agg(F.sum("bytes_read")).first()[0]
    assert used < size / 10
    cells = R.pixels(got).filter("row >= 100 AND row < 130 AND col >= 10 AND col < 20").collect()
    assert {(r.row, r.col): r.value for r in cells} == {(i, j): float(a[i, j, 0]) for i in range(100, 130) for j in range(10, 20)}
    assert R.pixels(R.read_blocks(R.in_window(blocks, 0, 16, 0, 400))).count() == 16 * 400 - 1  # the one without data


def test_contents_are_not_listed(spark, tmp_path):
    strips(tmp_path / "a.tif", np.zeros((4, 4, 1), "f4"), 2, False)
    plan = R.raster_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def scene(spark, h, w, bands, seed=0, holes=0.1):
    rng = random.Random(seed)
    rows = [("s" + str(seed), b, r, c, float(rng.randrange(1000)) / 8) for b in range(bands) for r in range(h) for c in range(w) if rng.random() >= holes or (r, c) == (h - 1, w - 1)]
    return rows, spark.createDataFrame(rows, "scene string, band int, row long, col long, value double")


def halved(a):
    """Means of two by two cells with data, by hand."""
    h, w = a.shape
    out = np.full((-(-h // 2), -(-w // 2)), np.nan)
    for i in range(out.shape[0]):
        for j in range(out.shape[1]):
            four = a[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].ravel()
            four = four[~np.isnan(four)]
            if len(four):
                out[i, j] = np.float32(four.mean())
    return out


def test_tiled_sink_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    rows, df = scene(spark, 70, 45, 2, 1)
    more, other = scene(spark, 9, 100, 1, 2, 0.5)
    R.write_tiled(df.unionByName(other).repartition(5), path, 16, scale="10,10", tiepoint="3,4", epsg="32633")
    assert sorted(os.listdir(path)) == ["s1.tif", "s2.tif"]
    files = R.raster_files(spark, path)
    told = {os.path.basename(r.path): r for r in R.describe(files).collect()}
    assert all(r.ok and r.issues == [] for r in told.values()) and told["s1.tif"].levels == 4 and told["s2.tif"].levels == 4
    assert told["s1.tif"].epsg == 32633 and (told["s1.tif"].west, told["s1.tif"].north, told["s1.tif"].x_step) == (3.0, 4.0, 10.0)
    tiles = R.read_blocks(R.raster_blocks(files)).cache()
    for name, made, bands, shape in (("s1", rows, 2, (70, 45)), ("s2", more, 1, (9, 100))):
        mine = tiles.filter(F.col("path").endswith(f"{name}.tif"))
        for b in range(bands):
            want = np.full(shape, np.nan)
            for _, band, r, c, v in made:
                if band == b:
                    want[r, c] = v
            for level in range(4):
                np.testing.assert_array_equal(whole(mine, b, level), want)
                want = halved(want)
    with pytest.raises(Exception, match="exist"):
        R.write_tiled(other, path, 16)
    assert sorted(os.listdir(path)) == ["s1.tif", "s2.tif"]  # nothing staged is left
    R.write_tiled(other, path, 16, overwrite=True, nodata="-1")
    back = R.pixels(R.read_blocks(R.raster_blocks(R.raster_files(spark, path)))).filter("level = 0 AND path LIKE '%s2.tif'")
    assert {(r.band, r.row, r.col, r.value) for r in back.collect()} == {(b, r, c, v) for _, b, r, c, v in more}


def test_sink_edges(spark, tmp_path):
    with pytest.raises(ValueError, match="one of"):
        R.write_tiled(scene(spark, 2, 2, 1)[1], str(tmp_path / "x"), 100)
    df = spark.createDataFrame([(None, 0, 0, 0, 1.0), ("a", 0, None, 0, 1.0), ("a", 0, 3, 2, None), ("a", 0, 0, 0, 5.0)], "scene string, band int, row long, col long, value double")
    R.write_tiled(df, str(tmp_path / "y"), 16)
    tiles = R.read_blocks(R.raster_blocks(R.raster_files(spark, str(tmp_path / "y"))))
    assert whole(tiles).shape == (4, 3) and R.pixels(tiles).count() == 1


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    """A tile whose scene has no plan fails its task; the abort deletes what all tasks staged."""
    spark.dataSource.register(R.TiledTiffSink)
    path = str(tmp_path / "bad")
    rows = spark.createDataFrame([("a", 0, bytearray(b"x"), None)], R.ROWS)
    with pytest.raises(Exception, match="without its plan"):
        rows.write.format("tiled_tiff").mode("append").options(path=path, size="16").save()
    assert not [f for _, _, names in os.walk(path) for f in names] and not os.path.isdir(path) or os.listdir(path) == []


def test_check_rejects_broken_files(spark, tmp_path):
    folder = tmp_path / "f"
    R.write_tiled(scene(spark, 40, 40, 2, 7)[1], str(folder), 16)
    good = (folder / "s7.tif").read_bytes()
    (folder / "cut.tif").write_bytes(good[: len(good) * 2 // 3])
    (folder / "text.tif").write_bytes(b"no raster at all")
    (folder / "short.tif").write_bytes(b"II")
    raw = bytearray(good)
    levels, first = tiff.directories(lambda o, n: good[o : o + n], len(good))
    n = struct.unpack("<H", good[first : first + 2])[0]
    raw[first + 2 + 12 * n : first + 6 + 12 * n] = struct.pack("<I", first)  # the next directory is the first one
    (folder / "circle.tif").write_bytes(bytes(raw))
    strips(folder / "strips.tif", np.zeros((40, 40, 2), "f4"), 4, True)
    got = {os.path.basename(r.path): r for r in R.describe(R.raster_files(spark, str(folder))).collect()}
    assert got["s7.tif"].ok and len(levels) == 3
    said = {k: " ".join(v.issues) for k, v in got.items() if not v.ok}
    assert set(said) == {"cut.tif", "text.tif", "short.tif", "circle.tif", "strips.tif"}
    assert "outside the file" in said["cut.tif"] and "byte order" in said["text.tif"] and "circle" in said["circle.tif"] and "not tiled" in said["strips.tif"] and "interleaved" in said["strips.tif"]
    big = tiff.layout([tiff.Plan(1 << 17, 1 << 17, 1, [1 << 20] * (1 << 14))], 1024, None, [], [], None)[0]
    levels, _ = tiff.directories(lambda o, n: big[o : o + n], len(big))
    assert big[2:4] == b"\x2b\0" and levels[0].offsets[-1] > 1 << 33 and len(levels[0].counts) == 1 << 14


def test_ingest_of_a_stream(spark, tmp_path):
    """New files only; a file that fails its check is told and not read; a batch run twice leaves one copy."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    a = np.arange(60, dtype="f4").reshape(6, 10, 1)
    strips(inbox / "a.tif", a, 2, True)
    (inbox / "bad.tif").write_bytes(b"II*\0junk")
    checks = {"square": False, "overviews": False, "planes": False}
    double = lambda t: R.pixels(t).groupBy("path").agg(F.sum("value").alias("total"))
    for k in (1, 2):
        if k == 2:
            strips(inbox / "b.tif", a + 1, 3, False)
        files = R.raster_files(spark, str(inbox), stream=True)
        R.ingest(files, out, double, **checks).awaitTermination()
        told = {os.path.basename(r.path): r.ok for r in spark.read.parquet(f"{out}/files").collect()}
        assert told == {"a.tif": True, "bad.tif": False} | ({"b.tif": True} if k == 2 else {})
        totals = sorted(r.total for r in spark.read.parquet(f"{out}/tiles").collect())
        assert totals == [float(a.sum())] + ([float((a + 1).sum())] if k == 2 else [])
    batch = str(tmp_path / "batch")
    for _ in range(2):
        R.ingest(R.raster_files(spark, str(inbox)), batch, double, **checks)
    assert spark.read.parquet(f"{batch}/tiles").count() == 2 and spark.read.parquet(f"{batch}/files").count() == 3


def test_validation_suite(spark, tmp_path):
    from cinderlake.operators import validation

    folder = tmp_path / "v"
    rng = np.random.default_rng(4)
    calm = rng.integers(40, 60, (60, 50)).astype(float)
    wild = calm.copy()
    wild[:3] = 9000.0  # outliers by both rules
    rows = [("good", b, r, c, float(calm[r, c])) for b in range(2) for r in range(60) for c in range(50)]
    rows += [("wild", 0, r, c, float(wild[r, c])) for r in range(60) for c in range(50)]
    rows += [("thin", 0, r, c, float(calm[r, c])) for r in range(60) for c in range(50) if r % 4 == 0 or (r, c) == (59, 49)]
    rows += [("uneven", b, r, c, float(calm[r, c])) for b in range(2) for r in range(60) for c in range(50) if b == 0 or r > 8]
    R.write_tiled(spark.createDataFrame(rows, "scene string, band int, row long, col long, value double"), str(folder), 16, epsg="32633")
    (folder / "junk.tif").write_bytes(b"II*\0 not a raster")
    got = {os.path.basename(r.path)[:-4]: r for r in validation.validate(R.raster_files(spark, str(folder)), expected_epsg=32633).collect()}
    assert set(got) == {"good", "wild", "thin", "uneven", "junk"}
    assert got["good"].valid and got["good"].coverage == 100.0 and got["good"].n_anomalies <= 4
    kinds = {os.path.basename(r.path)[:-4]: r for r in validation.validate(R.raster_files(spark, str(folder)), expected_bands=2, expected_epsg=4326).collect()}
    assert {i.what for i in kinds["good"].issues} == {"coordinate system"} and {i.what for i in kinds["wild"].issues} == {"coordinate system", "bands"} and not kinds["wild"].valid
    assert got["wild"].quality < got["good"].quality or got["wild"].n_anomalies >= 2
    assert not got["thin"].valid and [(i.what, i.severity) for i in got["thin"].issues] == [("coverage", "high")] and abs(got["thin"].coverage - 100 * 751 / 3000) < 1e-4
    assert got["uneven"].valid and [(i.what, i.severity) for i in got["uneven"].issues] == [("band coverage", "medium")] and got["uneven"].coverage == 85.0
    junk = got["junk"]
    assert not junk.valid and junk.integrity and junk.quality == 0.0 and junk.score < 0.4 and "issues" in junk.summary


def test_tiles_are_sent_on_together():
    """Small tiles share a batch on their way to rows, not a batch a tile."""
    import pyarrow as pa

    class Captured:
        def mapInArrow(self, run, ddl):  # noqa: N802
            return run

    block = np.arange(256.0)
    block[3] = np.nan
    tile = {"path": "a", "level": 0, "band": 0, "col_start": 0, "col_end": 16, "data": block.tobytes()}
    given = pa.RecordBatch.from_pylist([tile | {"row_start": 16 * k, "row_end": 16 * k + 16} for k in range(40)])
    (made,) = R.pixels(Captured())(iter([given]))
    assert made.num_rows == 40 * 255
    assert made.slice(255 * 39, 4).to_pydict() == {"path": ["a"] * 4, "level": [0] * 4, "band": [0] * 4, "row": [624] * 4, "col": [0, 1, 2, 4], "value": [0.0, 1.0, 2.0, 4.0]}


def test_small_tiles_are_made_together(spark):
    """A call of the functions behind ``pack`` and ``halve`` makes all tiles of a square, not one; only tiles that have cells."""
    import pyarrow as pa

    class Captured:
        def select(self, *_):
            return self

        groupBy = select  # noqa: N815

        def applyInArrow(self, run, ddl):  # noqa: N802
            return run

    at = [(r, c) for r in range(256, 320) for c in range(40) if r // 16 != 18 and (r + c) % 5]
    key = [pa.scalar(x) for x in ("a", 0, 1, 0)]
    made = R.pack(Captured(), 16)(key, pa.table({"row": [r for r, _ in at], "col": [c for _, c in at], "value": pa.array([r * 100.0 + c for r, c in at], pa.float32())}))
    tiles = {(t["block_row"], t["block_col"]): np.frombuffer(t["data"], "<f4").reshape(16, 16) for t in made.to_pylist()}
    assert set(tiles) == {(r // 16, c // 16) for r, c in at} and made.num_rows == 9
    assert {(16 * a + r, 16 * b + c): float(v) for (a, b), t in tiles.items() for (r, c), v in np.ndenumerate(t) if v == v} == {(r, c): r * 100.0 + c for r, c in at}
    key = [pa.scalar(x) for x in ("a", 0, 0, 0, 0)]
    upper = R.halve(Captured(), 16)(key, made.select(["block_row", "block_col", "data"]))
    found = {(16 * t["block_row"] + r, 16 * t["block_col"] + c): v for t in upper.to_pylist() for (r, c), v in np.ndenumerate(np.frombuffer(t["data"], "<f4").reshape(16, 16)) if v == v}
    four = {}
    for r, c in at:
        four.setdefault((r // 2, c // 2), []).append(r * 100.0 + c)
    assert upper.num_rows == 4 and upper.column("level").to_pylist() == [1] * 4 and found == {k: np.float32(np.mean(v)) for k, v in four.items()}


def test_coverage_of_all_bands_is_counted_by_bits(spark, tmp_path):
    """Against brute force over more than 64 columns; cells are not grouped by row and column."""
    from cinderlake.operators import validation

    rng = np.random.default_rng(8)
    has = rng.random((3, 20, 150)) < 0.8
    has[:, -1, -1] = True
    rows = [("s", b, r, c, 1.0 + r) for b in range(3) for r in range(20) for c in range(150) if has[b, r, c]] + [("t", 0, r, c, 1.0) for r in range(20) for c in range(150) if has[0, r, c]]
    R.write_tiled(spark.createDataFrame(rows, "scene string, band int, row long, col long, value double"), str(tmp_path / "f"), 16)
    made = validation.validate(R.raster_files(spark, str(tmp_path / "f")))
    got = {os.path.basename(r.path)[:-4]: r.coverage for r in made.collect()}
    assert got == {"s": pytest.approx(100 * has.all(axis=0).sum() / 3000, abs=1e-6), "t": pytest.approx(100 * has[0].sum() / 3000, abs=1e-6)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate(keys=[path#" in plan and not re.search(r"Aggregate\(keys=\[path#\d+L?, row#\d+L?, col#\d+L?\]", plan)
