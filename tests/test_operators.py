"""Edge cases of operators that the oracle queries do not reach."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cinderlake.functions import expr as E
from cinderlake.functions.normal import normal_cdf
from cinderlake.functions.storage import Kept, Rounds
from cinderlake.llm import spelling
from cinderlake.operators import assessment, catalog, statistics
from cinderlake.operators import focal as N
from cinderlake.operators import fusion as M
from cinderlake.operators import temporal as T
from cinderlake.plans.fusion_plans import layers
from cinderlake.sources import features as V
from cinderlake.sources import tiles


def test_boxes_over_the_antimeridian(spark):
    boxes = spark.createDataFrame([(170.0, -10.0, -170.0, 10.0), (-20.0, -10.0, 20.0, 10.0)], "w double, s double, e double, n double")
    mine = [F.col(c) for c in "wsen"]
    hit = lambda *q: [r[0] for r in boxes.select(E.boxes_intersect(mine, [F.lit(float(x)) for x in q])).collect()]
    assert hit(175, 0, 179, 1) == [True, False]
    assert hit(-179, 0, -175, 1) == [True, False]
    assert hit(0, 0, 1, 1) == [False, True]
    assert hit(160, 0, -160, 1) == [True, False]
    assert [r[0] for r in boxes.select(E.box_width(F.col("w"), F.col("e"))).collect()] == [20.0, 40.0]


def test_clean_gives_null_for_each_kind_of_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (-9999.0, 1.0), (2.0, 0.0), (None, 1.0)], "v double, q double")
    assert [r[0] for r in df.select(E.clean("v", -9999.0, quality=F.col("q"))).collect()] == [1.0, None, None, None, None, None]


def test_bracket_and_nearest_against_brute_force(spark):
    rng = random.Random(2)
    samples = sorted({(k, rng.randrange(5000)) for k in (0, 1) for _ in range(40)})
    targets = [(k, t) for k in (0, 1, 2) for t in range(0, 5000, 97)]
    s = spark.createDataFrame([(k, t, float(t)) for k, t in samples], "k int, t long, value double")
    g = spark.createDataFrame(targets, "k int, t long")
    got = {(r.k, r.target): (r.before and r.before.t, r.after and r.after.t) for r in T.bracket(g, s, "k", 300).collect()}
    for k, t in targets:
        mine = [x for j, x in samples if j == k]
        assert got[k, t] == (max((x for x in mine if x <= t), default=None), min((x for x in mine if x >= t), default=None))
    near = {(r.k, r.target): r.sample for r in T.nearest_within(g, s, "k", 60).collect()}
    want = {(k, t): min(m, key=lambda x: (abs(x - t), x)) for k, t in targets if (m := [x for j, x in samples if j == k and abs(x - t) <= 60])}
    assert near == want


def test_components_of_a_spiral_and_dots(spark):
    rng, cells = random.Random(3), {(0, c) for c in range(30)} | {(r, 29) for r in range(20)} | {(19, c) for c in range(5, 30)} | {(40, 1), (40, 3), (42, 2)}
    cells |= {(60 + rng.randrange(20), rng.randrange(20)) for _ in range(200)}
    df = spark.createDataFrame(sorted(cells), "row long, col long")
    got = {(r.row, r.col): r.label for r in N.components(df, Rounds(spark, "test")).collect()}
    left, want = set(cells), {}
    while left:
        todo, part = [min(left)], []
        left.discard(todo[0])
        while todo:
            r, c = todo.pop()
            part.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    todo.append(n)
        for p in part:
            want[p] = min(r * (1 << 31) + c for r, c in part)
    assert got == want


def test_focal_by_tiles_is_focal_by_shifts(spark):
    rng = np.random.default_rng(1)
    rows = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 40, 900), rng.integers(0, 40, 900), rng.normal(size=900), strict=True)]
    df = spark.createDataFrame(list({(r, c): (r, c, v) for r, c, v in rows}.values()), "row long, col long, value double")

    def mean(block):
        k = 5
        view = np.lib.stride_tricks.sliding_window_view(block, (k, k))
        return np.nanmean(view, axis=(2, 3)) if np.isfinite(view).any() else view[..., 0, 0]

    a = {(r.row, r.col): r.value for r in N.focal_tiles(df, 2, 8, mean).collect()}
    b = {(r.row, r.col): r.m for r in N.focal(df, 2, [F.avg("value").alias("m")]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.mark.parametrize("strategy", ["majority", "weighted_vote", "mean", "weighted_mean", "median", "highest_confidence", "priority", "minimum", "maximum", "range_check"])
def test_resolve_skips_invalid_layers(spark, strategy):
    df = spark.createDataFrame([(1, "a", 5.0, 1.0, 0.9, 1), (1, "b", 99.0, 0.0, 0.9, 2), (2, "a", 3.0, 0.0, 0.5, 1)], "cell int, source string, data double, quality double, confidence double, rank int")
    got = M.resolve(df, strategy, "cell").collect()
    assert [(r.cell, r.value) for r in got] == [(1, 5.0)]


def test_geojson_and_tiles(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"é"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[9,9],[10,9],[10,10],[9,9]]]]}}]}')
    f = V.read_geojson(spark, str(tmp_path / "f.json"))
    inside = V.point_in_ring(F.lit(1.0), F.lit(1.0), F.col("ring"))
    assert [(r[0], r[1].east, r[2]) for r in f.select("geometry_type", V.bounds(F.col("ring")), inside).collect()] == [("Polygon", 4.0, True), ("MultiPolygon", 10.0, False)]
    grid = spark.createDataFrame([(0, 0, 1.5), (5, 9, 2.5)], "row long, col long, value double")
    assert sorted(tuple(r) for r in tiles.unpack_tiles(tiles.pack_tiles(grid, 4)).collect()) == [(0, 0, 1.5), (5, 9, 2.5)]


def test_normal_cdf(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.959964,), (-1.959964,)], "z double").select(normal_cdf("z")).collect()]
    assert np.allclose(got, [0.5, 0.975, 0.025], atol=1e-6)


def test_nearest_reaches_every_cell(spark):
    points = [(0, 0, 5.0), (1, 1, 6.0), (0, 4, 7.0)]
    cells = [(r, c, float(r + c)) for r in range(0, 70, 3) for c in range(0, 70, 2)]
    schema = "row long, col long, value double"
    got = N.nearest(spark.createDataFrame(cells, schema), spark.createDataFrame(points, schema), Rounds(spark, "test-nearest")).collect()
    want = {(r, c): min(((r - y) ** 2 + (c - x) ** 2, y, x, v) for y, x, v in points) for r, c, _ in cells}
    assert len(got) == len(cells) and {(g["row"], g["col"]): tuple(g["at"]) for g in got} == want
    none = N.nearest(spark.createDataFrame(cells[:3], schema), spark.createDataFrame([], schema), Rounds(spark, "test-none"))
    assert [g["at"] for g in none.collect()] == [None] * 3


def test_contextual_fire_keeps_inner_cells_and_cells_without_background(spark):
    rng = random.Random(4)
    t = {(r, c): 350.0 + c / 7 if 8 <= r < 15 and 60 <= c < 67 else rng.uniform(285, 312) for r in range(24) for c in range(50, 80)}
    t |= {(200, 200): 340.0, (200, 201): 300.0, (300, 300): float("nan")}
    got = N.contextual_fire(spark.createDataFrame([(r, c, v) for (r, c), v in t.items()], "row long, col long, value double")).collect()
    assert len(got) == len(t) - 1
    for g in got:
        r, c, v = g["row"], g["col"], g["value"]
        back = [x for (y, z), x in t.items() if abs(y - r) <= 10 and abs(z - c) <= 10 and (y, z) != (r, c) and x < 310]
        mu, sd = (np.mean(back), np.std(back)) if len(back) >= 3 else (0, 0)
        fire = v > 320 and v - mu > 10 and v - mu > 3 * sd
        assert g["fire"] == fire and abs(g["mu"] - mu) < 1e-9 and abs(g["sd"] - sd) < 1e-9
        assert abs(g["confidence"] - ((np.clip((v - 330) / 30, 0, 1) + np.clip((v - mu) / 50, 0, 1)) / 2 if fire else 0)) < 1e-9
    assert sum(g["fire"] for g in got) == 50


def _grid(spark, cells):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells.items()], "row long, col long, value double")


def test_gradient_needs_adjacent_cells(spark):
    cells = {(0, 0): 1, (0, 1): 4, (0, 3): 9, (0, 4): 11, (2, 0): 5, (7, 7): 3}
    g = _grid(spark, cells)
    got = {(r.row, r.col): r.d for r in g.select("row", "col", N.gradient(g, "col").alias("d")).collect()}
    assert got == {(0, 0): 3, (0, 1): 3, (0, 3): 2, (0, 4): 2, (2, 0): None, (7, 7): None}


def test_upsample_keeps_holes(spark):
    cells = {(r, c): r * 10 + c for r in range(4) for c in range(4) if (r, c) != (2, 1)}
    fine = {(r.row, r.col): r.value for r in N.upsample(_grid(spark, cells), 2).collect()}
    assert fine[3, 5] == 17.5 and fine[2, 2] == 11 and fine[4, 3] is None and max(fine) == (6, 6) and (4, 2) not in {k for k, v in fine.items() if v is not None}
    near = {(r.row, r.col): r.value for r in N.upsample(_grid(spark, cells), 2, order=0).collect()}
    assert near[3, 5] == cells[2, 3] and (4, 2) not in near and near[0, 0] == 0 and near[6, 6] == 33


def test_nearest_over_any_distance(spark):
    rng = random.Random(4)
    cells = {(rng.randrange(300), rng.randrange(40)): rng.random() for _ in range(400)}
    points = dict(list(cells.items())[:3])
    got = N.nearest(_grid(spark, cells), _grid(spark, points), Rounds(spark, "test-nearest"), first=4).collect()
    assert len(got) == len(cells)
    for r in got:
        assert (r["at"].d2, r["at"].cr, r["at"].cc) == min(((r.row - a) ** 2 + (r.col - b) ** 2, a, b) for a, b in points)
    none = N.nearest(_grid(spark, points), _grid(spark, points).limit(0), Rounds(spark, "test-nearest")).collect()
    assert len(none) == 3 and all(r["at"] is None for r in none)


def test_boxes_within_boxes_over_the_antimeridian(spark):
    boxes = [(-180.0, 180.0), (170.0, -170.0), (175.0, -175.0), (-179.0, -171.0), (171.0, 179.0), (0.0, 10.0), (160.0, 175.0)]
    rows = [(i, j, *a, *b) for i, a in enumerate(boxes) for j, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "i int, j int, aw double, ae double, bw double, be double")
    a, b = ([F.col(f"{x}w"), F.lit(0.0), F.col(f"{x}e"), F.lit(1.0)] for x in "ab")
    got = {(r.i, r.j): r.inside for r in df.select("i", "j", E.box_contains(a, b).alias("inside")).collect()}

    def plain(x, y):
        if y[0] > y[1]:
            return False
        return x[0] <= y[0] and y[1] <= x[1] if x[0] <= x[1] else y[0] >= x[0] or y[1] <= x[1]

    assert got == {(i, j): plain(x, y) for i, x in enumerate(boxes) for j, y in enumerate(boxes)}


def test_overlap_join_over_the_antimeridian(spark):
    rng = random.Random(2)

    def box():
        w, s = rng.uniform(-180, 180), rng.uniform(-80, 70)
        e = w + rng.uniform(0, 40)
        return w, s, e - 360 if e > 180 else e, s + rng.uniform(0, 10)

    left, right = [(i, *box()) for i in range(60)], [(i, *box()) for i in range(60)]
    spans = lambda b: [(b[0], b[2])] if b[0] <= b[2] else [(b[0], 180.0), (-180.0, b[2])]
    want = {(i, j) for i, *a in left for j, *b in right if a[1] <= b[3] and a[3] >= b[1] and any(x[0] <= y[1] and x[1] >= y[0] for x in spans(a) for y in spans(b))}
    size, names = 8.0, ("w", "s", "e", "n")
    frame = lambda rows, p: spark.createDataFrame(rows, f"{p}id int, " + ", ".join(f"{p}{n} double" for n in names)).withColumn("c", F.explode(catalog.box_cells(*(F.col(f"{p}{n}") for n in names), size)))
    a, b = ([F.col(f"{p}{n}") for n in names] for p in "ab")
    got = frame(left, "a").join(frame(right, "b"), "c").filter(E.boxes_intersect(a, b)).filter(catalog.first_shared_cell(a, b, size, F.col("c"))).select("aid", "bid").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_quantiles_against_sorting(spark):
    rng = random.Random(6)
    rows = [("a", rng.choice([rng.gauss(0, 1), 3.0])) for _ in range(501)] + [("b", 7.0)] * 9 + [("c", None)] + [("d", x) for x in (1.0, 1e9, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = (0.0, 0.02, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in statistics.quantiles(df, "v", probs, "g", bins=16).collect()}
    for g in "abd":
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], probs), rtol=0, atol=1e-12 if g != "d" else 1e-3)
    assert got["c"] == [None] * 6
    whole = statistics.quantiles(df, "v", (0.5,)).first().q
    assert np.allclose(whole, [np.quantile([v for _, v in rows if v is not None], 0.5)])


def test_levels_of_tasks(spark):
    tasks = spark.createDataFrame([(i,) for i in range(7)], "task long")
    needs = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 99), (5, 6), (6, 5), (4, 2), (4, 5)], "task long, needs long")
    got = {r.task: r.level for r in assessment.levels(tasks, needs, Rounds(spark, "test-levels")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0}  # 5 and 6 need each other, 4 needs 5


def test_optical_fallback_by_cases(spark):
    rows = [
        (1, "sentinel2", True, 10.0, 0.9, 5.0), (1, "landsat8", True, 0.0, 1.0, 1.0), (2, "sentinel2", True, 55.0, None, None), (3, "sentinel2", True, 90.0, 0.9, 5.0), (3, "landsat8", True, 0.0, 0.9, 5.0),
        (4, "sentinel2", False, 0.0, 0.9, 5.0), (4, "landsat9", True, 20.0, 0.31, 168.0), (5, "sentinel2", True, 0.0, 0.2, 5.0), (5, "modis_aqua", True, 0.0, 0.9, 5.0), (6, "sentinel2", True, 0.0, 0.9, 169.0), (7, "unknown", True, 0.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "event int, source string, available boolean, cloud double, quality double, age_hours double")
    got = {r.event: (r.source, r.handling) for r in assessment.optical_fallback(df, "event").collect()}
    sar = (None, "switch_to_sar")
    assert got == {1: ("sentinel2", "proceed"), 2: ("sentinel2", "temporal_composite"), 3: sar, 4: ("landsat9", "proceed"), 5: sar, 6: sar, 7: sar}


def test_sensor_pairs_by_cases(spark):
    cells = range(100)
    data = {"a": ("optical", lambda c: c / 100), "b": ("optical", lambda c: c / 100 + 0.01), "c": ("sar", lambda c: 1 - c / 100), "d": ("lidar", lambda c: 0.5), "e": ("sar", lambda c: c / 100 if c < 20 else None)}
    rows = [(s, k, c, f(c), 1.0) for s, (k, f) in data.items() for c in cells]
    pairs = {(r.sensor_a, r.sensor_b): r for r in assessment.compare_sensors(spark.createDataFrame(rows, "sensor string, kind string, cell int, data double, confidence double"), 100).collect()}
    assert pairs["a", "b"].outcome == "consistent" and pairs["a", "b"].pair_type == "redundant"
    assert pairs["a", "c"].outcome == "conflict" and abs(pairs["a", "c"]["corr"] + 1) < 1e-9
    assert pairs["a", "d"].pair_type == "complementary" and pairs["a", "d"]["corr"] is None  # by their rule for another observable
    assert pairs["c", "d"].pair_type == "independent"
    assert pairs["a", "e"].outcome == "insufficient_data" and pairs["a", "e"].agreement == 0
    burn = {(r.sensor_a, r.sensor_b): r for r in assessment.compare_sensors(spark.createDataFrame(rows, "sensor string, kind string, cell int, data double, confidence double"), 100, "vegetation_damage").collect()}
    assert burn["a", "d"].pair_type == "complementary" and burn["a", "d"].agreement == 0.41 and burn["a", "b"].outcome == "consistent" and burn["a", "b"].pair_type == "redundant"


def test_optical_quality_without_valid_pixels(spark):
    rows = [(1, 0.1, 0.2, 0.3, 0.4, False), (2, 0.1, 0.2, 0.3, 0.4, True)]
    df = spark.createDataFrame(rows, "scene int, b0 double, b1 double, b2 double, b3 double, ok boolean")
    got = {r.scene: r for r in assessment.optical_quality(df, "scene", ["b0", "b1", "b2", "b3"], "b1", "b3", "b3", F.col("ok")).collect()}
    assert got[1].score == 0 and not got[1].usable and got[2].clear <= 100


def krueger(lon, lat, zone):
    """Transverse Mercator by Krueger's series in the third flattening, to its third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500000 + 0.9996 * big * x, 0.9996 * big * y + (10000000 if lat < 0 else 0)


def test_utm_against_another_series(spark):
    rng = random.Random(3)
    rows = [(9.0, 45.0, 32), (3.0, 0.0, 31), (2.2945, 48.8582, 31)]
    for _ in range(60):
        zone = rng.randrange(1, 61)
        rows.append((zone * 6 - 183 + rng.uniform(-3, 3), rng.uniform(-80, 83), zone))
    x, y = assessment.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    got = spark.createDataFrame(rows, "lon double, lat double, zone int").select("lon", "lat", "zone", x.alias("x"), y.alias("y")).collect()
    for r in got:
        want = krueger(r.lon, r.lat, r.zone)
        assert abs(r.x - want[0]) < 0.01 and abs(r.y - want[1]) < 0.01, r


def test_gaps_across_buckets(spark):
    rng = random.Random(12)
    rows = sorted({(k, rng.randrange(1000, 60_000)) for k in ("a", "b") for _ in range(40)}) + [("c", 5000)]
    df = spark.createDataFrame(rows, "k string, t long")
    want = set()
    for k in "abc":
        times = [0, *sorted(t for x, t in rows if x == k), 70_000]
        want |= {(k, x, y) for x, y in zip(times, times[1:], strict=False) if y - x > 900}
    for bucket in (100, 7000, 10**9):
        got = T.gaps(df, "k", 900, 0, 70_000, bucket).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    twice = spark.createDataFrame([("a", 5), ("a", 5), ("a", 9)], "k string, t long")
    assert sorted((r.t, r.prior) for r in T.with_prior(twice, "k", 4).collect() if r.prior is not None) == [(5, 5), (9, 5)]


def test_dem_fallback_by_cases(spark):
    rows = [
        (1, "copernicus_30", True, 3.0, None), (2, "copernicus_30", True, 9.0, None), (3, "copernicus_30", True, 20.0, None), (3, "alos_30", True, 1.0, None), (4, "copernicus_30", True, 20.0, None), (4, "alos_30", True, 30.0, None),
        (5, "srtm_30", True, 0.0, None), (6, "copernicus_30", True, 60.0, None), (7, "copernicus_30", True, 60.0, 90.0), (8, "copernicus_90", True, 0.0, None), (9, "copernicus_30", False, 0.0, None), (10, "alos_30", True, None, None),
    ]
    df = spark.createDataFrame(rows, "area int, source string, available boolean, voids double, coverage double")
    got = {r.area: (r.source, r.second, r.filling, r.resolution, r.accuracy, r.voids) for r in assessment.dem_fallback(df, "area").collect()}
    none = (None, None, "none", 0.0, 999.0, 100.0)
    assert got == {
        1: ("copernicus_30", None, "none", 30.0, 4.0, 3.0), 2: ("copernicus_30", None, "interpolation", 30.0, 4.0, 1.0), 3: ("copernicus_30", "alos_30", "blend", 30.0, 5.0, 2.0), 4: ("copernicus_30", None, "morphological", 30.0, 4.0, 10.0),
        5: none, 6: none, 7: ("copernicus_30", None, "morphological", 30.0, 4.0, 30.0), 8: none, 9: none, 10: ("alos_30", None, "none", 30.0, 5.0, 0.0),
    }


def test_scene_quality_of_flat_and_of_poor_scenes(spark):
    rng = random.Random(1)
    cells = [(0, r, c, 50.0) for r in range(30) for c in range(30)] + [(1, r, c, rng.gauss(100, 1) + (90 if r < 10 else 0)) for r in range(30) for c in range(30) if rng.random() < 0.9]
    facts = spark.createDataFrame([(0, None, "EPSG:4326", False), (1, 90, None, True)], "scene int, age_days int, crs string, at_origin boolean")
    q = assessment.scene_quality(spark.createDataFrame(cells, "scene int, r int, c int, value double"), "scene", facts, 30, F.col("value") > 150)
    flat, poor = q.orderBy("scene").collect()
    assert (flat.completeness, flat.spatial, flat.temporal, flat.radiometric, flat.geometric, flat.atmospheric) == (1.0, 1.0, 0.7, 1.0, 1.0, 1.0) and flat.usable
    assert poor.spatial == 0.8 and poor.temporal == 0.5 and poor.geometric == 0.35 and poor.atmospheric < 0.75 and not poor.usable


def test_nearest_ends_on_cells_without_a_place(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (None, 3, 2.0), (5, None, 3.0), (40, 7, 4.0)], "row long, col long, value double")
    points = spark.createDataFrame([(1, 1, 9.0), (None, 0, 8.0)], "row long, col long, value double")
    got = {r.value: r["at"] for r in N.nearest(cells, points, Rounds(spark, "test-null")).collect()}
    assert got[2.0] is None and got[3.0] is None and got[1.0].d2 == 2 and got[4.0].d2 == 39 * 39 + 36


@pytest.mark.parametrize("bins", [16, 20_000])
def test_quantiles_of_crowded_values(spark, bins):
    """One huge value puts nothing into one range; ties, infinities and small groups stay exact."""
    rng = random.Random(8)
    rows = [("tail", rng.random()) for _ in range(3000)] + [("tail", 1e12), ("few", 3.0), ("one", -2.0), ("none", None), ("ties", None)] + [("few", 1.0)] + [("ties", float(rng.randrange(3))) for _ in range(500)] + [("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    probs = (0.0, 0.01, 0.02, 0.5, 0.501, 0.98, 1.0)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.q for r in statistics.quantiles(df, "v", probs, "g", bins=bins).collect()}
    for g in {k for k, _ in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if not v:
            assert got[g] == [None] * len(probs)
            continue
        for p, q in zip(probs, got[g], strict=True):
            at = (len(v) - 1) * p
            lo, hi = int(at), min(int(at) + (at > int(at)), len(v) - 1)
            want = v[lo] if lo == hi else v[lo] * (hi - at) + v[hi] * (at - lo)
            assert q == want or abs(q - want) < 1e-9, (g, p)


def test_crowded_values_are_dealt_evenly(spark):
    """Of a heavy-tailed group no slot holds over a hundredth of the values."""
    df = spark.range(40_000).selectExpr("CASE WHEN id = 7 THEN 1e12 ELSE rand(3) END AS v")
    sketch = df.agg(F.percentile_approx("v", [0.5 - 2 / 20_000, 0.5 + 2 / 20_000], 20_000).alias("e")).first().e
    assert df.filter(F.col("v").between(*sketch)).count() < 400


def test_running_sum_and_next_value(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9), rng.random() if rng.random() < 0.2 else None) for i in rng.sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "k long, n long, r double").repartition(7)
    ordered, total, want = sorted(rows), 0, {}
    for k, n, _ in ordered:
        total += n
        want[k] = total
    assert {r.k: r.s for r in statistics.running_sum(df, "k", "n", "s").collect()} == want
    later, following = None, {}
    for k, _, r in reversed(ordered):
        later = r if r is not None else later
        following[k] = later
    assert {r.k: r.x for r in statistics.next_value(df, ["k"], "r", "x").collect()} == following


def test_fill_nearest_against_brute_force(spark):
    rng = random.Random(12)
    cells = {(rng.randrange(90), rng.randrange(20)): rng.choice([None, float("nan"), rng.random()]) for _ in range(300)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()] + [(None, 3, None)], "row long, col long, value double")
    got = {(r.row, r.col): (r.value, r.confidence) for r in N.fill_nearest(df, Kept(spark, "test-fill"), 6.0).collect()}
    known = {k: v for k, v in cells.items() if v is not None and v == v}
    assert got.pop((None, 3)) == (None, 0.0) and set(got) == set(cells)
    for k, (value, sure) in got.items():
        if k in known:
            assert (value, sure) == (known[k], 1.0)
        else:
            d2, r, c = min(((k[0] - r) ** 2 + (k[1] - c) ** 2, r, c) for r, c in known)
            assert value == known[r, c] and abs(sure - min(max(1 - math.sqrt(d2) / 6, 0.1), 0.8)) < 1e-12
    none = N.fill_nearest(df.filter("value IS NULL"), Kept(spark, "test-fill")).collect()
    assert all(r.value is None and r.confidence == 0.0 for r in none)


@pytest.mark.parametrize("name", ["conflict_detect", "consensus_build", "sar_fallback", "impact_summary"])
def test_thresholds_do_not_depend_on_the_order_of_rows(spark, tmp_path, name):
    """The same rows in many orders and file layouts give the same bits, so what meets a threshold exactly does so always."""
    rng = np.random.default_rng(3)
    kinds = ["click", "error", "purchase", "signup", "view"]
    values = [np.append(c, round(10 - c.sum(), 2)) for c in rng.integers(1, 120, (60, 17)) / 100]
    events = pd.DataFrame([(1000 * u + i, pd.Timestamp("2024-01-02"), u, kinds[i % 5], v, '{"k": 1}') for u, vs in enumerate(values) for i, v in enumerate(vs)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    d = np.concatenate([[x, 0.1 - x] for x in rng.integers(0, 11, 300) / 100]).round(2)
    lines = pd.DataFrame([(s, float(1 + i % 50), x) for s in range(20) for i, x in enumerate(d)], columns=["l_suppkey", "l_quantity", "l_discount"])
    seen = set()
    for k in range(4):
        path = tmp_path / f"{name}{k}"
        path.mkdir()
        for t, n in ((events, "events"), (lines, "lineitem")):
            spark.createDataFrame(t.sample(frac=1, random_state=k)).repartition(1 + k).write.parquet(f"{path}/{n}.parquet")
        # the first two are held to the bits before they are rounded
        raw = {"conflict_detect": lambda p: M.detect_conflict(layers(spark, p), "user_id", "day"), "consensus_build": lambda p: layers(spark, p)}
        got = raw.get(name, lambda p: entry.queries()[name](spark, p))(str(path)).toPandas()
        seen.add(repr(sorted(got[sorted(got.columns)].itertuples(index=False, name=None))))
        if name == "sar_fallback":
            assert set(got.orbit) == {"ascending"}  # 400 times .05 is not over 20
        if name == "impact_summary":
            assert set(got.peak) == {1}  # an amount of 10 is
    assert len(seen) == 1


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    """Many counties and events of a few boxes: only distinct boxes meet, and every row gets its due."""
    seen, plain = [], catalog._overlaps
    monkeypatch.setattr(catalog, "_overlaps", lambda a, b, size: seen.append((a.count(), b.count())) or plain(a, b, size))
    x = (F.col("id") % 3).cast("double")
    counties = spark.range(300).select((x * 10).alias("w"), F.lit(0.0).alias("s"), (x * 10 + 5).alias("e"), F.lit(5.0).alias("n"), F.lit(10).alias("population"))
    events = spark.range(200).select("id", (F.col("id") % 2 * 100.0).alias("qw"), F.lit(1.0).alias("qs"), (F.col("id") % 2 * 100.0 + 12).alias("qe"), F.lit(2.0).alias("qn"))
    got = catalog.affected_population(events, "id", counties, F.lit(1e6), 8.0).collect()
    assert len(got) == 200 and all((r.counties, r.affected) == ((200, 2000) if r.id % 2 == 0 else (0, 0)) for r in got)
    assert catalog.box_pairs(counties, events, 8.0).count() == 100 * 200
    assert seen == [(3, 2), (3, 2)]


def test_joins_of_growing_tables_are_not_broadcast(spark, tmp_path):
    """Small as the tables are here, no round joins them by broadcast: written tables look smaller than they are in memory."""
    plans = []

    def keep(df, k=0):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(f"{tmp_path}/{len(plans)}")
        return spark.read.parquet(f"{tmp_path}/{len(plans)}")

    grid = spark.range(400).select(F.expr("id div 20").alias("row"), (F.col("id") % 20).alias("col"), F.when(F.col("id") % 3 > 0, 1.0).alias("value"))
    N.fill_nearest(grid, keep).count()
    N.components(grid.filter("value > 0"), keep).count()
    tasks = spark.range(1, 40).select(F.col("id").alias("task"))
    assert assessment.levels(tasks, tasks.filter("task > 1").select("task", F.expr("task div 2").alias("needs")), keep).count() == 39
    words = spark.createDataFrame([(i, w, 5) for i, w in enumerate(("chart", "charts", "cart", "carts"))], "id long, word string, n long")
    keep(spelling.near_pairs(words))
    assert len(plans) > 8 and not any("BroadcastHashJoin" in p for p in plans)


WINDOWED = ("local_variance", "fire_contextual", "structural_damage", "skill_score", "dem_spikes", "hand_flow_neighbours", "isolated_pixels", "getis_ord", "idw_fill", "median_filter", "morans_i", "mask_dilation")


@pytest.mark.parametrize("name", WINDOWED)
def test_rows_of_windows_are_not_shuffled(spark, name):
    """Cells go to their tiles in one shuffle; what the explode of offsets makes of them stays in the task."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tr#") == 1
    below = plan[plan.index("Exchange hashpartitioning(tr#") :]
    above = plan[: plan.index("Exchange hashpartitioning(tr#")]
    assert "Generate explode([[" in above and "Generate explode([[" not in below
    if name != "idw_fill":  # which looks its gaps up in a join afterwards
        assert "Exchange hashpartitioning(" not in above


def test_looks_pass_over_the_windows_once(spark, monkeypatch):
    """The quantiles' passes read written looks; they do not build the windows again."""
    plans, plain = [], statistics.quantiles
    monkeypatch.setattr(statistics, "quantiles", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a))
    assert entry.queries()["sar_looks"](spark, "/root/testdata/sf0.001").count() == 1
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_windows_over_tile_borders(spark):
    """Against brute force at borders of tiles, on either side of 0; cells without a place take no part."""
    rng = random.Random(3)
    at = [k for k in range(-70, 70) if k % 64 > 58 or k % 64 < 6]
    cells = {(r, c): rng.random() for r in at for c in at if rng.random() < 0.7}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()] + [(None, 1, 5.0), (1, None, 5.0)], "row long, col long, value double")
    got = {(r.row, r.col): (r.n, r.top) for r in N.focal(df, 3, [F.count("value").alias("n"), F.max("value").alias("top")]).collect()}
    near = lambda r, c: [cells[k] for a in range(-3, 4) for b in range(-3, 4) if (k := (r + a, c + b)) in cells]
    assert got == {k: (len(near(*k)), max(near(*k))) for k in cells}


def test_components_over_block_borders(spark):
    """Against flood filling on either side of 0; only labels that meet at borders of blocks run through rounds."""
    rng = random.Random(5)
    at = [k for k in range(-140, 140) if k % 128 > 115 or k % 128 < 12]
    mask = {(r, c) for r in at for c in at if rng.random() < 0.62}
    label = {}
    for start in sorted(mask, key=lambda k: k[0] * (1 << 31) + k[1]):
        todo = [] if start in label else [start]
        while todo:
            r, c = todo.pop()
            if (r, c) in mask and (r, c) not in label:
                label[r, c] = start[0] * (1 << 31) + start[1]
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    sizes, keep = {}, Rounds(spark, "test-blocks")

    def counted(df, k):
        made = keep(df, k)
        sizes[k] = made.count()
        return made

    df = spark.createDataFrame([*mask, *list(mask)[:9], (None, 3), (3, None)], "row long, col long")
    assert {(r.row, r.col): r.label for r in N.components(df, counted).collect()} == label
    assert sizes[-2] == len(mask) and 0 < sizes[0] < len(mask) / 4


def test_near_points_are_not_paired_with_cells(spark):
    """Against brute force: dense points are found in tiles without a join of cells and points, ties by (row, col), repeated points by the smallest value."""
    rng = random.Random(9)
    cells = [(r, c, 0.0) for r in range(-9, 12) for c in range(56, 76)]
    points = [(r, c, rng.random()) for r, c, _ in cells if rng.random() < 0.25 and (r, c) != (0, 64)]
    points += [(r, c, v / 2) for r, c, v in points[:20]]
    schema = "row long, col long, value double"
    plans, plain = [], Rounds(spark, "test-near")

    def keep(df, k):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, k)

    got = {(r.row, r.col): tuple(r["at"]) for r in N.nearest(spark.createDataFrame(cells, schema), spark.createDataFrame(points, schema), keep).collect()}
    assert got == {(r, c): min(((r - a) ** 2 + (c - b) ** 2, a, b, v) for a, b, v in points) for r, c, _ in cells}
    assert len(plans) == 1 and plans[0].count("SortMergeJoin") == 1  # cells to what was found for them


def test_geometry_of_pairs_is_computed_before_rows_are_joined(spark):
    plan = entry.queries()["bbox_overlap_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    made = plan[plan.index("AS coverage#") :]
    assert made.count("Join Inner") == 1  # that of distinct boxes
    assert plan.count("Join Inner") == 3


def test_upsample_over_tile_borders(spark):
    """Targets on either side of a tile's border and of 0 get all their sources; their rows are not shuffled."""
    cells = {(r, c): float(r * 3 + c) for r in range(-2, 3) for c in range(61, 68)}
    fine = N.upsample(spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, value double"), 2)
    assert {(r.row, r.col): r.value for r in fine.collect()} == {(r, c): r / 2 * 3 + c / 2 for r in range(-4, 5) for c in range(122, 135)}
    assert "hashpartitioning(row" not in fine._jdf.queryExecution().executedPlan().toString()


def test_a_draw_hashes_twice(spark):
    """Monte Carlo: radius and angle of a draw are each computed once, not once for either of its normals."""
    plan = entry.queries()["monte_carlo"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 2


def test_partitioned_sink_does_not_sort(spark, tmp_path):
    """A task writes its rows as they come; with more folders than it keeps open all rows are still there."""
    df = spark.range(3000).select((F.col("id") % 50).alias("key"), "id")
    store, name = spark._jsparkSession.sharedState().statusStore(), "spark.sql.maxConcurrentOutputFileWriters"
    ran, before = store.executionsList().size(), spark.conf.get(name)
    V.write_partitioned(df, f"{tmp_path}/keys", "key")
    listed = store.executionsList()
    plans = [listed.apply(k).physicalPlanDescription() for k in range(ran, listed.size())]
    assert len(plans) == 1 and "REBALANCE" in plans[0] and "Sort" not in plans[0]
    assert spark.conf.get(name) == before
    assert len(list(tmp_path.glob("keys/key=*"))) == 50
    got = spark.read.parquet(f"{tmp_path}/keys")
    assert sorted((r.key, r.id) for r in got.collect()) == sorted((k % 50, k) for k in range(3000))


@pytest.mark.parametrize("name", ["local_variance", "upsample_bilinear"])
def test_tasks_of_windows_grow_with_the_table(spark, monkeypatch, name):
    """More lines are more tasks, for the grid and for its windows; lines are shuffled before they are grouped."""
    from cinderlake.plans import focal_plans

    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 9 * 500 > 500 * parts
    rows = {}
    for lines in (500, 1 << 30):
        monkeypatch.setattr(focal_plans, "LINES", lines)
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        expected = max(parts, -(-n // lines))
        assert re.findall(r"Exchange hashpartitioning\(tr#\d+L?, tc#\d+L?, (\d+)\)", plan)[0] == str(expected)
        assert set(re.findall(r"Exchange hashpartitioning\(strip#\d+L?, (\d+)\)", plan)) == {str(expected)}
        assert "Aggregate" not in plan[plan.rindex("Exchange hashpartitioning(strip#") :]
        rows[lines] = sorted(df.collect())
    assert rows[500] == rows[1 << 30]


#: Cells of fresh tables of 600,000 and 6,000,000 events (event type, value, k; in order), and what their SQL gives for them in every run.
HELD_TO_SQL = {
    "resolve_weighted_vote": (
        ["value", "confidence"],
        [
            ([("view", 128.45, 82), ("view", 7.64, 44), ("view", 0.41, 24), ("signup", 40.55, 75)], (45.0, 0.857143)),
            ([("error", 53.12, 77), ("error", 21.86, 48), ("error", 7.52, 70)], (27.0, 1.0)),
            ([("click", 34.66, 17), ("click", 3.46, 34), ("click", 17.38, 23)], (19.0, 1.0)),
            ([("click", 11.23, 95), ("signup", 5.09, 19), ("click", 14.47, 98), ("error", 57.33, 60)], (5.0, 0.632813)),
            ([("purchase", 50.29, 15), ("view", 231.72, 19), ("error", 109.17, 10)], (109.0, 0.351563)),
            ([("error", 30.86, 43), ("purchase", 12.3, 92), ("signup", 100.98, 37)], (101.0, 0.492187)),
        ],
    ),
    "consensus_vote": (["yes", "majority", "supermajority"], [([("signup", 99.61, 34), ("error", 10.49, 39), ("error", 38.52, 16), ("error", 10.99, 97)], (1.0, 1, 1)), ([("error", 20.0, 39), ("view", 30.0, 5)], (0.5, 0, -1)), ([("error", None, 39), ("view", 30.0, 5)], (0.5, 0, -1))]),
    "conflict_detect": (["n", "agreement", "severity", "penalty"], [([("view", 22.99, 78), ("signup", 15.82, 49), ("click", 6.39, 68)], (3, 0.333333, "high", 0.6)), ([("view", 10.0, 5), ("click", 10.1, 5)], (2, 1.0, "none", 1.0))]),
    "consensus_build": (["value", "secondary"], [([("purchase", 1.86, 92), ("signup", 0.62, 2)], (1.24, True)), ([("error", 9.06, 94), ("signup", 3.02, 38)], (6.04, True)), ([("click", 30.0, 4), ("view", 10.0, 9)], (20.0, False)), ([("view", 5.0, 1)], (5.0, False))]),
}


@pytest.mark.parametrize("name", HELD_TO_SQL)
def test_sums_fall_as_those_of_the_sql(spark, tmp_path, name):
    """Where a threshold or a last digit hangs on how values are added, they are added as the SQL adds them, at every layout of the table."""
    columns, cells = HELD_TO_SQL[name]
    rows = [(100 * u + i, pd.Timestamp("2024-01-02") + pd.Timedelta(seconds=i), u, kind, v, f'{{"k": {k}}}') for u, (events, _) in enumerate(cells) for i, (kind, v, k) in enumerate(events)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    for k in range(3):
        path = f"{tmp_path}/{k}"
        shuffled = spark.createDataFrame(events.sample(frac=1, random_state=k)).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
        shuffled.repartition(1 + k).write.parquet(f"{path}/events.parquet")
        got = {r.user_id: tuple(r[c] for c in columns) for r in entry.queries()[name](spark, path).collect()}
        assert got == {u: want for u, (_, want) in enumerate(cells)}
