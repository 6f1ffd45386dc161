"""Warps and zooms against whole-grid NumPy, at several block sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.operators import assessment
from cinderlake.operators import resample as R

SCHEMA = "scene string, band int, row long, col long, value double, extra string"


def frame(spark, a, holes=(), scene="s", band=0):
    rows = [(scene, band, r, c, float(a[r, c]), "x") for r in range(a.shape[0]) for c in range(a.shape[1]) if (r, c) not in holes]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def whole(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.row, r.col])
        out[r.row, r.col] = r.value
    return out


def solve(a, order):
    """Spline coefficients by solving the whole system, mirrored at the ends."""
    weights = {3: [1 / 6, 4 / 6, 1 / 6], 5: [1 / 120, 26 / 120, 66 / 120, 26 / 120, 1 / 120]}[order]

    def matrix(n):
        m = np.zeros((n, n))
        for i in range(n):
            for k, w in zip(range(-(order // 2), order // 2 + 1), weights):
                j = abs(i + k) % max(2 * n - 2, 1)
                m[i, min(j, 2 * n - 2 - j) if j >= n else j] += w
        return m

    return np.linalg.solve(matrix(a.shape[1]), np.linalg.solve(matrix(a.shape[0]), a).T).T


def bspline(order, x):
    """The centred basis function, by its recursion."""
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    h = (order + 1) / 2
    return ((h + x) * bspline(order - 1, x + 0.5) + (h - x) * bspline(order - 1, x - 0.5)) / order


def plain_zoom(a, out, order):
    ys = np.arange(out[0]) * ((a.shape[0] - 1) / (out[0] - 1) if out[0] > 1 else 0)
    xs = np.arange(out[1]) * ((a.shape[1] - 1) / (out[1] - 1) if out[1] > 1 else 0)
    if order == 0:
        return a[np.floor(ys + 0.5).astype(int)][:, np.floor(xs + 0.5).astype(int)]
    if order == 1:
        mid = np.array([np.interp(ys, np.arange(a.shape[0]), a[:, c]) for c in range(a.shape[1])]).T
        return np.array([np.interp(xs, np.arange(a.shape[1]), row) for row in mid])
    c = solve(a, order)

    def along(n, at):
        k = np.arange(-order, n + order)
        j = np.abs(k) % max(2 * n - 2, 1)
        j = np.where(j >= n, 2 * n - 2 - j, j)
        m = np.zeros((len(at), n))
        for i, col in enumerate(j):
            m[:, col] += bspline(order, at - k[i])
        return m

    return along(a.shape[0], ys) @ c @ along(a.shape[1], xs).T


@pytest.mark.parametrize("order", [0, 1, 3, 5])
@pytest.mark.parametrize("block", [16, 64])
def test_zoom_equals_the_whole_grid(spark, order, block):
    a = np.random.default_rng(order).random((57, 33)) * 100
    for out in ((100, 71), (23, 90)):
        got = whole(R.zoom(frame(spark, a), a.shape, out, order, block), out)
        np.testing.assert_allclose(got, plain_zoom(a, out, order), rtol=0, atol=1e-9)


def test_zoom_edges(spark):
    a = np.arange(12.0).reshape(3, 4)
    assert whole(R.zoom(frame(spark, a), (3, 4), (1, 4), 1), (1, 4)).tolist() == [[0, 1, 2, 3]]
    assert whole(R.zoom(frame(spark, a[:1]), (1, 4), (2, 7), 3), (2, 7))[0, ::2].round(9).tolist() == [0, 1, 2, 3]
    holes = {(1, 1)}
    got = whole(R.zoom(frame(spark, a, holes), (3, 4), (5, 7), 1), (5, 7))
    assert np.isnan(got[1:4, 1:4]).all() and not np.isnan(got[0]).any() and not np.isnan(got[:, 4:]).any()
    near = whole(R.zoom(frame(spark, a, holes), (3, 4), (5, 7), 0), (5, 7))
    assert np.isnan(near[1:3, 1:3]).all() and np.isnan(near).sum() == 4
    assert R.zoom(frame(spark, a).limit(0), (3, 4), (5, 7), 3).count() == 0
    with pytest.raises(ValueError, match="order"):
        R.zoom(frame(spark, a), (3, 4), (5, 7), 2)
    messy = frame(spark, a).unionByName(spark.createDataFrame([(None, 0, 0, 0, 1.0, ""), ("s", 0, -1, 0, 1.0, ""), ("s", 0, 0, 9, 1.0, ""), ("s", 0, None, 0, 1.0, ""), ("t", None, 0, 0, 5.0, "")], SCHEMA))
    got = R.zoom(messy, (3, 4), (3, 4), 0).collect()
    assert len([r for r in got if r.scene == "s"]) == 12 and [(r.scene, r.band, r.value) for r in got if r.scene != "s"] == [("t", None, 5.0)]


def test_coordinates(spark):
    rng = random.Random(5)
    lon, lat = np.array([rng.uniform(12, 18) for _ in range(200)]), np.array([rng.uniform(-79, 83) for _ in range(200)])
    for epsg in (32633, 32733, 3857):
        back = R.to_degrees(epsg, *R.from_degrees(epsg, lon, lat))
        np.testing.assert_allclose(back, (lon, lat), atol=2e-9)
    df = spark.createDataFrame(list(zip(lon.tolist(), np.abs(lat).tolist())), "lon double, lat double")
    x, y = assessment.utm(F.col("lon"), F.col("lat"), F.lit(33))
    want = np.array([tuple(r) for r in df.select(x, y).collect()]).T
    np.testing.assert_allclose(R.from_degrees(32633, lon, np.abs(lat)), want, atol=0.01)
    with pytest.raises(ValueError, match="known"):
        R.from_degrees(2154, lon, lat)


@pytest.mark.parametrize("order, error", [(0, 3.0), (1, 0.05), (3, 0.01)])
def test_round_trip_between_systems(spark, order, error):
    """UTM to Web Mercator and back: a smooth field returns within a stated error, twelve cells from its edge (a spline rings beside cells without data)."""
    source = R.Grid(32633, 500000.0, 5_000_000.0, 30.0, 30.0, 90, 70)
    r, c = np.mgrid[0:70, 0:90]
    field = 50 + 20 * np.sin(r / 12) + 15 * np.cos(c / 15)
    there = R.target_grid(source, 3857, 30.0)
    warped = R.warp(frame(spark, field), source, there, order, 32)
    back = whole(R.warp(warped, there, source, order, 40), field.shape)
    inner = back[12:-12, 12:-12]
    assert np.nanmax(np.abs(inner - field[12:-12, 12:-12])) < error and np.isnan(inner).mean() < 0.001
    one = whole(R.warp(frame(spark, field), source, there, order, 512), (there.height, there.width))
    np.testing.assert_allclose(whole(warped, one.shape), one, atol=1e-9)  # block sizes make no difference


def test_only_blocks_under_the_target_are_read(spark):
    a = np.arange(64 * 64.0).reshape(64, 64)
    source = R.Grid(4326, 10.0, 50.0, 0.01, 0.01, 64, 64)
    target = R.Grid(4326, 10.05, 49.9, 0.01, 0.01, 10, 10)
    got = whole(R.warp(frame(spark, a), source, target, 0, 16), (10, 10))
    assert (got == a[10:20, 5:15]).all()
