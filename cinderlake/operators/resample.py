"""Resampling of raster tables onto another grid: warps between coordinate systems and zooms by any ratio, nearest, bilinear or by interpolating B-splines.

The output drives the work: each output block maps its edge and centre back to the source, and asks for the source blocks within those bounds.  Source cells are packed
into blocks once; blocks meet the output blocks that ask for them by number, and one task a block samples what came together.  A spline of order 3 or 5 needs its
coefficients, which depend on all cells, but with a factor of under 0.44 a cell; a margin of ``HALO`` cells leaves less than 1e-14 of them, so blocks of any size give the whole grid's result.

A group holds the source cells under one output block: for a strong reduction take an overview of the source or smaller output blocks.  Cells are (scene, band, row, col, value).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, HALO = 256, 40
#: Radius of the Web-Mercator sphere; WGS 84 semi-axis and flattening; scale of UTM's central meridian.
RADIUS, AXIS, FLATTENING, UTM_SCALE = 6378137.0, 6378137.0, 1 / 298.257223563, 0.9996

Locate = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Grid:
    """A north-up grid: the corner of its first cell, cell sizes, and its size."""

    epsg: int
    west: float
    north: float
    x_step: float
    y_step: float
    width: int
    height: int


# --- coordinates ---------------------------------------------------------------------------------------------------------


def _series() -> tuple[float, float, list[float], list[float], list[float]]:
    """Third flattening, rectifying radius, and the coefficients of the transverse Mercator series to its third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return n, radius, forward, inverse, latitude


def _zone(epsg: int) -> tuple[float, float]:
    """Central meridian in radians and false northing of a UTM code (326xx, 327xx)."""
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"coordinate system {epsg}: 4326, 3857 and UTM (32601 to 32660, 32701 to 32760) are known")
    return np.radians((epsg % 100) * 6 - 183), 1e7 if epsg // 100 == 327 else 0.0


def from_degrees(epsg: int, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return np.radians(lon) * RADIUS, np.arcsinh(np.tan(np.radians(lat))) * RADIUS
    central, south = _zone(epsg)
    n, radius, forward, _, _ = _series()
    sin, away, e = np.sin(np.radians(lat)), np.radians(lon) - central, 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(sin) - e * np.arctanh(e * sin))
    xi, eta = np.arctan2(t, np.cos(away)), np.arctanh(np.sin(away) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(forward, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(forward, 1))
    return 5e5 + UTM_SCALE * radius * x, south + UTM_SCALE * radius * y


def to_degrees(epsg: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return np.degrees(x / RADIUS), np.degrees(np.arctan(np.sinh(y / RADIUS)))
    central, south = _zone(epsg)
    _, radius, _, inverse, latitude = _series()
    xi, eta = (y - south) / (UTM_SCALE * radius), (x - 5e5) / (UTM_SCALE * radius)
    xi, eta = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(inverse, 1)), eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(inverse, 1))
    chi = np.arcsin(np.sin(xi) / np.cosh(eta))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(latitude, 1))
    return np.degrees(central + np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(lat)


def target_grid(source: Grid, epsg: int, x_step: float, y_step: float | None = None, points: int = 21) -> Grid:
    """The grid in another system that covers the source's bounds, taken from points along its edges."""
    y_step = y_step or x_step
    k = np.linspace(0, 1, points)
    east, south = source.west + source.width * source.x_step, source.north - source.height * source.y_step
    x = np.concatenate([source.west + (east - source.west) * k] * 2 + [np.full(points, source.west), np.full(points, east)])
    y = np.concatenate([np.full(points, source.north), np.full(points, south)] + [south + (source.north - south) * k] * 2)
    px, py = from_degrees(epsg, *to_degrees(source.epsg, x, y))
    return Grid(epsg, float(px.min()), float(py.max()), x_step, y_step, int(np.ceil((px.max() - px.min()) / x_step)), int(np.ceil((py.max() - py.min()) / y_step)))


# --- splines -------------------------------------------------------------------------------------------------------------


def _poles(order: int) -> list[float]:
    if order == 3:
        return [np.sqrt(3.0) - 2]
    a, b = np.sqrt(17745 / 4), np.sqrt(105 / 4)
    return [np.sqrt(67.5 - a) + b - 6.5, np.sqrt(67.5 + a) - b - 6.5]


def coefficients(values: np.ndarray, order: int) -> np.ndarray:
    """B-spline coefficients along both axes, by a forward and a backward pass for each pole; the ends are taken as constant, which a halo makes good."""
    for axis in (0, 1):
        c = np.moveaxis(values, axis, 0).astype(float).copy()
        for z in _poles(order):
            c *= (1 - z) * (1 - 1 / z)
            c[0] = c[0] / (1 - z)
            for i in range(1, len(c)):
                c[i] += z * c[i - 1]
            c[-1] = -z / (1 - z) * c[-1]
            for i in range(len(c) - 2, -1, -1):
                c[i] = z * (c[i + 1] - c[i])
        values = np.moveaxis(c, 0, axis)
    return values


def basis(order: int, t: np.ndarray) -> np.ndarray:
    """Weights of the order + 1 neighbours, the first one (order - 1) / 2 before the cell; ``t`` is the place in the cell, from 0 to 1."""
    out = [np.ones_like(t)]
    for k in range(1, order + 1):  # from order k - 1 to k
        new = [np.zeros_like(t) for _ in range(k + 1)]
        for i, w in enumerate(out):
            new[i] = new[i] + w * (i + 1 - t) / k if i < k else new[i]
            new[i + 1] = new[i + 1] + w * (k - 1 - i + t) / k
        out = new
    return np.stack(out)


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond the ends as if the grid were mirrored at its first and last cell."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def sample(block: np.ndarray, top: int, left: int, height: int, width: int, row: np.ndarray, col: np.ndarray, order: int) -> np.ndarray:
    """Values at fractional places (0: the first cell's centre) of a grid of ``height`` x ``width`` cells, of which ``block`` holds the part from (top, left) on.

    NaN where the nearest cell is outside the grid or has no data.  Order 1 is also NaN where a cell that weighs in has no data; for splines such cells count as 0.
    """
    near_r, near_c = np.floor(row + 0.5).astype(np.int64), np.floor(col + 0.5).astype(np.int64)
    inside = (near_r >= 0) & (near_r < height) & (near_c >= 0) & (near_c < width) & np.isfinite(row) & np.isfinite(col)
    out = np.full(row.shape, np.nan)
    if not inside.any():
        return out
    r, c = row[inside], col[inside]
    nearest = block[near_r[inside] - top, near_c[inside] - left]
    if order == 0:
        out[inside] = nearest
        return out
    r, c = np.clip(r, 0, height - 1), np.clip(c, 0, width - 1)
    if order == 1:
        r0, c0 = np.minimum(np.floor(r), max(height - 2, 0)).astype(np.int64), np.minimum(np.floor(c), max(width - 2, 0)).astype(np.int64)
        total = np.zeros(r.shape)
        for a in (0, 1):
            for b in (0, 1):
                w = np.abs(1 - a - (r - r0)) * np.abs(1 - b - (c - c0))
                v = block[np.minimum(r0 + a, height - 1) - top, np.minimum(c0 + b, width - 1) - left]
                total += np.where(w > 0, w * v, 0.0)
        out[inside] = np.where(np.isnan(nearest), np.nan, total)
        return out
    r0, r1, c0, c1 = int(np.floor(r.min())), int(np.floor(r.max())), int(np.floor(c.min())), int(np.floor(c.max()))
    rows, cols = np.arange(r0 - HALO, r1 + HALO + 1), np.arange(c0 - HALO, c1 + HALO + 1)
    window = np.nan_to_num(block)[np.ix_(_mirror(rows, height) - top, _mirror(cols, width) - left)]
    c_of = coefficients(window, order)
    fr, fc = np.floor(r).astype(np.int64), np.floor(c).astype(np.int64)
    wr, wc, half = basis(order, r - fr), basis(order, c - fc), (order - 1) // 2
    total = np.zeros(r.shape)
    for a in range(order + 1):
        for b in range(order + 1):
            total += wr[a] * wc[b] * c_of[fr - half + a - rows[0], fc - half + b - cols[0]]
    out[inside] = np.where(np.isnan(nearest), np.nan, total)
    return out


# --- blocks ----------------------------------------------------------------------------------------------------------------


def resample(cells: DataFrame, size: tuple[int, int], out_size: tuple[int, int], locate: Locate, order: int = 1, block: int = BLOCK) -> DataFrame:
    """scene, band, row, col, value on a grid of ``out_size`` (height, width): each cell at ``locate(rows, cols)`` of the source of ``size``.

    Order 0 takes the nearest cell, 1 is bilinear, 3 and 5 are interpolating splines.  Cells with a null key, outside of ``size``, null or NaN count as missing; output cells without a value are left out.
    """
    if order not in (0, 1, 3, 5):
        raise ValueError(f"order {order}: 0, 1, 3 or 5")
    spark, (height, width), (out_h, out_w) = cells.sparkSession, size, out_size
    margin = 2 if order < 2 else HALO + 4
    down, across = -(-out_h // block), -(-out_w // block)
    asked = pa.schema([(n, pa.int64()) for n in ("out_row", "out_col", "block_row", "block_col")])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column("id").to_pylist():
                a, b = i // across * block, i % across * block
                e, f = min(a + block, out_h) - 1, min(b + block, out_w) - 1
                k = np.linspace(0, 1, 17)
                r = np.concatenate([np.full(17, a), np.full(17, e), a + (e - a) * k, a + (e - a) * k, [(a + e) / 2]])
                c = np.concatenate([b + (f - b) * k, b + (f - b) * k, np.full(17, b), np.full(17, f), [(b + f) / 2]])
                y, x = locate(r, c)
                good = np.isfinite(y) & np.isfinite(x)
                if not good.any():
                    continue
                spare_r, spare_c = margin + int(np.ptp(y[good]) // 32), margin + int(np.ptp(x[good]) // 32)  # edges bend between their points
                r0, r1 = max(int(y[good].min()) - spare_r, 0), min(int(y[good].max()) + spare_r, height - 1)
                c0, c1 = max(int(x[good].min()) - spare_c, 0), min(int(x[good].max()) + spare_c, width - 1)
                rows += [(i // across, i % across, p, q) for p in range(r0 // block, r1 // block + 1) for q in range(c0 // block, c1 // block + 1) if r0 <= r1 and c0 <= c1]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], pa.int64()) for n in range(4)], schema=asked)

    wanted = spark.range(down * across).mapInArrow(bounds, "out_row long, out_col long, block_row long, block_col long")
    held = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1) & F.col("scene").isNotNull() & F.col("value").isNotNull()
    keyed = cells.filter(held).select("scene", "band", F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"), F.floor(F.col("row") / block).alias("block_row"), F.floor(F.col("col") / block).alias("block_col"))

    def packed(key, t):
        dense = np.full((block, block), np.nan, "<f8")
        dense[t.column("row").to_numpy() - key[2].as_py() * block, t.column("col").to_numpy() - key[3].as_py() * block] = t.column("value").to_numpy()
        return pa.table({"scene": [key[0].as_py()], "band": pa.array([key[1].as_py()], pa.int32()), "block_row": [key[2].as_py()], "block_col": [key[3].as_py()], "data": [dense.tobytes()]})

    tiles = keyed.withColumn("band", F.col("band").cast("int")).groupBy("scene", "band", "block_row", "block_col").applyInArrow(packed, "scene string, band int, block_row long, block_col long, data binary")
    ddl = "scene string, band int, row long, col long, value double"
    schema = pa.schema([("scene", pa.string()), ("band", pa.int32()), ("row", pa.int64()), ("col", pa.int64()), ("value", pa.float64())])

    def made(key, t):
        scene, band, p, q = (k.as_py() for k in key)
        at_r, at_c = t.column("block_row").to_numpy(), t.column("block_col").to_numpy()
        top, left = int(at_r.min()) * block, int(at_c.min()) * block
        # margins reach into blocks without cells, so the window spans what could be asked for
        whole = np.full(((int(at_r.max()) + 1) * block - top + 2 * margin, (int(at_c.max()) + 1) * block - left + 2 * margin), np.nan)
        for r, c, raw in zip(at_r, at_c, t.column("data").to_pylist(), strict=True):
            y, x = int(r) * block - top + margin, int(c) * block - left + margin
            whole[y : y + block, x : x + block] = np.frombuffer(raw, "<f8").reshape(block, block)
        rows, cols = np.mgrid[p * block : min((p + 1) * block, out_h), q * block : min((q + 1) * block, out_w)]
        y, x = locate(rows.ravel().astype(float), cols.ravel().astype(float))
        reach = margin if order < 2 else 4
        near = (y >= top - reach) & (y <= top + len(whole) - 2 * margin + reach) & (x >= left - reach) & (x <= left + whole.shape[1] - 2 * margin + reach)
        value = np.full(y.shape, np.nan)
        if near.any():
            value[near] = sample(_grown(whole, top - margin, left - margin, y[near], x[near], height, width, margin), *_origin(top - margin, left - margin, y[near], x[near], margin), height, width, y[near], x[near], order)
        ok = ~np.isnan(value)
        n = int(ok.sum())
        return pa.Table.from_arrays([pa.array([scene] * n, pa.string()), pa.array(np.full(n, band if band is not None else 0), pa.int32(), mask=np.full(n, band is None)), pa.array(rows.ravel()[ok]), pa.array(cols.ravel()[ok]), pa.array(value[ok])], schema=schema)

    return tiles.join(wanted, ["block_row", "block_col"]).groupBy("scene", "band", "out_row", "out_col").applyInArrow(made, ddl)


def _origin(top: int, left: int, y: np.ndarray, x: np.ndarray, margin: int) -> tuple[int, int]:
    return min(top, int(np.floor(y.min())) - 2 * margin), min(left, int(np.floor(x.min())) - 2 * margin)


def _grown(block: np.ndarray, top: int, left: int, y: np.ndarray, x: np.ndarray, height: int, width: int, margin: int) -> np.ndarray:
    """``block`` widened by cells without data to all that a sample at (y, x) may look at."""
    a, b = _origin(top, left, y, x, margin)
    e, f = max(top + block.shape[0], int(np.ceil(y.max())) + 2 * margin), max(left + block.shape[1], int(np.ceil(x.max())) + 2 * margin)
    out = np.full((e - a, f - b), np.nan)
    out[top - a : top - a + block.shape[0], left - b : left - b + block.shape[1]] = block
    return out


def zoom(cells: DataFrame, size: tuple[int, int], out_size: tuple[int, int], order: int = 1, block: int = BLOCK) -> DataFrame:
    """Any ratio: the first and last cells of both grids lie on each other; an axis of one cell repeats its first source cell."""
    ratio = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(size, out_size, strict=True)]
    return resample(cells, size, out_size, lambda r, c: (r * ratio[0], c * ratio[1]), order, block)


def warp(cells: DataFrame, source: Grid, target: Grid, order: int = 1, block: int = BLOCK) -> DataFrame:
    """The source's values at the centres of the target's cells."""

    def locate(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            lon, lat = to_degrees(target.epsg, target.west + (c + 0.5) * target.x_step, target.north - (r + 0.5) * target.y_step)
            x, y = from_degrees(source.epsg, lon, lat)
        return (source.north - y) / source.y_step - 0.5, (x - source.west) / source.x_step - 0.5

    return resample(cells, (source.height, source.width), (target.height, target.width), locate, order, block)
