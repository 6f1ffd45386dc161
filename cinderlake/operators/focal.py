"""Neighbourhood, connectivity and resampling operators on a grid table (scene keys, row, col, value).

Small windows are expressed by shifting: cells are shuffled once to their tile and to the tiles that their neighbours lie in, then sent to their
neighbours by an explode of offsets within the task, where one grouped aggregate collects them; so no window's rows are shuffled, and a task's
aggregate holds the cells of its tiles.  Large windows use tiles with a halo and an Arrow function a tile (``focal_tiles``).
Components are found by tile; labels of what meets at the tiles' borders are propagated with a written table each round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offsets(half: int, centre: bool = True) -> list[tuple[int, int]]:
    r = range(-half, half + 1)
    return [(a, b) for a in r for b in r if centre or (a, b) != (0, 0)]


#: Side of a tile; a window is grouped by its tile and its cell, and rows of a tile are in one task.
TILE = 64
CELL = ("tr", "tc", "row", "col")


def tiled(grid: DataFrame, half: int, *carry: str, parts: int | None = None) -> DataFrame:
    """Rows (tr, tc, row, col, carried columns): each cell once in every tile that cells at most ``half`` away lie in.  Cells without a place take no part.

    There are ``parts`` tasks, by default as many as shuffles have, which is not lowered by adaptive execution, as a window makes many rows of one after the shuffle.
    A task's aggregate holds the cells of its tiles, so who knows how many cells there are asks for tasks in proportion.
    """
    of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / TILE), F.floor((F.col(c) + half) / TILE)))
    placed = grid.filter(F.col("row").isNotNull() & F.col("col").isNotNull())
    out = placed.select("row", "col", *carry, of("row").alias("tr")).select("row", "col", *carry, "tr", of("col").alias("tc"))
    return out.repartition(parts or int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tr", "tc")


def in_tile(axis: str) -> Column:
    return F.floor(F.col(axis) / TILE) == F.col({"row": "tr", "col": "tc"}[axis])


def spread(grid: DataFrame, steps: Sequence[tuple[int, int]], *carry: str, parts: int | None = None) -> DataFrame:
    """Rows (tr, tc, row, col, dr, dc, carried columns): each value as seen by its neighbours, to be grouped by ``CELL``; cells outside the grid get rows too."""
    moves = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps))
    out = tiled(grid, max(abs(x) for step in steps for x in step), *carry, parts=parts).select("tr", "tc", "row", "col", *carry, F.explode(moves).alias("m"))
    out = out.select("tr", "tc", (F.col("row") - F.col("m.dr")).alias("row"), (F.col("col") - F.col("m.dc")).alias("col"), F.col("m.dr").alias("dr"), F.col("m.dc").alias("dc"), *carry)
    return out.filter(in_tile("row") & in_tile("col"))


def focal(grid: DataFrame, half: int, aggs: Sequence[Column], centre: bool = True, value: str = "value", parts: int | None = None) -> DataFrame:
    """Aggregates of ``value`` over the square window (cells outside the grid take no part), for cells of the grid only."""
    own = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.lit(1)))
    near = spread(grid, offsets(half), value, parts=parts)
    if not centre:
        near = near.withColumn(value, F.when((F.col("dr") != 0) | (F.col("dc") != 0), F.col(value)))
    return near.groupBy(*CELL).agg(own.alias("own"), *aggs).filter("own = 1").drop("own", "tr", "tc")


def previous(value: str, axis: str, step: int = 1) -> Column:
    """The value of the adjacent cell ``step`` (1 or -1) before along an axis, null where the grid has none; a window column."""
    other = "col" if axis == "row" else "row"
    w = W.partitionBy(other).orderBy(axis)
    return F.when(F.lag(axis, step).over(w) == F.col(axis) - step, F.lag(value, step).over(w))


def gradient(grid: DataFrame, axis: str, value: str = "value") -> Column:
    """Central difference between both adjacent cells, one-sided where there is one, null where there is none; a window column."""
    before, after, v = previous(value, axis), previous(value, axis, -1), F.col(value)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - v).when(before.isNotNull(), v - before)


def focal_tiles(grid: DataFrame, half: int, tile: int, kernel: Callable[[np.ndarray], np.ndarray], value: str = "value") -> DataFrame:
    """Apply a window kernel by tiles with a halo of ``half`` cells.  ``kernel`` maps a (h + 2 half, w + 2 half) array, NaN outside the data, to (h, w)."""
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    g = grid.select("row", "col", F.col(value).alias("v")).withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    tr, tc = F.floor((F.col("row") + F.col("a") * half) / tile), F.floor((F.col("col") + F.col("b") * half) / tile)
    g = g.select("row", "col", "v", tr.cast("long").alias("tr"), tc.cast("long").alias("tc")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf.tr.iloc[0]) * tile - half, int(pdf.tc.iloc[0]) * tile - half
        block = np.full((tile + 2 * half, tile + 2 * half), np.nan)
        block[pdf.row.to_numpy() - r0, pdf.col.to_numpy() - c0] = pdf.v.to_numpy()
        made = kernel(block)
        inside = (pdf.row // tile == pdf.tr) & (pdf.col // tile == pdf.tc)
        own = pdf[inside]
        return pd.DataFrame({"row": own.row, "col": own.col, "value": made[own.row.to_numpy() - r0 - half, own.col.to_numpy() - c0 - half]})

    return g.groupBy("tr", "tc").applyInPandas(run, "row long, col long, value double")


#: Side of the blocks that components are first found in.
BLOCK = 128


def _in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of the cells of one block: edges between adjacent keys, whose ends' roots are hooked to the smaller one until none is left."""
    keys, first = np.unique(pdf.row.to_numpy() * (1 << 31) + pdf.col.to_numpy(), return_index=True)
    ends = []
    for step in (1, 1 << 31):
        at = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
        a = np.flatnonzero(keys[at] == keys + step)
        ends.append((a, at[a]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    root = np.arange(len(keys))
    while (root[a] != root[b]).any():
        low, up = np.minimum(root[a], root[b]), np.arange(len(keys))
        np.minimum.at(up, root[a], low)
        np.minimum.at(up, root[b], low)
        while (up != up[up]).any():
            up = up[up]
        root = up[root]
    return pd.DataFrame({"row": pdf.row.to_numpy()[first], "col": pdf.col.to_numpy()[first], "label": keys[root]})


def components(mask: DataFrame, keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """row, col, label: 4-connected components of the cells of ``mask``; the label is the smallest cell key of the component.

    Components are found within blocks; what meets at the blocks' borders are links between their labels, over which rounds run.  Each takes the smallest
    label among linked ones and then jumps to that label's own label, so the number of rounds grows with the logarithm of a component's diameter
    and a round holds border labels only.  ``keep(df, round)`` writes a round and reads it back; what has a number under 0 is kept to the end.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    cells = mask.filter(F.col("row").isNotNull() & F.col("col").isNotNull()).select(F.col("row").cast("long"), F.col("col").cast("long"))
    local = keep(cells.groupBy(block("row").alias("br"), block("col").alias("bc")).applyInPandas(_in_block, "row long, col long, label long"), -2)
    links = None
    for axis, other in (("row", "col"), ("col", "row")):
        last = local.filter(F.pmod(axis, F.lit(BLOCK)) == BLOCK - 1).select((F.col(axis) + 1).alias(axis), other, F.col("label").alias("u"))
        one = last.join(local.filter(F.pmod(axis, F.lit(BLOCK)) == 0).select("row", "col", F.col("label").alias("v")).hint("merge"), ["row", "col"]).select("u", "v")
        links = one if links is None else links.unionByName(one)
    links = keep(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), -1)
    if links.limit(1).count() == 0:
        return local
    now = keep(links.select(F.col("u").alias("key"), F.col("u").alias("label")).distinct(), 0)
    k = 0
    while True:
        k += 1
        seen = links.join(now.hint("merge"), links["v"] == now["key"]).groupBy("u").agg(F.min("label").alias("seen"))
        best = now.join(seen.hint("merge"), now["key"] == seen["u"]).select("key", F.col("label").alias("old"), F.least("label", "seen").alias("best"))
        # hook: the old label's group takes the best label seen by any of its members
        group = best.groupBy(F.col("old").alias("g")).agg(F.min("best").alias("to"))
        jump = group.alias("x").join(group.alias("y").hint("merge"), F.col("x.to") == F.col("y.g"), "left").select(F.col("x.g").alias("g"), F.coalesce("y.to", "x.to").alias("to"))
        nxt = keep(best.join(jump.hint("merge"), best["old"] == jump["g"]).select("key", F.least("best", "to").alias("label"), "old"), k)
        if nxt.filter("label <> old").limit(1).count() == 0:
            whole = nxt.select("key", F.col("label").alias("whole"))
            return local.join(whole.hint("merge"), local["label"] == whole["key"], "left").select("row", "col", F.coalesce("whole", "label").alias("label"))
        now = nxt.drop("old")


def downsample(grid: DataFrame, height: int, width: int, rows: int, cols: int, aggs: Sequence[Column]) -> DataFrame:
    """Blocks whose edges are floor(k * size / blocks): aggregates by block."""
    # the block of a cell is the last k with floor(k * size / n) <= cell
    block = lambda c, size, n: F.floor(((F.col(c) + 1) * n - 1) / size)
    return grid.groupBy(block("row", height, rows).alias("brow"), block("col", width, cols).alias("bcol")).agg(*aggs)


def upsample(grid: DataFrame, factor: int, order: int = 1, parts: int | None = None) -> DataFrame:
    """row, col, value: a whole grid at ``factor`` times the resolution, with sources at multiples of it, up to the last source cell.

    Order 1 is bilinear: each source is sent to the targets that it weighs in; a target that misses a source (a hole) is null, as with NaN.
    Order 0 takes the nearest source (halves go up) and keeps holes.
    """
    if order == 0:
        steps = F.array(*(F.lit(k) for k in range(-(factor // 2), factor - factor // 2)))
        t = grid.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
        t = t.select((F.col("row") * factor + F.col("a")).alias("row"), (F.col("col") * factor + F.col("b")).alias("col"), "value")
        return _within(t, grid, factor)
    steps = F.array(*(F.lit(k) for k in range(1 - factor, factor)))
    t = tiled(grid, 1, "value", parts=parts).withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    weight = (1 - F.abs("a") / factor) * (1 - F.abs("b") / factor)
    t = t.select("tr", "tc", (F.col("row") * factor + F.col("a")).alias("row"), (F.col("col") * factor + F.col("b")).alias("col"), (F.col("value") * weight).alias("part"), weight.alias("w"))
    # a target belongs to the tile of the source at or before it
    t = t.filter((F.floor(F.col("row") / (TILE * factor)) == F.col("tr")) & (F.floor(F.col("col") / (TILE * factor)) == F.col("tc")))
    t = t.groupBy(*CELL).agg(F.sum("part").alias("part"), F.sum("w").alias("w"))
    return _within(t.select("row", "col", F.when(F.col("w") > 1 - 1e-9, F.col("part")).alias("value")), grid, factor)


def _within(fine: DataFrame, grid: DataFrame, factor: int) -> DataFrame:
    """Cells of ``fine`` from the first to the last source cell of ``grid``."""
    ends = grid.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("row", "col")))
    fine = fine.crossJoin(F.broadcast(ends))  # one row
    inside = [F.col(c).between(F.col(f"low_{c}") * factor, F.col(f"high_{c}") * factor) for c in ("row", "col")]
    return fine.filter(inside[0] & inside[1]).select("row", "col", "value")


def _nearest_within(cells: DataFrame, points: DataFrame, half: int) -> DataFrame:
    """row, col, best (d2, cr, cc, cv): the nearest of ``points`` at most ``half`` away, by tiles, for the places of ``cells`` that have one.

    Distances are separable: each column of a row takes its nearest point along the column first, then each cell the nearest of those along its row.  Smaller numbers
    stand for (d2, cr) and (d2, cr, cc), so the first in that order has the smallest.
    """
    span = 2 * half + 1
    both = cells.select("row", "col", F.lit(True).alias("own"), F.lit(None).cast("double").alias("cv")).unionByName(points.select("row", "col", F.lit(False).alias("own"), F.col("value").cast("double").alias("cv")))
    value = F.when(F.count_if(~F.col("own") & F.col("cv").isNull()) == 0, F.min("cv"))  # points of one place: nulls are smallest
    t = tiled(both, half, "own", "cv").groupBy(*CELL).agg(F.max("own").alias("own"), F.count_if(~F.col("own")).alias("points"), value.alias("cv"))
    way = F.array(*(F.lit(k) for k in range(-half, half + 1)))
    own = F.max(F.col("own") & (F.col("m") == 0)).alias("own")
    # m is the point's place less the cell's
    t = t.withColumn("m", F.explode(F.when(F.col("points") > 0, way).otherwise(F.array(F.lit(0)))))
    code = F.when(F.col("points") > 0, F.col("m") * F.col("m") * span + F.col("m") + half)
    t = t.select("tr", "tc", (F.col("row") - F.col("m")).alias("row"), "col", "m", "own", "cv", code.cast("long").alias("code")).filter(in_tile("row"))
    t = t.groupBy(*CELL).agg(own, F.min("code").alias("code"), F.min_by("cv", "code").alias("cv"))
    t = t.withColumn("m", F.explode(F.when(F.col("code").isNotNull(), way).otherwise(F.array(F.lit(0)))))
    code = (F.col("code") + F.col("m") * F.col("m") * span) * span + F.col("m") + half
    t = t.select("tr", "tc", "row", (F.col("col") - F.col("m")).alias("col"), "m", "own", "cv", code.alias("code")).filter(in_tile("col"))
    t = t.groupBy(*CELL).agg(own, F.min("code").alias("code"), F.min_by("cv", "code").alias("cv")).filter("own")
    d2 = F.expr(f"code div {span * span}")
    at = F.struct(d2.alias("d2"), (F.col("row") + F.expr(f"code div {span} % {span}") - half).alias("cr"), (F.col("col") + F.col("code") % span - half).alias("cc"), "cv")
    return t.filter(d2 <= half * half).select("row", "col", at.alias("best"))


def nearest(grid: DataFrame, points: DataFrame, keep: Callable[[DataFrame, int], DataFrame], first: int = 4) -> DataFrame:
    """row, col, value, at (d2, cr, cc, cv): each cell's nearest of ``points`` (row, col, value) at any distance; ties go to the smallest (row, col).

    What is at most ``first`` away is found in tiles, where points are not paired with cells.  Cells left and points meet in blocks of r cells, nine blocks a cell, so whatever
    is within r is seen.  A cell is done when its nearest point is at most r away; r doubles for the others.  Joins are merges by hint: written tables look small enough to
    broadcast by their compressed size.  Without points ``at`` is null, as it is for cells that have no row or col; points without them count for nothing.
    """
    shape = "struct<d2:bigint,cr:bigint,cc:bigint,cv:double>"
    cells = grid.select(F.col("row").cast("long"), F.col("col").cast("long"), "value", F.lit(None).cast(shape).alias("at"))
    placed = F.col("row").isNotNull() & F.col("col").isNotNull()
    points = points.filter(placed).select(F.col("row").cast("long"), F.col("col").cast("long"), "value")
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    k, r = 0, 2 * first
    some = points.limit(1).count() > 0
    now = cells.filter(placed)
    if some:
        best = _nearest_within(now, points, first)
        now = now.join(best.hint("merge"), ["row", "col"], "left").select("row", "col", "value", F.col("best").cast(shape).alias("at"))
    now = keep(now, 0)
    while some and now.filter("at IS NULL").limit(1).count():
        k += 1
        block = lambda c, r=r: F.floor(F.col(c) / r)
        c = points.select(F.col("row").alias("cr"), F.col("col").alias("cc"), F.col("value").alias("cv"), block("row").alias("br"), block("col").alias("bc"))
        near = now.filter("at IS NULL").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("row", "col", (block("row") + F.col("i")).alias("br"), (block("col") + F.col("j")).alias("bc"))
        d2 = (F.col("row") - F.col("cr")) * (F.col("row") - F.col("cr")) + (F.col("col") - F.col("cc")) * (F.col("col") - F.col("cc"))
        best = near.join(c.hint("merge"), ["br", "bc"]).groupBy("row", "col").agg(F.min(F.struct(d2.alias("d2"), "cr", "cc", "cv")).alias("best")).filter(F.col("best.d2") <= r * r)
        now = keep(now.join(best.hint("merge"), ["row", "col"], "left").select("row", "col", "value", F.coalesce("at", "best").alias("at")), k)
        r *= 2
    return now.unionByName(cells.filter(~placed))


#: Bounds of the confidence of cells filled from the nearest one.
NEAREST_LEAST, NEAREST_MOST = 0.1, 0.8


def fill_nearest(grid: DataFrame, keep: Callable[[DataFrame], DataFrame], most: float = 10.0) -> DataFrame:
    """row, col, value, confidence: gaps (cells whose value is null or NaN) take the nearest cell's value, at any distance; ties go to the smallest (row, col).

    Confidence is 1 for cells with a value, else 1 - distance / ``most`` within 0.1 and 0.8.  Without any value, or a place, gaps stay, with confidence 0.
    ``keep`` writes a table and reads it back, and drops none before the result is used.
    """
    some = F.col("value").isNotNull() & ~F.isnan("value")
    cells = keep(grid.select("row", "col", F.col("value").cast("double").alias("value")))
    near = nearest(cells.filter(~F.coalesce(some, F.lit(False))), cells.filter(some), lambda df, k: keep(df))
    sure = F.least(F.greatest(1 - F.sqrt("at.d2") / most, F.lit(NEAREST_LEAST)), F.lit(NEAREST_MOST))
    filled = near.select("row", "col", F.col("at.cv").alias("value"), F.when(F.col("at").isNotNull(), sure).otherwise(0.0).alias("confidence"))
    return cells.filter(some).withColumn("confidence", F.lit(1.0)).unionByName(filled)


def contextual_fire(grid: DataFrame, half: int = 10, threshold: float = 320.0, delta: float = 10.0, low: float = 330.0, high: float = 360.0, tile: int = 64) -> DataFrame:
    """row, col, value, mu, sd, fire, confidence for each valid cell of brightness temperatures in kelvin.

    Background: cells of the window under ``threshold`` - 10, the centre left out; with fewer than three mu = sd = 0, as in the
    reference, so a cell without background still meets the absolute test.
    """
    side = 2 * half + 1
    grid = grid.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))

    def background(deviation: bool) -> Callable[[np.ndarray], np.ndarray]:
        def kernel(block: np.ndarray) -> np.ndarray:
            out = np.zeros((block.shape[0] - 2 * half, block.shape[1] - 2 * half))
            view = np.lib.stride_tricks.sliding_window_view(block, (side, side))
            for i in range(len(out)):  # a row of windows at a time
                w = view[i].copy()
                use = w < threshold - 10  # NaN is not
                use[:, half, half] = False
                n = use.sum(axis=(1, 2))
                some = np.maximum(n, 1)
                mu = np.where(use, w, 0.0).sum(axis=(1, 2)) / some
                made = np.sqrt((np.where(use, w - mu[:, None, None], 0.0) ** 2).sum(axis=(1, 2)) / some) if deviation else mu
                out[i] = np.where(n >= 3, made, 0.0)
            return out

        return kernel

    mu = focal_tiles(grid, half, tile, background(False)).withColumnRenamed("value", "mu")
    sd = focal_tiles(grid, half, tile, background(True)).withColumnRenamed("value", "sd")
    gap = F.col("value") - F.col("mu")
    fire = (F.col("value") > threshold) & (gap > delta) & (gap > 3 * F.col("sd"))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    sure = (unit((F.col("value") - low) / (high - low)) + unit(gap / (delta * 5))) / 2
    return grid.join(mu, ["row", "col"]).join(sd, ["row", "col"]).withColumn("fire", fire).withColumn("confidence", F.when(F.col("fire"), sure).otherwise(0.0))
