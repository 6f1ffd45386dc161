"""Column helpers: guarded arithmetic, boxes, time predicates, scores and tile arithmetic.  All stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EPS = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(low))), F.lit(float(high)))


def guarded(num: Column, den: Column, eps: float = EPS) -> Column:
    """num / den where den is over eps, else null."""
    return F.when(den > eps, num / den)


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def steady_sum(c: Column | str) -> Column:
    """Sum of doubles that is the same in whatever order rows are added, so that a threshold met exactly is met at every layout of the table.

    Multiples of 2^-20 (values up to 2^32 in all) and what is left of each value are added apart; either sum is exact, and they are rounded once.
    """
    v = col(c).cast("double")
    whole = F.floor(v * float(1 << 20)).cast("double") / float(1 << 20)
    return F.sum(whole) + F.sum(v - whole)


def ordered_mean(c: Column | str, over: WindowSpec | None = None) -> Column:
    """Mean of a group's values, added from the smallest, as any plain sum adds them in some order: for groups with a bound, such as the sources of a cell."""
    held = F.collect_list(col(c).cast("double"))
    held = F.array_sort(held if over is None else held.over(over))
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda s, x: s + x), F.size(held))


def steady_std(c: Column | str) -> Column:
    """Population deviation of a group's values, always merged in their own order: for groups with a bound, such as the sources of a cell.

    A value is merged as a group of one (squared distance of the means, weighted), as the SQL's parallel tasks merge theirs; added one by one, pairs such as x and 3 x often fall on the other side of a ratio of .5 to their mean.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, x: Column) -> Column:
        n, off = s["n"] + 1, x - s["mean"]
        m2 = F.when(s["n"] > 0, s["m2"] + off * off * s["n"] / n).otherwise(0.0)
        return F.struct(n.alias("n"), ((x + s["n"] * s["mean"]) / n).alias("mean"), m2.alias("m2"))

    return F.aggregate(F.array_sort(F.collect_list(col(c).cast("double"))), start, add, lambda s: F.when(s["n"] > 0, F.sqrt(s["m2"] / s["n"])))


def clean(value: Column | str, nodata: float | None = None, valid: Column | None = None, quality: Column | None = None) -> Column:
    """Null for each encoding of missing data: NaN, infinities, the nodata value, a false mask, no quality."""
    v = col(value).cast("double")
    ok = ~F.isnan(v) & (F.abs(v) < float("inf"))
    if nodata is not None:
        ok = ok & (v != nodata)
    if valid is not None:
        ok = ok & valid
    if quality is not None:
        ok = ok & (quality > 0)
    return F.when(ok, v)


# --- boxes (west, south, east, north) ---------------------------------------------------------------------------------


def box_width(w: Column, e: Column) -> Column:
    """In degrees; a box with west over east crosses the antimeridian."""
    return F.when(w <= e, e - w).otherwise(360 - w + e)


def lon_intervals(w: Column, e: Column) -> list[tuple[Column, Column]]:
    """The one or two plain intervals of longitudes of a box; ends of the second are null where there is one."""
    two = w > e
    return [(w, F.when(two, F.lit(180.0)).otherwise(e)), (F.when(two, F.lit(-180.0)), F.when(two, e))]


def _any(terms: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.coalesce(t, F.lit(False))
    return out


def boxes_intersect(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Closed overlap: an interval of one box's longitudes meets one of the other's, and their latitudes meet."""
    mine, other = lon_intervals(a[0], a[2]), lon_intervals(b[0], b[2])
    return (a[1] <= b[3]) & (a[3] >= b[1]) & _any([(p <= y) & (q >= x) for p, q in mine for x, y in other])


def box_contains(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """a contains b: b's longitudes lie in one of a's intervals.  One exception to the geometry: a box that crosses the antimeridian is in no other box."""
    held = _any([(p <= b[0]) & (b[2] <= q) for p, q in lon_intervals(a[0], a[2])])
    return (a[1] <= b[1]) & (b[3] <= a[3]) & (b[0] <= b[2]) & held


def overlap_area(a: Sequence[Column], b: Sequence[Column]) -> Column:
    (aw, as_, ae, an), (bw, bs, be, bn) = a, b
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(ae, be) - F.greatest(aw, bw)) * F.greatest(zero, F.least(an, bn) - F.greatest(as_, bs))


SPATIAL = {
    "intersects": boxes_intersect,
    "contains": lambda entry, query: box_contains(query, entry),  # the query box contains the entry
    "within": box_contains,  # the entry contains the query box
    "overlaps": boxes_intersect,
}

TEMPORAL = {
    "overlaps": lambda s, e, qs, qe: (s <= qe) & (e >= qs),
    "during": lambda s, e, qs, qe: (s >= qs) & (e <= qe),
    "contains": lambda s, e, qs, qe: (s <= qs) & (e >= qe),
    "before": lambda s, e, qs, qe: e < qs,
    "after": lambda s, e, qs, qe: s > qe,
}

# --- scores ------------------------------------------------------------------------------------------------------------

#: Scores of quality flags and of access models, and the default of either.
QUALITY_SCORE = {"excellent": 1.0, "good": 0.8, "fair": 0.6, "poor": 0.3}
COST_SCORE = {"open": 1.0, "open_restricted": 0.7, "commercial": 0.3}
DEFAULT_SCORE = 0.5
#: Weights of the ranking criteria.
RANK_WEIGHTS = {"spatial": 0.25, "temporal": 0.20, "resolution": 0.15, "cloud": 0.15, "quality": 0.10, "cost": 0.10, "provider": 0.05}
TEMPORAL_DECAY_DAYS, RESOLUTION_DECAY_M = 7.0, 100.0


def lookup(key: Column, values: dict[str, float], default: float = DEFAULT_SCORE) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def decay(x: Column, scale: float) -> Column:
    return F.exp(-x / scale)


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + parts[k] * w
    return total


def classes(x: Column, cuts: Sequence[float], codes: Sequence[int | str]) -> Column:
    """codes[i] for x in [cuts[i - 1], cuts[i]); one more code than cuts; null stays null."""
    out = F.when(x < cuts[0], F.lit(codes[0]))
    for cut, code in zip(cuts[1:], codes[1:-1], strict=True):
        out = out.when(x < cut, F.lit(code))
    return out.when(x >= cuts[-1], F.lit(codes[-1]))


# --- tiles ---------------------------------------------------------------------------------------------------------------


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile column and row, within the grid."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n)
    return F.least(F.greatest(x, F.lit(0)), F.lit(n - 1)), F.least(F.greatest(y, F.lit(0)), F.lit(n - 1))


def metres_per_degree(lat: Column) -> Column:
    """East-west metres of a degree of longitude at a latitude."""
    return F.lit(111320.0) * F.cos(F.radians(lat))


def utm_zone(lon: Column, lat: Column) -> Column:
    """UTM zone number, 1 to 60 (longitude 180 is in zone 60), with the exceptions of western Norway and Svalbard."""
    plain = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)
    zones = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when(norway, F.lit(32)).when(svalbard, zones).otherwise(plain)
