"""Quality of scenes by sensor, fallbacks between sources, agreement of sensors, and selection of algorithms: grouped aggregates and case columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip

#: Weights of the optical score and thresholds of its masks.
OPTICAL_WEIGHTS = {"cloud": 0.35, "shadow": 0.15, "haze": 0.15, "glint": 0.10, "saturation": 0.10, "clear": 0.15}
CLOUD_BRIGHT, CLOUD_BLUE, CLOUD_NIR, SHADOW_DARK, NEAR_MAX = 0.3, 0.2, 0.2, 0.08, 0.99
#: What a speckle filter multiplies the number of looks by, and the tiers that ask for one.
LOOKS_GAIN = {"none": 1.0, "lee": 2.5, "refined_lee": 3.0, "temporal_average": 4.0}
LOOKS_FILTER, LOOKS_ENHANCED, LOOKS_EXTREME = 5.0, 3.0, 1.5
#: Optical sources in order of preference with their resolution in metres.
OPTICAL_SOURCES = {"sentinel2": 10.0, "landsat8": 30.0, "landsat9": 30.0, "modis_terra": 250.0, "modis_aqua": 250.0, "viirs": 375.0}
#: Elevation sources in order of preference: name, resolution and vertical accuracy in metres.
DEM_SOURCES = (
    ("copernicus_30", 30.0, 4.0), ("nasadem", 30.0, 12.0), ("srtm_30", 30.0, 16.0), ("aster_30", 30.0, 17.0), ("alos_30", 30.0, 5.0), ("copernicus_90", 90.0, 4.0), ("srtm_90", 90.0, 16.0),
)
#: Weights of a scene's quality dimensions.
QUALITY_WEIGHTS = {"completeness": 0.25, "spatial": 0.20, "temporal": 0.15, "radiometric": 0.20, "geometric": 0.10, "atmospheric": 0.10}
#: Rules of sensor pairs: two kinds, observable, type of pair, least and most correlation and bias, tolerance.
PAIR_RULES = (
    ("optical", "sar", "water_extent", "complementary", 0.5, 0.95, -0.15, 0.15, 0.25),
    ("optical", "optical", "water_extent", "redundant", 0.85, 1.0, -0.05, 0.05, 0.1),
    ("sar", "sar", "water_extent", "redundant", 0.8, 1.0, -0.1, 0.1, 0.15),
    ("optical", "thermal", "burn_severity", "complementary", 0.6, 0.9, -0.2, 0.2, 0.3),
    ("optical", "sar", "burn_severity", "complementary", 0.4, 0.8, -0.25, 0.25, 0.35),
    ("optical", "sar", "vegetation_damage", "complementary", 0.5, 0.85, -0.2, 0.2, 0.3),
    ("optical", "lidar", "vegetation_damage", "complementary", 0.6, 0.95, -0.15, 0.15, 0.2),
    ("dem", "optical", "flood_susceptibility", "complementary", 0.3, 0.7, -0.3, 0.3, 0.4),
)
#: Shares of the two haze terms, the ratio's span and the contrast's factor; the shadow and saturation percents that cost the whole part; what a usable optical scene needs.
HAZE_RATIO, HAZE_CONTRAST, HAZE_SPAN, HAZE_FACTOR = 0.6, 0.4, 0.5, 2
SHADOW_FULL, SATURATION_FULL = 50, 10
OPTICAL_LEAST_SCORE, OPTICAL_MOST_CLOUD, OPTICAL_LEAST_CLEAR = 0.3, 80, 20
#: Elevation voids in percent that are interpolated and how many that fills; shares of voids that stay after blending, replacing and morphological filling; least coverage; the accuracy of no source.
VOIDS_INTERPOLATED, VOIDS_FILLED, LEFT_BLENDED, LEFT_REPLACED, LEFT_MORPHOLOGICAL, LEAST_COVERAGE, NO_ACCURACY = 10, 8, 0.1, 0.2, 0.5, 50, 999.0
#: Edge deviations from which a scene is marked and their span; signal to noise under which it is marked, and the least cells; stripes likewise; what each mark costs at most.
EDGE_FROM, EDGE_SPAN, NOISE_SNR, NOISE_CELLS, STRIPES_FROM, STRIPES_SPAN = 3, 5, 10, 10, 0.1, 0.5
EDGE_COST, NOISE_COST, STRIPES_COST = 0.2, 0.2, 0.15
#: Temporal score without a date, days from which it falls, days and share of its fall; geometric score without a system and at the origin; what a usable scene needs.
NO_DATE, FRESH_DAYS, STALE_DAYS, STALE_COST, NO_CRS, AT_ORIGIN = 0.7, 30, 60, 0.5, 0.5, 0.7
SCENE_LEAST_SCORE, SCENE_LEAST_COMPLETE, SCENE_MOST_MARK = 0.3, 0.3, 0.9


def _scaled(v: Column, low: str, high: str) -> Column:
    """By the 2nd and 98th percentile; a band without spread stays as it is."""
    return F.when(F.col(high) - F.col(low) > 1e-6, (v - F.col(low)) / (F.col(high) - F.col(low))).otherwise(v)


def optical_quality(pixels: DataFrame, scene: str, bands: Sequence[str], blue: str, red: str, nir: str, valid: Column) -> DataFrame:
    """scene, cloud, shadow, saturation, clear (percent of valid pixels), haze, score, usable for each scene of a pixel table.

    Brightness is the mean of the first three bands.  Cloud: bright, or blue and bright in the near infrared, against the scene's own percentiles;
    shadow: dark against its cloudless pixels; saturated: within 1 % of the maximum in two bands; haze: a high ratio of blue to red and a low contrast.
    A scene without valid pixels has score 0.  Scenes are groups of a bounded size: their percentiles are exact.
    """
    bright = sum((F.col(b) for b in bands[1:3]), F.col(bands[0])) / min(3, len(bands))
    p = pixels.select(scene, *bands, valid.alias("valid")).withColumn("bright", F.when(F.col("valid"), bright))
    pct = lambda c, q: F.percentile(F.when(F.col("valid"), F.col(c)), F.lit(q))
    ratio = F.when(F.col("valid") & (F.col(red) > 0.01), F.col(blue) / F.col(red))
    first = p.groupBy(scene).agg(
        *(pct(c, q).alias(f"{n}_{e}") for n, c in (("bright", "bright"), ("blue", blue), ("nir", nir)) for e, q in (("low", 0.02), ("high", 0.98))),
        *(F.max(b).alias(f"max_{b}") for b in bands),
        F.avg(ratio).alias("ratio"), (F.stddev_pop("bright") / (F.avg("bright") + 1e-6)).alias("contrast"),
    )
    cloud = (_scaled(F.col("bright"), "bright_low", "bright_high") > CLOUD_BRIGHT) | ((clip(_scaled(F.col(blue), "blue_low", "blue_high"), 0, 1) > CLOUD_BLUE) & (clip(_scaled(F.col(nir), "nir_low", "nir_high"), 0, 1) > CLOUD_NIR))
    tops = sum(((F.col(f"max_{b}") > 0) & (F.col(b) >= F.col(f"max_{b}") * NEAR_MAX)).cast("int") for b in bands)
    p = p.join(first, scene).withColumn("cloud", F.col("valid") & cloud).withColumn("saturated", F.col("valid") & (tops >= 2))
    dry = F.when(F.col("valid") & ~F.col("cloud"), F.col("bright"))
    second = p.groupBy(scene).agg(F.percentile(dry, F.lit(0.02)).alias("dry_low"), F.percentile(dry, F.lit(0.98)).alias("dry_high"))
    p = p.join(second, scene)
    p = p.withColumn("shadow", F.coalesce(F.col("valid") & ~F.col("cloud") & (_scaled(F.col("bright"), "dry_low", "dry_high") < SHADOW_DARK), F.lit(False)))
    n = F.greatest(F.count_if("valid"), F.lit(1))
    share = lambda c: 100.0 * F.count_if(c) / n
    g = p.groupBy(scene).agg(
        F.count_if("valid").alias("n"), share(F.col("cloud")).alias("cloud"), share(F.col("shadow")).alias("shadow"), share(F.col("saturated")).alias("saturation"),
        share(F.col("valid") & ~F.col("cloud") & ~F.col("shadow") & ~F.col("saturated")).alias("clear"), F.first("ratio").alias("ratio"), F.first("contrast").alias("contrast"),
    )
    haze = F.when(F.col("ratio").isNull(), 0.0).otherwise(clip(HAZE_RATIO * clip((F.col("ratio") - 1) / HAZE_SPAN, 0, 1) + HAZE_CONTRAST * F.greatest(F.lit(0.0), 1 - HAZE_FACTOR * F.col("contrast")), 0, 1))
    g = g.withColumn("haze", haze)
    none = F.lit(0.0)
    part = {"cloud": F.greatest(none, 1 - F.col("cloud") / 100), "shadow": F.greatest(none, 1 - F.col("shadow") / SHADOW_FULL), "haze": 1 - F.col("haze"), "glint": F.lit(1.0), "saturation": F.greatest(none, 1 - F.col("saturation") / SATURATION_FULL), "clear": F.col("clear") / 100}
    score = F.when(F.col("n") > 0, clip(sum(w * part[k] for k, w in OPTICAL_WEIGHTS.items()), 0, 1)).otherwise(0.0)
    g = g.withColumn("score", score)
    return g.select(scene, "cloud", "shadow", "saturation", "clear", "haze", "score", ((F.col("score") >= OPTICAL_LEAST_SCORE) & (F.col("cloud") <= OPTICAL_MOST_CLOUD) & (F.col("clear") >= OPTICAL_LEAST_CLEAR)).alias("usable"))


def speckle_filter(looks: Column, multi_temporal: bool = True) -> tuple[Column, Column]:
    """The filter that a scene's equivalent number of looks asks for, and the looks expected after it."""
    extreme = "temporal_average" if multi_temporal else "refined_lee"
    name = F.when(looks < LOOKS_EXTREME, extreme).when(looks < LOOKS_ENHANCED, "refined_lee").when(looks < LOOKS_FILTER, "lee").otherwise("none")
    gain = F.element_at(F.create_map(*[F.lit(x) for kv in LOOKS_GAIN.items() for x in kv]), name)
    return name, looks * gain


def optical_fallback(status: DataFrame, event: str, least_resolution: float = 100.0, oldest_hours: float = 168.0, least_quality: float = 0.3, partial_cloud: float = 40.0, sar_cloud: float = 80.0) -> DataFrame:
    """event, source, handling: of each event's sources (source, available, cloud, quality, age_hours; one row each) the first in order of preference that is
    available, fine, recent and good enough.  Handling: proceed, temporal_composite under moderate cloud, switch_to_sar (no source) under heavy cloud or without a source."""
    order = F.array_position(F.array(*(F.lit(s) for s in OPTICAL_SOURCES)), F.col("source"))
    metres = F.element_at(F.create_map(*[F.lit(x) for kv in OPTICAL_SOURCES.items() for x in kv]), F.col("source"))
    good = F.col("available") & (order > 0) & (metres <= least_resolution) & (F.col("age_hours").isNull() | (F.col("age_hours") <= oldest_hours)) & (F.col("quality").isNull() | (F.col("quality") >= least_quality))
    best = status.groupBy(event).agg(F.min(F.when(good, F.struct(order.alias("order"), F.col("source").alias("source"), F.col("cloud").alias("cloud")))).alias("b"))
    heavy = F.col("b").isNull() | (F.col("b.cloud") >= sar_cloud)
    handling = F.when(heavy, "switch_to_sar").when(F.col("b.cloud") >= partial_cloud, "temporal_composite").otherwise("proceed")
    return best.select(event, F.when(~heavy, F.col("b.source")).alias("source"), handling.alias("handling"))


def dem_fallback(status: DataFrame, area: str, resolution: float = 30.0, accuracy: float = 10.0, most_voids: float = 5.0, blend: bool = True) -> DataFrame:
    """area, source, second, filling, resolution, accuracy, voids: of each area's elevation sources (source, available, voids in percent, coverage or null; one row
    each) the first that is fine, accurate and covers half.  Voids of up to a tenth are interpolated; larger ones come from the next usable
    source with fewer voids, else are filled from their edges.  Without a source: none, with all voids."""
    order = F.array_position(F.array(*(F.lit(n) for n, _, _ in DEM_SOURCES)), F.col("source"))
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for d in DEM_SOURCES for x in (d[0], d[k])]), F.col("source"))
    voids = F.coalesce("voids", F.lit(0.0))
    good = F.col("available") & (order > 0) & (of(1) <= resolution) & (of(2) <= accuracy) & (F.coalesce(F.col("coverage"), 100 - voids) >= LEAST_COVERAGE)
    one = F.struct(order.alias("order"), F.col("source").alias("source"), of(1).alias("metres"), of(2).alias("error"), voids.alias("voids"))
    g = status.groupBy(area).agg(F.array_sort(F.collect_list(F.when(good, one))).alias("all"))
    g = g.withColumn("a", F.get("all", F.lit(0))).withColumn("b", F.get(F.filter("all", lambda x: x["voids"] < F.col("a.voids")), F.lit(0)))
    v, many = F.col("a.voids"), F.col("a.voids") > most_voids
    filling = F.when(F.col("a").isNull() | ~many, "none").when(v <= VOIDS_INTERPOLATED, "interpolation").when(F.col("b").isNotNull(), "blend" if blend else "alternative_dem").otherwise("morphological")
    g = g.withColumn("filling", filling).withColumn("two", F.col("filling").isin("blend", "alternative_dem"))
    left = F.when(F.col("a").isNull(), 100.0).when(F.col("filling") == "interpolation", F.greatest(v - VOIDS_FILLED, F.lit(0.0))).when(F.col("two"), v * (LEFT_BLENDED if blend else LEFT_REPLACED)).when(F.col("filling") == "morphological", v * LEFT_MORPHOLOGICAL).otherwise(v)
    worst = lambda c, none: F.when(F.col("a").isNull(), none).when(F.col("two"), F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}"))).otherwise(F.col(f"a.{c}"))
    return g.select(area, F.col("a.source").alias("source"), F.when(F.col("two"), F.col("b.source")).alias("second"), "filling", worst("metres", 0.0).alias("resolution"), worst("error", NO_ACCURACY).alias("accuracy"), left.alias("voids"))


def scene_quality(cells: DataFrame, scene: str, facts: DataFrame, size: int, cloud: Column, edge: int = 10) -> DataFrame:
    """scene, the six dimensions, score, usable: of scenes of ``size`` x ``size`` cells (r, c, value; missing cells have no row).

    ``facts``: scene, age_days, crs, at_origin.  Edge strips are compared with the inside, row and column means with the whole spread; a scene's cells
    are aggregated once by cell and once by its rows and columns.
    """
    v, r, c = F.col("value"), F.col("r"), F.col("c")
    inside = r.between(edge, size - edge - 1) & c.between(edge, size - edge - 1)
    sides = {"top": r < edge, "bottom": r >= size - edge, "left": c < edge, "right": c >= size - edge}
    g = cells.groupBy(scene).agg(
        F.count(v).alias("n"), F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"), F.avg(F.when(inside, v)).alias("mu_in"), F.stddev_pop(F.when(inside, v)).alias("sd_in"),
        *(F.avg(F.when(side, v)).alias(name) for name, side in sides.items()), F.count_if(cloud).alias("clouds"),
    )
    lines = cells.select(scene, "value", F.explode(F.array(F.struct(F.lit("r").alias("axis"), r.alias("at")), F.struct(F.lit("c").alias("axis"), c.alias("at")))).alias("l"))
    lines = lines.groupBy(scene, "l").agg(F.avg("value").alias("m")).groupBy(scene, F.col("l.axis").alias("axis")).agg(F.stddev_pop("m").alias("s")).groupBy(scene).agg(F.max("s").alias("stripes"))
    g = g.join(lines, scene).join(facts, scene, "left")
    unit = lambda x: F.least(x, F.lit(1.0))
    off = F.coalesce(F.try_divide(F.greatest(*(F.abs(F.col(k) - F.col("mu_in")) for k in sides)), F.col("sd_in")), F.lit(0.0))
    snr, stripes = F.try_divide(F.abs("mu"), F.col("sd")), F.coalesce(F.try_divide(F.col("stripes"), F.col("sd")), F.lit(0.0))
    bad = {
        "edges": F.when(off > EDGE_FROM, unit((off - EDGE_FROM) / EDGE_SPAN)).otherwise(0.0),
        "noise": F.when((snr < NOISE_SNR) & (F.col("mu") != 0) & (F.col("n") > NOISE_CELLS), unit((NOISE_SNR - snr) / NOISE_SNR)).otherwise(0.0),
        "stripes": F.when(stripes > STRIPES_FROM, unit((stripes - STRIPES_FROM) / STRIPES_SPAN)).otherwise(0.0),
    }
    g = g.select("*", *(x.alias(f"bad_{k}") for k, x in bad.items()))
    age = F.col("age_days")
    part = {
        "completeness": F.col("n") / (size * size),
        "spatial": 1 - F.col("bad_edges") * EDGE_COST,
        "temporal": F.when(age.isNull(), NO_DATE).when(age > FRESH_DAYS, 1 - STALE_COST * unit((age - FRESH_DAYS) / STALE_DAYS)).otherwise(1.0),
        "radiometric": (1 - F.col("bad_noise") * NOISE_COST) * (1 - F.col("bad_stripes") * STRIPES_COST),
        "geometric": F.when(F.col("crs").isNull(), NO_CRS).otherwise(1.0) * F.when(F.col("at_origin"), AT_ORIGIN).otherwise(1.0),
        "atmospheric": 1 - F.col("clouds") / (size * size),
    }
    g = g.select(scene, *(x.cast("double").alias(k) for k, x in part.items()), F.greatest("bad_edges", "bad_noise", "bad_stripes").alias("worst"))
    g = g.withColumn("score", sum(w * F.col(k) for k, w in QUALITY_WEIGHTS.items()))
    return g.select(scene, *part, "score", ((F.col("score") >= SCENE_LEAST_SCORE) & (F.col("completeness") >= SCENE_LEAST_COMPLETE) & (F.col("worst") <= SCENE_MOST_MARK)).alias("usable"))


def compare_sensors(observations: DataFrame, cells: int | Column, observable: str = "water_extent", least_overlap: float = 0.3, default_tolerance: float = 0.1) -> DataFrame:
    """sensor_a, sensor_b, pair_type, overlap, corr, bias, rmse, agreement, outcome for all pairs of sensors over their common cells.

    ``observations``: sensor, kind, cell, data, confidence.  Sensors meet on the cell, so the pairs cost as many rows as cells have sensors.
    A rule of the kinds for the observable ("unknown": the kinds' first rule) gives tolerance, expected correlation and expected bias; pairs without one are judged by their
    agreement alone, more strictly if both kinds are the same.
    """
    ok = observations.filter((F.col("confidence") > 0) & F.col("data").isNotNull() & ~F.isnan("data"))
    a, b = ok.alias("a"), ok.alias("b")
    j = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.sensor") < F.col("b.sensor")))
    kinds = [F.col("a.kind"), F.col("b.kind")]
    rule, known = F.lit(None).cast("struct<type:string,c0:double,c1:double,b0:double,b1:double,tol:double>"), F.lit(None).cast("string")
    for x, y, what, kind, c0, c1, b0, b1, tol in reversed(PAIR_RULES):  # the first rule that holds wins
        these = ((kinds[0] == x) & (kinds[1] == y)) | ((kinds[0] == y) & (kinds[1] == x))
        known = F.when(these, kind).otherwise(known)
        if observable in (what, "unknown"):
            rule = F.when(these, F.struct(F.lit(kind).alias("type"), *(F.lit(v).alias(n) for n, v in (("c0", c0), ("c1", c1), ("b0", b0), ("b1", b1), ("tol", tol))))).otherwise(rule)
    off = F.col("a.data") - F.col("b.data")
    j = j.select(F.col("a.sensor").alias("sensor_a"), F.col("b.sensor").alias("sensor_b"), F.col("a.data").alias("x"), F.col("b.data").alias("y"), off.alias("off"), rule.alias("rule"), known.alias("known"), (kinds[0] == kinds[1]).alias("same"))
    g = j.groupBy("sensor_a", "sensor_b", "rule", "known", "same").agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.avg("off").alias("bias"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rmse"),
        F.avg((F.abs("off") <= F.coalesce(F.col("rule.tol"), F.lit(default_tolerance))).cast("double")).alias("agreement"), F.max(F.abs("off")).alias("most"),
    )
    flat = (F.col("sx") < 1e-10) | (F.col("sy") < 1e-10)
    g = g.withColumn("overlap", F.col("n") / cells).withColumn("corr", F.when(flat, F.when(F.col("most") < 1e-8, 1.0)).otherwise(F.try_divide(F.col("cov"), F.col("sx") * F.col("sy"))))
    share, ruled = F.col("agreement"), F.col("rule").isNotNull()
    corr_ok = F.coalesce(F.col("corr").between(F.col("rule.c0"), F.col("rule.c1")), F.lit(True))
    bias_ok = F.col("bias").between(F.col("rule.b0"), F.col("rule.b1"))
    names = ("consistent", "minor_discrepancy", "significant_discrepancy")
    tiers = lambda cuts: F.when(share >= cuts[0], names[0]).when(share >= cuts[1], names[1]).when(share >= cuts[2], names[2]).otherwise("conflict")
    by_rule = F.when((share >= 0.9) & corr_ok & bias_ok, names[0]).when((share >= 0.7) & (corr_ok | bias_ok), names[1]).when(share >= 0.5, names[2]).otherwise("conflict")
    kind = F.coalesce(F.col("rule.type"), F.when(F.col("same"), "redundant"), F.col("known"), F.lit("independent"))
    outcome = F.when(F.col("overlap") < least_overlap, "insufficient_data").when(ruled, by_rule).when(F.col("same"), tiers((0.9, 0.75, 0.5))).otherwise(tiers((0.8, 0.6, 0.4)))
    enough = F.col("overlap") >= least_overlap
    return g.select("sensor_a", "sensor_b", kind.alias("pair_type"), "overlap", *(F.when(enough, F.col(c)).alias(c) for c in ("corr", "bias", "rmse")), F.when(enough, share).otherwise(0.0).alias("agreement"), outcome.alias("outcome"))


def rank_sensors(pairs: DataFrame) -> DataFrame:
    """sensor, score: the mean agreement with other sensors over pairs with enough data, else 0."""
    each = pairs.select(F.explode(F.array("sensor_a", "sensor_b")).alias("sensor"), "agreement", "outcome")
    used = F.when(F.col("outcome") != "insufficient_data", F.col("agreement"))
    return each.groupBy("sensor").agg(F.coalesce(F.avg(used), F.lit(0.0)).alias("score"))


def usable_algorithms(algorithms: DataFrame, available: Sequence[str], memory_mb: int, gpu: bool, deterministic: bool) -> DataFrame:
    """Rows that are not deprecated, need only available data types, fit the memory (unknown fits), need no missing GPU and are deterministic where that is asked."""
    have = F.array(*(F.lit(x) for x in available))
    fits = F.coalesce(F.col("memory_mb") <= memory_mb, F.lit(True))
    keep = ~F.col("deprecated") & (F.size(F.array_except("required", have)) == 0) & fits
    if not gpu:
        keep &= ~F.col("gpu_required")
    if deterministic:
        keep &= F.col("deterministic")
    return algorithms.filter(keep)


def levels(tasks: DataFrame, needs: DataFrame, keep) -> DataFrame:
    """task, level: 0 without dependencies, else one more than the highest level of what the task needs (task, needs); tasks of a cycle get no row.

    Each round takes the tasks all of whose needs have a level; ``keep(df, round)`` writes a round.  Needs outside ``tasks`` do not count.
    """
    edges = needs.join(tasks.select(F.col("task").alias("needs")).hint("merge"), "needs").distinct()
    open_ = edges.groupBy("task").agg(F.count("*").alias("open"))
    now = keep(tasks.join(open_.hint("merge"), "task", "left_anti").select("task", F.lit(0).alias("level")), 0)
    k = 0
    while now.filter(F.col("level") == k).limit(1).count():
        done = edges.join(now.withColumnRenamed("task", "needs").hint("merge"), "needs").groupBy("task").agg(F.count("*").alias("met"), F.max("level").alias("top"))
        ready = open_.join(done.hint("merge"), "task").filter((F.col("met") == F.col("open")) & (F.col("top") == k)).select("task", (F.col("top") + 1).alias("level"))
        now, k = keep(now.unionByName(ready), k + 1), k + 1
    return now


# --- map projections ------------------------------------------------------------------------------------------------------

EARTH_A, EARTH_E2, UTM_SCALE = 6378137.0, 0.00669437999014, 0.9996


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a longitude and latitude in degrees."""
    return EARTH_A * F.radians(lon), EARTH_A * F.asinh(F.tan(F.radians(lat)))


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone: transverse Mercator by the usual series (to about a millimetre within the zone); 10 000 km are added in the south."""
    e2 = EARTH_E2 / (1 - EARTH_E2)
    phi, central = F.radians(lat), F.radians((zone - 1) * 6 - 177)
    n = EARTH_A / F.sqrt(1 - EARTH_E2 * F.sin(phi) * F.sin(phi))
    t, c, a = F.tan(phi) * F.tan(phi), e2 * F.cos(phi) * F.cos(phi), F.cos(phi) * (F.radians(lon) - central)
    m = EARTH_A * (
        (1 - EARTH_E2 / 4 - 3 * EARTH_E2**2 / 64 - 5 * EARTH_E2**3 / 256) * phi
        - (3 * EARTH_E2 / 8 + 3 * EARTH_E2**2 / 32 + 45 * EARTH_E2**3 / 1024) * F.sin(2 * phi)
        + (15 * EARTH_E2**2 / 256 + 45 * EARTH_E2**3 / 1024) * F.sin(4 * phi)
        - 35 * EARTH_E2**3 / 3072 * F.sin(6 * phi)
    )
    x = UTM_SCALE * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2) * F.pow(a, 5) / 120) + 500000
    y = UTM_SCALE * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e2) * F.pow(a, 6) / 720))
    return x, F.when(lat < 0, y + 10000000).otherwise(y)


def edge_points(w: Column, s: Column, e: Column, n: Column, points: int = 21) -> Column:
    """array<struct<x, y>>: points along a box's four edges, so that the bounds of its image can be taken."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    at = lambda a, b, k: a + (b - a) * k / (points - 1)
    return F.flatten(F.transform(steps, lambda k: F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((at(w, e, k), s), (at(w, e, k), n), (w, at(s, n, k)), (e, at(s, n, k)))))))
