"""Detection kernels on pixel tables, one row a cell.  Each adds columns; none needs more than the row and, where said, a one-row aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, classes, clip, guarded

#: Fixed values.
SAR_THRESHOLD_DB, SAR_CHANGE_DB = -15.0, 3.0
SEVERITY_CUTS, SEVERITY_CODES = (-0.10, 0.10, 0.27, 0.44, 0.66), (1, 0, 2, 3, 4, 5)
FIRE_K, BACKGROUND_K, CONTEXT_DELTA_K, CONF_LOW_K, CONF_SPAN_K = 320.0, 310.0, 10.0, 330.0, 30.0
STEFAN_BOLTZMANN, EMISSIVITY = 5.67e-8, 0.98
PLANCK_1, PLANCK_2 = 1.191042e8, 1.4387774e4


def with_global(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates of the whole input on every row: a one-row table is broadcast, so nothing is shuffled but partial aggregates."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) within -1 and 1; null where the sum is not over 1e-6."""
    return clip_null(guarded(a - b, a + b))


def clip_null(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), clip(c, low, high))


def sar_flood(db: Column, threshold: float = SAR_THRESHOLD_DB) -> tuple[Column, Column]:
    """Water is under the threshold; confidence is the margin over the threshold's size."""
    return db < threshold, clip((threshold - db) / abs(threshold), 0, 1)


def sar_change(pre: Column, post: Column, threshold: float = SAR_THRESHOLD_DB, change: float = SAR_CHANGE_DB) -> tuple[Column, Column]:
    dark, margin = sar_flood(post, threshold)
    return dark & (pre - post > change), (margin + clip((pre - post) / (3 * change), 0, 1)) / 2


def ndwi_flood(ndwi: Column, threshold: float = 0.0) -> tuple[Column, Column]:
    return ndwi > threshold, clip(0.5 + 0.5 * (ndwi - threshold) / (1 - threshold), 0, 1)


def change_magnitude(pre: Column, post: Column, method: str) -> Column:
    if method == "difference":
        return post - pre
    if method == "ratio":
        return post / F.when(F.abs(pre) < EPS, F.lit(EPS)).otherwise(pre)
    return guarded(post - pre, post + pre)


def severity(dnbr: Column) -> Column:
    return classes(dnbr, SEVERITY_CUTS, SEVERITY_CODES)


def burn_confidence(dnbr: Column, threshold: float = 0.10) -> Column:
    burned = clip(0.5 + 0.5 * (dnbr - threshold) / (0.66 - threshold), 0.5, 1)
    return F.when(dnbr > threshold, burned).otherwise(clip(0.5 + 0.5 * (threshold - dnbr) / 0.3, 0, 1))


def brightness_temperature(radiance: Column, wavelength: float) -> Column:
    """Inverse Planck function; wavelength in micrometres."""
    return F.when(radiance > 0, PLANCK_2 / (wavelength * F.log(PLANCK_1 / (wavelength**5 * radiance) + 1)))


def simple_fire(t: Column) -> tuple[Column, Column]:
    return t > FIRE_K, clip((t - CONF_LOW_K) / CONF_SPAN_K, 0, 1)


def fire_power(t: Column, background: Column, pixel_m: float) -> Column:
    """Fire radiative power in MW, not under 0."""
    return F.greatest(F.lit(0.0), F.lit(pixel_m**2 * STEFAN_BOLTZMANN * EMISSIVITY) * (F.pow(t, 4) - F.pow(background, 4)) / 1e6)


def spectral_indices(blue: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> dict[str, Column]:
    """NBR, NDVI, BAI, MIRBI, NBR2 (by the code: minus NBR), EVI."""
    bai = 1 / (F.pow(0.1 - red, 2) + F.pow(0.06 - nir, 2) + F.lit(1e-10))
    evi = 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1)
    return {
        "nbr": normalised_difference(nir, swir2),
        "ndvi": normalised_difference(nir, red),
        "bai": clip(bai, 0, 1000),
        "mirbi": 10 * swir2 - 9.8 * swir1 + 2,
        "nbr2": normalised_difference(swir2, nir),
        "evi": F.when(nir + 6 * red - 7.5 * blue + 1 != 0, clip(evi, -1, 1)),
    }


def wind_damage(pre: Column, post: Column) -> dict[str, Column]:
    """Vegetation loss after wind: severity 0 to 3 and a confidence."""
    loss = post - pre
    damaged = (pre >= 0.3) & (loss <= -0.1)
    return {
        "damaged": (pre >= 0.3) & (loss <= -0.2),
        "severity": F.when(damaged, F.when(loss <= -0.4, 3).when(loss <= -0.2, 2).otherwise(1)).otherwise(0),
        "confidence": 0.7 * clip(-loss / 0.4, 0, 1) + 0.3 * clip((pre - 0.1) / 0.9, 0, 1),
    }


def damage_score(brightness: Column, texture: Column, coherence: Column | None = None) -> Column:
    base = 0.4 * brightness + 0.6 * texture
    return base if coherence is None else 0.7 * base + 0.3 * coherence


def damage_grade(score: Column, grades: int = 5) -> Column:
    """0 under .15, then steps evenly spaced from .15 to .7."""
    cuts = [0.15 + 0.55 * k / (grades - 1) for k in range(grades)]
    return classes(score, cuts, list(range(grades + 1)))


def hand_susceptibility(height: Column, slope: Column, limit: float = 10.0) -> tuple[Column, Column]:
    return height <= limit, 0.7 * clip(1 - height / limit, 0, 1) + 0.3 * clip(1 - slope / 20, 0, 1)


def area_stats(df: DataFrame, detected: Column, confidence: Column, pixel_m: float, *by: str) -> DataFrame:
    """Pixels, hectares, percent of valid rows and mean confidence of what is detected."""
    hit = F.when(detected, 1)
    return df.groupBy(*by).agg(
        F.count(hit).alias("pixels"),
        F.round(F.count(hit) * pixel_m**2 / 1e4, 6).alias("area_ha"),
        F.round(100.0 * F.count(hit) / F.nullif(F.count(detected), F.lit(0)), 6).alias("percent"),
        F.round(F.avg(F.when(detected, confidence)), 6).alias("mean_confidence"),
    )
