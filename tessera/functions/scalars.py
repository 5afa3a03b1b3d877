"""Scalar functions.  NULL gives NULL (strict mode of the SQL front end raises instead)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def _d(x: Column) -> Column:
    return x.cast("double")


def abs_(x: Column) -> Column:
    return F.abs(_d(x))


def round_(x: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(_d(x), int(digits))


def sqrt(x: Column) -> Column:
    return F.sqrt(_d(x))


def log(x: Column, base: Column | None = None) -> Column:
    """Natural logarithm, or to a base; NaN below zero and minus infinity at zero."""
    x = _d(x)
    out = F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))
    return out if base is None else out / F.ln(_d(base))


def coalesce(*xs: Column) -> Column:
    return F.coalesce(*xs)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return _dot(a, b)


def vector_norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL where a vector is zero."""
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def lat(g: Column) -> Column:
    return g["lat"]


def lon(g: Column) -> Column:
    return g["lon"]


def geo_distance(a: Column, b: Column) -> Column:
    """Haversine distance in metres."""
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    dp, dl = q - p, F.radians(b["lon"]) - F.radians(a["lon"])
    h = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p) * F.cos(q) * F.sin(dl / 2) * F.sin(dl / 2)
    h = F.when(h > 1, F.lit(1.0)).otherwise(h)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def geo_bearing(a: Column, b: Column) -> Column:
    """Initial bearing in degrees, [0, 360)."""
    p, q, dl = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lon"] - a["lon"])
    angle = F.degrees(F.atan2(F.sin(dl) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dl)))
    return F.pmod(angle + 360.0, F.lit(360.0))


def point(lat_: Column | float, lon_: Column | float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_col(lat_).cast("double").alias("lat"), as_col(lon_).cast("double").alias("lon"))


def geo_within(g: Column, lat_: float, lon_: float, radius: float) -> Column:
    """Within radius metres; a latitude band goes along, so that file statistics on ``lat`` can prune."""
    if radius < 0:
        raise ValueError("the radius must not be negative")
    band = radius / EARTH_RADIUS_M * 57.29577951308232 + 1e-9
    return g["lat"].between(lat_ - band, lat_ + band) & (geo_distance(g, point(lat_, lon_)) <= radius)


def geo_bbox(g: Column, lat_min: float, lon_min: float, lat_max: float, lon_max: float) -> Column:
    """Inclusive box."""
    if lat_min > lat_max or lon_min > lon_max:
        raise ValueError("the box is empty")
    return g["lat"].between(lat_min, lat_max) & g["lon"].between(lon_min, lon_max)


def geo_speed(a: Column, b: Column, elapsed_ms: Column) -> Column:
    """Metres a second; NULL where no time has passed."""
    return F.when(elapsed_ms > 0, geo_distance(a, b) * 1000.0 / elapsed_ms)
