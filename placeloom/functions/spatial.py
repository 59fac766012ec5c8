"""Projection, distances and boxes as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the projected world's width, once for x and once for y, and the radii of the two distance functions.
HALF_X, HALF_Y = 20037508.342789, 20037508.34789
RADIUS_M, RADIUS_KM = 6371000.0, 6373.0


def web_mercator_x(lon: Column) -> Column:
    return lon * F.lit(HALF_X) / 180


def web_mercator_y(lat: Column) -> Column:
    """Grows southwards."""
    return -F.log(F.tan((lat + 90) * F.pi() / 360)) / (F.pi() / 180) * F.lit(HALF_Y) / 180


def _arc(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = (b - a) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    return F.sin(dlat) * F.sin(dlat) + F.cos(a) * F.cos(b) * F.sin(dlon) * F.sin(dlon)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres."""
    return F.asin(F.sqrt(_arc(lon1, lat1, lon2, lat2))) * (2 * RADIUS_M)


def straight(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The place in space, in metres from the earth's centre: straight distances are cheap and grow with the distance on the surface."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b) * RADIUS_M, F.cos(a) * F.sin(b) * RADIUS_M, F.sin(a) * RADIUS_M


def rounded_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole metres, halves to even; -1 where a coordinate is no number. Coordinates may be text."""
    la1, lo1, la2, lo2 = (F.expr("null").cast("double") if c is None else c.try_cast("double") for c in (lat1, lon1, lat2, lon2))
    a = _arc(lo1, la1, lo2, la2)
    return F.coalesce(F.rint(F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * RADIUS_KM) * 1000).cast("bigint"), F.lit(-1).cast("bigint"))


def in_box(x: Column, y: Column, west: float, north: float, width: float, height: float) -> Column:
    """Closed box in projected coordinates, y growing southwards."""
    return x.between(west, west + width) & y.between(north, north + height)


def projected_box(city) -> tuple[float, float, float, float]:
    """(x, y, width, height) of a city's box."""
    import math

    px = lambda lon: lon * HALF_X / 180
    py = lambda lat: -math.log(math.tan((90 + lat) * math.pi / 360)) / (math.pi / 180) * HALF_Y / 180
    x, y = px(city.west), py(city.north)
    return x, y, px(city.east) - x, py(city.south) - y


def time_parts(seconds: Column) -> tuple[Column, Column, Column]:
    """Whole minutes, seconds and milliseconds of a span."""
    return F.floor(seconds / 60).cast("bigint"), F.floor(F.pmod(seconds, F.lit(60.0))).cast("bigint"), F.floor(F.pmod(seconds, F.lit(1.0)) * 1000).cast("bigint")
