"""Distances and areas on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LISTING_RADIUS_KM, MATCH_RADIUS_M, TRANSIT_RADIUS_KM = 6371.0088, 6_371_000.0, 6371.0
WALK_KM_PER_HOUR, WALK_DETOUR = 5.0, 1.3

#: Greater London as latitudes and longitudes.
LONDON = (51.28, 51.70, -0.52, 0.34)


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = LISTING_RADIUS_KM) -> Column:
    """Haversine distance in the unit of the radius."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def bounding_box(lat: float, lng: float, km: float) -> tuple[float, float, float, float]:
    """Latitudes and longitudes that a circle lies within; all longitudes near a pole."""
    angle = km / LISTING_RADIUS_KM
    reach = math.degrees(angle)
    ratio = math.sin(angle) / max(math.cos(math.radians(lat)), 1e-12)
    side = math.degrees(math.asin(ratio)) if ratio < 1 else 180.0
    return max(lat - reach, -90.0), min(lat + reach, 90.0), max(lng - side, -180.0), min(lng + side, 180.0)


def near(lat: float, lng: float, km: float) -> Column:
    """Within km of a point. The box is plain comparisons that reach the scan, the distance decides."""
    low_lat, high_lat, low_lng, high_lng = bounding_box(lat, lng, km)
    box = F.col("lat").between(low_lat, high_lat) & F.col("lng").between(low_lng, high_lng)
    return box & (distance(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= km)


def walk_radius_km(minutes: float) -> float:
    return (minutes + 0.5) / 60 * WALK_KM_PER_HOUR / WALK_DETOUR


def walk_minutes(km: Column) -> Column:
    return F.greatest(F.lit(1), F.round(km * WALK_DETOUR / WALK_KM_PER_HOUR * 60)).cast("long")


def grid_cell(lat: Column, lng: Column) -> tuple[Column, Column]:
    """A point snapped to a grid of 0.002 by 0.003 degrees."""
    return F.round(F.round(lat / 0.002) * 0.002, 4), F.round(F.round(lng / 0.003) * 0.003, 4)


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = LONDON) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def in_polygon(lat: Column, lng: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over rings of (lng, lat), the first the outside and the others holes."""
    crossings = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                across = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lng < F.lit(x2 - x1) * (lat - y1) / F.lit(y2 - y1) + x1)
                crossings = crossings + across.cast("int")
    return crossings % 2 == 1
