"""Least and greatest great-circle distance from a position to a degree rectangle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathweave.functions.distance import EARTH_RADIUS_M, haversine


def _to_meridian(lat: Column, lon: Column, edge: Column, low: Column, high: Column) -> Column:
    """Metres to the nearest point of a meridian between two latitudes.

    Along a meridian the distance has one valley; it lies at an end of the piece
    unless the valley's latitude is inside.
    """
    turn = F.radians(edge - lon)
    valley = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(turn)))
    within = F.least(F.greatest(valley, low), high)
    return F.least(*(haversine(lat, lon, at, edge) for at in (low, high, within)))


def least_metres(lat: Column, lon: Column, low_lat: Column, high_lat: Column, low_lon: Column, high_lon: Column) -> Column:
    """Metres to the nearest point of the rectangle, 0 inside.

    All arguments are degrees on the globe, low <= high. Where the position's
    longitude is one of the rectangle's, the nearest point lies straight north or
    south; elsewhere it is on one of the two meridian edges, as on a parallel the
    distance falls towards the position's longitude.
    """
    # the difference to the western edge, going east, in [0, 360)
    east = F.pmod(lon - low_lon, F.lit(360.0))
    beside = (east <= high_lon - low_lon) | (high_lon - low_lon >= 360.0)
    gap = F.greatest(low_lat - lat, lat - high_lat, F.lit(0.0))
    straight = F.lit(EARTH_RADIUS_M) * F.radians(gap)
    edges = F.least(_to_meridian(lat, lon, low_lon, low_lat, high_lat), _to_meridian(lat, lon, high_lon, low_lat, high_lat))
    return F.when(beside, straight).otherwise(edges)


def greatest_metres(lat: Column, lon: Column, low_lat: Column, high_lat: Column, low_lon: Column, high_lon: Column) -> Column:
    """Metres to the farthest point: what is near the antipode is far from here."""
    return F.lit(math.pi * EARTH_RADIUS_M) - least_metres(-lat, lon + 180.0, low_lat, high_lat, low_lon, high_lon)
