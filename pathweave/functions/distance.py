"""Distances between positions, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0  # fixed value: mean Earth radius in metres

Number = Column | float | int


def _col(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def haversine(lat1: Number, lon1: Number, lat2: Number, lon2: Number) -> Column:
    """Great-circle distance in metres, two-argument-arctangent form."""
    phi1, phi2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    half_dphi = (phi2 - phi1) / 2.0
    half_dlam = (F.radians(_col(lon2)) - F.radians(_col(lon1))) / 2.0
    sin_phi, sin_lam = F.sin(half_dphi), F.sin(half_dlam)
    a = sin_phi * sin_phi + F.cos(phi1) * F.cos(phi2) * (sin_lam * sin_lam)
    # a can leave [0, 1] by a rounding error near the antipode
    a = F.least(F.lit(1.0), a)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def law_of_cosines(lat1: Number, lon1: Number, lat2: Number, lon2: Number) -> Column:
    """Great-circle distance in metres, arc-cosine form.

    The cosine is clamped to [-1, 1]: at distance zero it may exceed 1 by a
    rounding error, and the arc cosine would then be NaN.
    """
    phi1, phi2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dlam = F.radians(_col(lon2)) - F.radians(_col(lon1))
    cosine = F.cos(phi1) * F.cos(phi2) * F.cos(dlam) + F.sin(phi1) * F.sin(phi2)
    return F.lit(EARTH_RADIUS_M) * F.acos(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))
    )


def planar_degrees(lat1: Number, lon1: Number, lat2: Number, lon2: Number) -> Column:
    """Euclidean distance in degrees."""
    dx = _col(lon1) - _col(lon2)
    dy = _col(lat1) - _col(lat2)
    return F.sqrt(dx * dx + dy * dy)


def to_micro(value: Column) -> Column:
    """Round half-even to six decimals.

    Metres so rounded compare equal on every JVM (trigonometric functions may
    differ in the last bit between processors), so top-k orders by them.
    """
    return F.rint(value * 1e6) / 1e6


def search_box(
    lat: Number, lon: Number, metres: Column
) -> tuple[Column, Column, Column, Column]:
    """Degree ranges (lat_lo, lat_hi, lon_lo, lon_hi) holding a whole circle.

    ``metres`` bounds the distance from (lat, lon). Where the circle touches a
    pole or crosses the antimeridian, longitude is left unrestricted. A hair of
    slack covers rounding. The ranges hold for coordinates inside
    [-90, 90] x [-180, 180]; see :func:`pathweave.functions.predicates.off_globe`.
    """
    lat, lon = _col(lat), _col(lon)
    angle = metres / EARTH_RADIUS_M * (1 + 1e-9) + 1e-9
    dlat = F.degrees(angle)
    lat_lo, lat_hi = lat - dlat, lat + dlat
    ratio = F.sin(angle) / F.cos(F.radians(lat))
    dlon = F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + 1e-9
    whole = (
        (angle >= math.pi / 2)
        | (lat_hi >= 90.0)
        | (lat_lo <= -90.0)
        | (lon - dlon < -180.0)
        | (lon + dlon > 180.0)
    )
    lon_lo = F.when(whole, F.lit(-180.0)).otherwise(lon - dlon)
    lon_hi = F.when(whole, F.lit(180.0)).otherwise(lon + dlon)
    return lat_lo, lat_hi, lon_lo, lon_hi
