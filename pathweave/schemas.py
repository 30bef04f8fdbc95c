"""Fixed schemas and the two small parameter types.

Axis convention: in every segment layout ``x`` is the LATITUDE and ``y`` the
LONGITUDE; geometries are written (lon, lat).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TS = T.TimestampNTZType()
_D = T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


POINTS = _struct(
    ("user_id", T.StringType()),
    ("traj_id", T.StringType()),
    ("seq", T.LongType()),
    ("lat", _D),
    ("lon", _D),
    ("altitude", _D),
    ("timestamp", _TS),
)

SEGMENTS = _struct(
    ("entity_id", T.StringType()),
    ("segment_id", T.LongType()),
    ("part", T.LongType()),
    ("vals_x", T.ArrayType(_D)),
    ("vals_y", T.ArrayType(_D)),
    ("vals_t", T.ArrayType(_TS)),
    ("min_x", _D),
    ("max_x", _D),
    ("min_y", _D),
    ("max_y", _D),
    ("min_t", _TS),
    ("max_t", _TS),
)

SEG_FIXED = T.StructType(
    SEGMENTS.fields + _struct(("centroid_x", _D), ("centroid_y", _D)).fields
)

SEG_GRID = T.StructType(
    SEGMENTS.fields
    + _struct(
        ("cell_i", T.IntegerType()),
        ("cell_j", T.IntegerType()),
        ("grid_cell", T.StringType()),
    ).fields
)

SEG_BY_TIME = T.StructType(
    SEGMENTS.fields + _struct(("first_us", T.LongType()), ("last_us", T.LongType())).fields
)

GEO = T.StructType(POINTS.fields + _struct(("geometry", T.BinaryType())).fields)

KNN = _struct(
    ("traj_id", T.StringType()), ("lat", _D), ("lon", _D), ("distance", _D)
)


@dataclass(frozen=True)
class BBox:
    """Axis-parallel box in degrees, closed on all four sides."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    @classmethod
    def from_lonlat(
        cls, min_lon: float, min_lat: float, max_lon: float, max_lat: float
    ) -> BBox:
        """GIS order (min_lon, min_lat, max_lon, max_lat)."""
        return cls(min_lat, max_lat, min_lon, max_lon)

    @classmethod
    def from_corners(
        cls, min_lat: float, min_lon: float, max_lat: float, max_lon: float
    ) -> BBox:
        """Corner order (min_lat, min_lon, max_lat, max_lon)."""
        return cls(min_lat, max_lat, min_lon, max_lon)


@dataclass(frozen=True)
class GridSpec:
    """Origin and cell size (degrees) of a regular grid."""

    min_lat: float
    min_lon: float
    cell_size: float = 0.001
