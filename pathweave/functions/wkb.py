"""Point geometry as well-known binary, built batch-wise on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# fixed values: WKB byte-order mark 1 (little endian), geometry type 1 (point)
_POINT = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


def encode_points(lon: pa.Array, lat: pa.Array) -> pa.Array:
    """One POINT(lon lat) per element; null where a coordinate is null."""
    x = lon.to_numpy(zero_copy_only=False)
    y = lat.to_numpy(zero_copy_only=False)
    rows = np.empty(len(x), dtype=_POINT)
    rows["order"], rows["kind"], rows["x"], rows["y"] = 1, 1, x, y
    offsets = np.arange(len(x) + 1, dtype="<i4") * _POINT.itemsize
    points = pa.Array.from_buffers(
        pa.binary(),
        len(x),
        [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())],
    )
    missing = np.asarray(lon.is_null()) | np.asarray(lat.is_null())
    if not missing.any():
        return points
    return pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), points)


def point_geometry(lon: Column | str = "lon", lat: Column | str = "lat") -> Column:
    """WKB ``POINT(lon lat)``. Spark has no built-in that forms a geometry from
    coordinates, so this is an Arrow-batched function."""

    @F.arrow_udf(BinaryType())
    def encode(x: pa.Array, y: pa.Array) -> pa.Array:
        return encode_points(x, y)

    return encode(lon, lat)
