"""Whole-number vectors for the operators on embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


@dataclass(frozen=True)
class Shape:
    """How many rows there are, how long the longest vector is, and the largest amount."""

    rows: int
    width: int
    largest: int


def shape(rows: DataFrame, column: str) -> Shape:
    """Of a column of whole numbers; one job that returns one row."""
    most = F.array_max(F.transform(column, lambda x: F.greatest(F.abs(x), F.lit(0))))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("width"), F.max(most).alias("largest")).first()
    return Shape(found["n"], found["width"] or 0, found["largest"] or 0)


def exact_type(bound: int, what: str) -> type:
    """A NumPy type that holds every whole number up to ``bound`` exactly."""
    if bound < 1 << 53:
        return np.float64
    if bound < 1 << 63:
        return np.int64
    raise ValueError(f"{what} of these vectors can exceed a 64-bit number")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a batch as rows of a matrix, short ones filled up with zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=values.dtype)
    inside = np.arange(width)[None, :] < lengths[:, None]
    out[inside] = values[offsets[0] : offsets[-1]]
    return out
