"""Helpers over the parallel arrays of a segment, and text-encoded arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_mean(values: Column) -> Column:
    """Arithmetic mean in stored order; null for an empty array."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def decode_doubles(text: Column) -> Column:
    """``"{1.0,2.5}"`` to an array of doubles; ``"{}"`` to an empty array."""
    body = F.regexp_replace(text, r"^\{+|\}+$", "")
    parts = F.transform(F.split(body, ","), lambda v: F.trim(v).cast("double"))
    return F.when(
        F.trim(body) == "", F.array().cast("array<double>")
    ).otherwise(parts)


def decode_timestamps(text: Column) -> Column:
    """``"{'2008-11-26T12:50:29',...}"`` to an array of TIMESTAMP_NTZ."""
    body = F.regexp_replace(text, r"^\{+|\}+$", "")
    parts = F.transform(
        F.split(body, ","),
        lambda v: F.regexp_replace(v, r"^[\s']+|[\s']+$", "").cast("timestamp_ntz"),
    )
    return F.when(
        F.trim(body) == "", F.array().cast("array<timestamp_ntz>")
    ).otherwise(parts)


def encode_doubles(values: Column) -> Column:
    """Inverse of :func:`decode_doubles`."""
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(values, lambda v: v.cast("string")), ","),
        F.lit("}"),
    )
