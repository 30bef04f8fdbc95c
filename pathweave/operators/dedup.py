"""The three duplicate rules: which rows count as the same position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_by(columns: Sequence[str], order: Column) -> list[Column]:
    # one min_by per column: fixed-width buffers keep the aggregation hashed
    return [F.min_by(c, order).alias(c) for c in columns]


def first_per_position(
    points: DataFrame,
    key: Sequence[str] = ("traj_id",),
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Keep one row per (``key``, lat, lon): the first along ``order``.

    ``order`` must be unique within ``key``. Partial aggregation folds repeated
    positions before the shuffle, so a parked device costs one row per task.
    """
    identity = [*key, "lat", "lon"]
    rest = [c for c in points.columns if c not in identity]
    if len(order) == 1:
        firsts = points.groupBy(*identity).agg(*_first_by(rest, F.col(order[0])))
        return firsts.select(*points.columns)
    # such an order is never hashed, and is better compared once for all columns
    whole = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return points.groupBy(*identity).agg(whole).select(*(c if c in identity else f"_first.{c}" for c in points.columns))


def distinct_positions(points: DataFrame) -> DataFrame:
    """One row per exact (lat, lon), with the smallest ``traj_id`` seen there."""
    return points.groupBy("lat", "lon").agg(F.min("traj_id").alias("traj_id"))


def first_per_rounded_position(
    members: DataFrame, per: Sequence[str] = ()
) -> DataFrame:
    """Keep one segment point per entity and position rounded to six decimals, for
    each value of the columns ``per`` (which then come first).

    The first by (segment, part, pos) survives, with its unrounded coordinates.
    """
    order = F.struct("segment_id", "part", "pos")
    return (
        members.groupBy(
            *per,
            "entity_id",
            F.rint(F.col("lat") * 1e6).alias("_lat6"),
            F.rint(F.col("lon") * 1e6).alias("_lon6"),
        )
        .agg(F.min_by(F.struct("lat", "lon", "timestamp"), order).alias("_p"))
        .select(*per, "entity_id", "_p.lat", "_p.lon", "_p.timestamp")
    )
