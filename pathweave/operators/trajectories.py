"""Per-trajectory views of a points table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trajectory_lengths(
    points: DataFrame, key: Sequence[str] = ("traj_id",)
) -> DataFrame:
    return points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"))


def trajectory_boxes(points: DataFrame, key: Sequence[str] = ("traj_id",)) -> DataFrame:
    return points.groupBy(*key).agg(
        F.min("lat").alias("min_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lat").alias("max_lat"),
        F.max("lon").alias("max_lon"),
    )


def regroup(parts: DataFrame, key: Sequence[str] = ("traj_id",)) -> DataFrame:
    """The rows of :func:`assemble` as one row per trajectory, for trajectories that
    are known to fit into one task."""
    part = F.struct("part", "points")
    whole = F.array_sort(F.collect_list(part))
    return parts.groupBy(*key).agg(F.flatten(whole["points"]).alias("points"))


def assemble(
    points: DataFrame, key: Sequence[str] = ("traj_id",), part_points: int = 100_000
) -> DataFrame:
    """Points of each trajectory as one ordered array of structs.

    A trajectory longer than ``part_points`` comes as several rows ``part`` =
    0, 1, ... in order, so no row or task grows with the trajectory; all parts
    together hold every point.
    """
    point = F.struct("seq", "lat", "lon", "altitude", "timestamp")
    part = F.expr(f"seq div {int(part_points)}").alias("part")
    return points.groupBy(*key, part).agg(
        F.array_sort(F.collect_list(point)).alias("points")
    )
