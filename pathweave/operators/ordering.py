"""Dense zero-based positions inside a trajectory, safe for huge trajectories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.session import stored_table

# A trajectory with more points is numbered piecewise instead of in one task.
HOT_POINTS = 5_000_000


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equal in all columns, nulls included; the right side has a prefix ``_r``."""
    return reduce(
        lambda a, b: a & b, [left[c].eqNullSafe(right[f"_r{c}"]) for c in columns]
    )


def dense_position(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    name: str = "seq",
    hot_points: int = HOT_POINTS,
) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... per ``key`` in ``order`` (nulls first).

    A plain window would sort the largest trajectory in one task. So a first job
    counts the rows of each key; those of keys with more than ``hot_points`` are
    range-partitioned by key and order, stored, and numbered by their place in the
    partition plus the rows of the same key in the partitions before it. What is
    summed up per key is one row for each partition it fills.
    """
    key, order = list(key), list(order)
    hot = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_points)
        .select(*[F.col(c).alias(f"_r{c}") for c in key])
    )
    within = Window.partitionBy(*key).orderBy(*order)
    position = (F.row_number().over(within) - 1).cast("long").alias(name)
    if hot.isEmpty():
        return df.select(*df.columns, position)
    hot = stored_table(hot, "hot-keys")
    is_hot = _same(df, hot, key)
    cold = df.join(hot, is_hot, "left_anti").select(*df.columns, position)
    ranged = (
        df.join(hot, is_hot, "left_semi")
        .repartitionByRange(*key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = stored_table(ranged, "hot-rows").withColumn("_piece", F.shiftright("_at", 33))
    pieces = placed.groupBy(*key, "_piece").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = (
        Window.partitionBy(*key)
        .orderBy("_piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = pieces.select(
        *[F.col(c).alias(f"_r{c}") for c in [*key, "_piece"]],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    numbered = placed.join(shifts, _same(placed, shifts, [*key, "_piece"])).select(
        *df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(name)
    )
    return cold.unionByName(numbered)


def renumber(
    points: DataFrame,
    key: Sequence[str] = ("user_id", "traj_id"),
    hot_points: int = HOT_POINTS,
) -> DataFrame:
    """Close gaps in ``seq`` (zero-based, unique per ``key``)."""
    source = points.withColumnRenamed("seq", "_seq")
    out = dense_position(source, key, ["_seq"], "seq", hot_points)
    return out.select(*points.columns)


def merge_users(
    points: DataFrame,
    hot_points: int = HOT_POINTS,
) -> DataFrame:
    """One trajectory per ``traj_id``, whoever recorded it.

    Logs with the same file stem under two users become one trajectory, ordered
    by user and then by ``seq``; without this step the key is
    (``user_id``, ``traj_id``).
    """
    source = points.withColumnRenamed("seq", "_seq")
    out = dense_position(source, ["traj_id"], ["user_id", "_seq"], "seq", hot_points)
    return out.select(*points.columns)
