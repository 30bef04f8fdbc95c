"""Comparing answers of different layouts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.distance import haversine, to_micro
from pathweave.functions.scalars import match_class


def ranked(result: DataFrame) -> DataFrame:
    """Number a k-NN result 1, 2, ... from the nearest.

    The window has no partition key; a k-NN result has at most k rows.
    """
    order = Window.orderBy(to_micro(F.col("distance")), "lat", "lon", "traj_id")
    return result.withColumn("rank", F.row_number().over(order))


def compare_knn(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pair two k-NN results by rank, up to the shorter one:
    ``rank, traj_1, traj_2, lat_diff, lon_diff, distance_m, match``."""
    a, b = ranked(first).alias("a"), ranked(second).alias("b")
    metres = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("a.rank") == F.col("b.rank")).select(
        F.col("a.rank").alias("rank"),
        F.col("a.traj_id").alias("traj_1"),
        F.col("b.traj_id").alias("traj_2"),
        F.abs(F.col("a.lat") - F.col("b.lat")).alias("lat_diff"),
        F.abs(F.col("a.lon") - F.col("b.lon")).alias("lon_diff"),
        metres.alias("distance_m"),
        match_class(metres).alias("match"),
    )


def layout_parity(
    results: Mapping[str, DataFrame], categories: Mapping[str, str] | None = None
) -> DataFrame:
    """Matches per layout against the first one:
    ``category, layout, n_matches, diff, rel_diff`` (relative to the first). The
    category of a result is looked up by its name; ``Other`` if it has none."""
    known = categories or {}
    if not results:
        raise ValueError("no results to compare")
    counts = reduce(
        DataFrame.unionByName,
        [
            result.agg(F.count(F.lit(1)).alias("n_matches")).select(
                F.lit(place).alias("_place"),
                F.lit(known.get(name, "Other")).alias("category"),
                F.lit(name).alias("layout"),
                "n_matches",
            )
            for place, (name, result) in enumerate(results.items())
        ],
    )
    # one row per layout
    reference = F.first("n_matches").over(
        Window.orderBy("_place").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    )
    diff = F.col("n_matches") - F.col("_reference")
    return counts.withColumn("_reference", reference).select(
        "category",
        "layout",
        "n_matches",
        diff.alias("diff"),
        F.when(F.col("_reference") > 0, diff / F.col("_reference"))
        .otherwise(0.0)
        .alias("rel_diff"),
    )
