"""Many query points at once: exact k nearest positions for a table of them.

A pyramid of cells tells, per level, roughly how many distinct positions a cell
holds. Each query walks down the pyramid: among the cells still in play, the
nearest ones that surely hold k positions bound its k-th distance by their far
edge, and every cell whose near edge lies beyond that bound drops out. On the
last level (a few metres) the surviving cells are joined to the points. No
query ever meets points far outside its answer, however crowded the area is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.distance import EARTH_RADIUS_M, haversine, to_micro
from pathweave.functions.pyramid import (
    BASE_DEGREES,
    LEVEL_STEP,
    LEVELS,
    base_cell,
    on_globe,
)
from pathweave.session import shared_folder, stored_table

_WORD = 64
# Levels after which the cells in play are stored: one on the way, to keep plans
# short, and the fine ones, where the pyramid is large and must not be shuffled
# for the sake of a few cells.
STORED_LEVELS = (10, 6, 4, 2)
# metres of slack for rounding in cell edges and distances
SLACK_M = 1e-3


def _located(df: DataFrame) -> DataFrame:
    lat, lon = on_globe(F.col("lat"), F.col("lon"))
    return df.withColumns({"_glat": lat, "_glon": lon}).withColumns(
        {
            "_ci": F.shiftright(base_cell(F.col("_glat")), LEVELS[0]),
            "_cj": F.shiftright(base_cell(F.col("_glon")), LEVELS[0]),
        }
    )


def build_pyramid(points: DataFrame, k: int, path: str | None = None) -> DataFrame:
    """Table ``ci, cj, words`` partitioned by ``level``, good for any k up to this.

    ``words`` is a bitmap in which every position sets one of at least 2k bits by
    its hash. Its set bits never exceed the number of distinct positions, its
    width is fixed, and it combines on the map side and from level to level,
    which an exact distinct count does not. Points are read once, for the finest
    level; the other levels come from that table. Written to ``path`` or below
    the shared folder.
    """
    spark = points.sparkSession
    path = path or shared_folder(spark, "pyramid")
    n_words = math.ceil(2 * max(k, 1) / _WORD)
    names = [f"_w{n}" for n in range(n_words)]
    bucket = F.pmod(
        F.xxhash64(F.col("lat") + 0.0, F.col("lon") + 0.0), F.lit(n_words * _WORD)
    )
    none = F.lit(0).cast("long")
    bit = F.expr(f"shiftleft(1L, CAST(_bucket % {_WORD} AS INT))")
    finest = (
        _located(points.select("lat", "lon"))
        .where(F.col("_ci").isNotNull() & F.col("_cj").isNotNull())
        .withColumn("_bucket", bucket)
        .groupBy(F.col("_ci").alias("ci"), F.col("_cj").alias("cj"))
        .agg(
            *[
                F.bit_or(
                    F.when(F.expr(f"_bucket div {_WORD}") == n, bit).otherwise(none)
                ).alias(name)
                for n, name in enumerate(names)
            ]
        )
    )
    stored = stored_table(finest, "pyramid-base")
    coarser = F.explode(F.array(*[F.lit(level) for level in LEVELS[1:]]))
    upper = (
        stored.select("*", coarser.alias("level"))
        .groupBy(
            "level",
            F.expr(f"shiftright(ci, level - {LEVELS[0]})").alias("ci"),
            F.expr(f"shiftright(cj, level - {LEVELS[0]})").alias("cj"),
        )
        .agg(*[F.bit_or(name).alias(name) for name in names])
    )
    # one write for all levels: a pyramid that was there before goes as a whole
    levels = stored.withColumn("level", F.lit(LEVELS[0])).unionByName(upper)
    levels.write.mode("overwrite").partitionBy("level").parquet(path)
    return spark.read.schema(levels.schema).parquet(path)


def _cell_radius(level: int) -> float:
    """Metres no position of a cell is farther from the cell's centre: a straight
    line in degrees is never shorter than the arc."""
    half_diagonal = math.radians(BASE_DEGREES * 2**level * math.sqrt(2) / 2)
    return EARTH_RADIUS_M * half_diagonal + SLACK_M


def globe_cells(level: int) -> list[tuple[int, int]]:
    size = BASE_DEGREES * 2**level
    rows = range(math.floor(-90 / size), math.floor(90 / size) + 1)
    columns = range(math.floor(-180 / size), math.floor(180 / size) + 1)
    return [(i, j) for i in rows for j in columns]


def candidate_cells(pyramid: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, q_lat, q_lon, _bound, ci, cj``: the finest cells that can hold
    one of the k nearest positions, with the bound of the k-th distance.

    The cells of a query lie along the rim of its answer; their number follows
    the shape of the data there, not its density. The size of a stored level
    decides how the next level of the pyramid is joined.
    """
    n_seen = sum(
        (F.bit_count(name) for name in pyramid.columns if name.startswith("_w")),
        F.lit(0),
    )
    sized = pyramid.select("level", "ci", "cj", n_seen.alias("_n"))
    own = ["query_id", "q_lat", "q_lon", "_glat", "_glon"]
    per_query = Window.partitionBy("query_id")
    nearest_first = per_query.orderBy("_metres").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cells = (
        _located(queries.select("query_id", "lat", "lon"))
        .where(F.col("_ci").isNotNull() & F.col("_cj").isNotNull())
        .withColumnsRenamed({"lat": "q_lat", "lon": "q_lon"})
        .select(*own, F.lit(float("inf")).alias("_bound"))
    )
    for level in reversed(LEVELS):
        radius = F.lit(_cell_radius(level))
        size = F.lit(BASE_DEGREES * 2**level)
        if level == LEVELS[-1]:
            # every cell of the globe, a fixed few
            offsets, ci, cj = globe_cells(level), F.col("_di"), F.col("_dj")
        else:
            side = range(2**LEVEL_STEP)
            offsets = [(di, dj) for di in side for dj in side]
            ci = F.col("ci") * 2**LEVEL_STEP + F.col("_di")
            cj = F.col("cj") * 2**LEVEL_STEP + F.col("_dj")
        steps = F.expr(
            "inline(array("
            + ", ".join(f"struct({di}L AS _di, {dj}L AS _dj)" for di, dj in offsets)
            + "))"
        )
        metres = haversine(
            F.col("_glat"), F.col("_glon"), (ci + 0.5) * size, (cj + 0.5) * size
        )
        # by the triangle inequality a position is within radius of the centre's
        # distance; children beyond the parents' bound need no look-up
        asked = (
            cells.select("*", steps)
            .select(
                *own, "_bound", ci.alias("ci"), cj.alias("cj"), metres.alias("_metres")
            )
            .where(F.col("_metres") - radius <= F.col("_bound"))
        )
        filled = asked.join(sized.where(F.col("level") == level), ["ci", "cj"])
        enough = F.when(F.sum("_n").over(nearest_first) >= k, F.col("_metres"))
        bound = F.least("_bound", F.min("_enough").over(per_query) + radius)
        cells = (
            filled.select(*own, "_bound", "ci", "cj", "_metres", enough.alias("_enough"))
            .select(*own, bound.alias("_bound"), "ci", "cj", "_metres")
            .where(F.col("_metres") - radius <= F.col("_bound"))
            .drop("_metres")
        )
        if level in STORED_LEVELS:
            cells = stored_table(cells, f"cells-{level}")
    return cells


def query_places(queries: DataFrame) -> DataFrame:
    """The distinct positions asked for as queries of their own: ``query_id`` (a number
    for the place), ``lat, lon``. Stored, so that the numbers stay."""
    places = queries.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    return stored_table(places.select(F.monotonically_increasing_id().alias("query_id"), "lat", "lon"), "query-places")


def for_each_query(found: DataFrame, places: DataFrame, queries: DataFrame) -> DataFrame:
    """Answers ``found`` for ``places`` given to every query that asks from there."""
    asked = queries.select("query_id", F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"))
    at = places.select(F.col("query_id").alias("_place"), F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"))
    owners = asked.join(at, ["_qlat", "_qlon"]).select("_place", "query_id")
    answers = found.withColumnRenamed("query_id", "_place")
    return owners.join(answers, "_place").select(*found.columns)


def knn_batch(
    points: DataFrame, queries: DataFrame, k: int, pyramid: DataFrame | None = None
) -> DataFrame:
    """Exact k-NN per row ``query_id`` (unique), ``lat, lon`` of ``queries``:
    ``query_id, rank, traj_id, lat, lon, distance``.

    Points outside all cells in play drop out first; of the rest repeated positions
    fold, on the map side too, before they meet any query. Queries from one position
    are answered once. A stored ``pyramid`` of the same points saves building one.
    """
    if pyramid is None:
        pyramid = build_pyramid(points, k)
    places = query_places(queries)
    return for_each_query(_knn_of_places(points, places, k, pyramid), places, queries)


def _knn_of_places(points: DataFrame, queries: DataFrame, k: int, pyramid: DataFrame) -> DataFrame:
    cells = candidate_cells(pyramid, queries, max(k, 1))
    rows = _located(points.select("traj_id", "lat", "lon")).withColumnsRenamed(
        {"_ci": "ci", "_cj": "cj"}
    )
    occupied = cells.select("ci", "cj").distinct()
    positions = (
        rows.join(occupied, ["ci", "cj"], "left_semi")
        .groupBy("ci", "cj", "lat", "lon")
        .agg(F.min("traj_id").alias("traj_id"))
    )
    metres = haversine(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))
    best = Window.partitionBy("query_id").orderBy("_metres", "lat", "lon")
    return (
        positions.join(cells.drop("_glat", "_glon"), ["ci", "cj"])
        .withColumn("distance", metres)
        .withColumn("_metres", to_micro(F.col("distance")))
        .where(F.col("_metres") <= F.col("_bound"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "traj_id", "lat", "lon", "distance")
    )
