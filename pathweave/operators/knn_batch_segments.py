"""Many query points against segments: exact k nearest positions by stored bounds.

Segments are put into cells by the middle of their bounds, and cells into a pyramid
that keeps for each cell the bounds of all its segments and a bitmap of their positions.
A query walks down: among the cells in play, the nearest ones that surely hold k
positions bound the k-th distance by how far their bounds reach, and every cell whose
bounds begin beyond that drops out. Where that pyramid is at hand, only segments of cells
that stay to the end are exploded. The distinct positions then answer the queries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.bounds_distance import greatest_metres, least_metres
from pathweave.functions.pyramid import LEVEL_STEP, LEVELS, base_cell, on_globe
from pathweave.operators.dedup import distinct_positions
from pathweave.operators.knn_batch import SLACK_M, globe_cells, knn_batch, query_places
from pathweave.session import shared_folder, stored_table

_WORD = 64
BOUNDS = ("min_x", "max_x", "min_y", "max_y")
#: Levels after which the cells in play are stored, which keeps plans short and tells
#: the planner how few they are.
STORED_LEVELS = (16, 10, 6, 4, 2)


def homes(segments: DataFrame) -> DataFrame:
    """``segments`` with ``ci, cj``, the finest cell of the middle of their bounds, and
    with bounds that hold on the globe: a segment with coordinates outside the usual
    ranges gets the whole globe, as such positions can be near to anything."""
    usual = (F.col("min_x") >= -90.0) & (F.col("max_x") <= 90.0) & (F.col("min_y") >= -180.0) & (F.col("max_y") <= 180.0)
    whole = dict(zip(BOUNDS, (-90.0, 90.0, -180.0, 180.0)))
    placed = segments.withColumns({c: F.when(usual, F.col(c)).otherwise(F.lit(whole[c])) for c in BOUNDS})
    middle = {"ci": ("min_x", "max_x"), "cj": ("min_y", "max_y")}
    return placed.withColumns({c: F.shiftright(base_cell((F.col(a) + F.col(b)) / 2), LEVELS[0]) for c, (a, b) in middle.items()})


def _words(n_words: int) -> list[Column]:
    """Bitmaps of a segment's positions, folded in place without exploding arrays."""
    places = F.transform(
        # what has no distance must not count; adding 0.0 turns -0.0 into 0.0, as equal
        # positions must share a bit
        F.filter(F.arrays_zip("vals_x", "vals_y"), lambda p: F.abs(p["vals_x"] + p["vals_y"]) < float("inf")),
        lambda p: F.pmod(F.xxhash64(p["vals_x"] + 0.0, p["vals_y"] + 0.0), F.lit(n_words * _WORD)),
    )
    none = F.lit(0).cast("long")

    def word(n: int) -> Column:
        one = lambda at: F.when(F.floor(at / _WORD) == n, F.call_function("shiftleft", F.lit(1).cast("long"), (at % _WORD).cast("int"))).otherwise(none)
        return F.aggregate(places, none, lambda held, at: held.bitwiseOR(one(at)))

    return [word(n) for n in range(n_words)]


def build_bounds_pyramid(segments: DataFrame, k: int, path: str | None = None) -> DataFrame:
    """Table ``ci, cj, min_x, max_x, min_y, max_y, words`` partitioned by ``level``,
    good for any k up to this.

    Every position of a cell's segments sets one of at least 2k bits by its hash; set
    bits of several cells taken together never exceed the distinct positions there,
    also where cells share positions. Segments are read once, for the finest level.
    """
    spark = segments.sparkSession
    path = path or shared_folder(spark, "bounds-pyramid")
    names = [f"_w{n}" for n in range(math.ceil(2 * max(k, 1) / _WORD))]
    folds = [*(F.min(c).alias(c) if c[:3] == "min" else F.max(c).alias(c) for c in BOUNDS), *(F.bit_or(n).alias(n) for n in names)]
    rows = homes(segments.select(*BOUNDS, *(w.alias(n) for n, w in zip(names, _words(len(names))))))
    stored = stored_table(rows.where("ci IS NOT NULL AND cj IS NOT NULL").groupBy("ci", "cj").agg(*folds), "bounds-base")
    at = lambda c: F.expr(f"shiftright({c}, level - {LEVELS[0]})").alias(c)
    upper = stored.select("*", F.explode(F.array(*map(F.lit, LEVELS[1:]))).alias("level")).groupBy("level", at("ci"), at("cj")).agg(*folds)
    levels = stored.withColumn("level", F.lit(LEVELS[0])).unionByName(upper)
    levels.write.mode("overwrite").partitionBy("level").parquet(path)
    return spark.read.schema(levels.schema).parquet(path)


def cells_in_play(pyramid: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, q_lat, q_lon, _bound, ci, cj``: the finest cells whose segments can
    hold one of the k nearest positions, with an upper bound of the k-th distance."""
    names = [c for c in pyramid.columns if c.startswith("_w")]
    lat, lon = on_globe(F.col("lat"), F.col("lon"))
    own = ["query_id", "q_lat", "q_lon", "_glat", "_glon"]
    per_query = Window.partitionBy("query_id")
    nearest_first = per_query.orderBy("_far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    asked = queries.select("query_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), lat.alias("_glat"), lon.alias("_glon"))
    # every cell of the globe, a fixed few, instead of children of a cell above
    top = F.expr("inline(array(" + ", ".join(f"struct({i}L AS _pi, {j}L AS _pj)" for i, j in globe_cells(LEVELS[-1])) + "))")
    cells = asked.where("_glat IS NOT NULL AND _glon IS NOT NULL").select(*own, F.lit(float("inf")).alias("_bound"), top)
    to = (F.col("_glat"), F.col("_glon"), *map(F.col, BOUNDS))
    for level in reversed(LEVELS):
        step = 0 if level == LEVELS[-1] else LEVEL_STEP
        children = pyramid.where(F.col("level") == level).select(
            F.shiftright("ci", step).alias("_pi"), F.shiftright("cj", step).alias("_pj"), "ci", "cj", *BOUNDS, *names
        )
        met = cells.join(children, ["_pi", "_pj"]).withColumns({"_near": least_metres(*to) - SLACK_M, "_far": greatest_metres(*to) + SLACK_M})
        met = met.where(F.col("_near") <= F.col("_bound"))
        seen = sum((F.bit_count(F.bit_or(n).over(nearest_first)) for n in names), F.lit(0))
        enough = met.select(*own, "_bound", "ci", "cj", "_near", F.when(seen >= k, F.col("_far")).alias("_enough"))
        bound = F.least("_bound", F.min("_enough").over(per_query))
        cells = enough.select(*own, bound.alias("_bound"), "ci", "cj", "_near").where(F.col("_near") <= F.col("_bound")).drop("_near")
        if level in STORED_LEVELS:
            cells = stored_table(cells, f"bounds-cells-{level}")
        if level != LEVELS[0]:
            cells = cells.withColumnsRenamed({"ci": "_pi", "cj": "_pj"})
    return cells.drop("_glat", "_glon")


def knn_batch_segments(segments: DataFrame, queries: DataFrame, k: int, pyramid: DataFrame | None = None) -> DataFrame:
    """Exact k-NN per row ``query_id`` (unique), ``lat, lon`` of ``queries`` over the
    stored points of segments: ``query_id, rank, traj_id, lat, lon, distance``, the
    rows that ``knn_batch`` gives for the points the segments were cut from.

    Arrays are exploded once, whoever asks for them, and equal positions fold before they
    meet any query. A stored ``pyramid`` of the same segments tells which of them some
    query needs, and only these are opened. To build one all arrays would have to be
    read, so without it all segments are opened at once: where bounds of many segments
    overlap, each query would keep most of their cells.
    """
    if pyramid is not None:
        segments = segments_needed(segments, cells_in_play(pyramid, query_places(queries), max(k, 1)))
    held = segments.select(F.col("entity_id").alias("traj_id"), F.inline(F.arrays_zip(F.col("vals_x").alias("lat"), F.col("vals_y").alias("lon"))))
    # what has no distance is in no answer and must not count
    positions = distinct_positions(held.toDF("traj_id", "lat", "lon").where(F.abs(F.col("lat") + F.col("lon")) < float("inf")))
    return knn_batch(stored_table(positions, "segment-positions"), queries, k)


def segments_needed(segments: DataFrame, cells: DataFrame, columns: Sequence[str] = ("entity_id", "vals_x", "vals_y")) -> DataFrame:
    """``ci, cj`` and the named columns of segments whose cell is in play."""
    occupied = stored_table(cells.select("ci", "cj").distinct(), "bounds-occupied")
    placed = homes(segments.select(*columns, *BOUNDS)).drop(*BOUNDS)
    return placed.join(occupied, ["ci", "cj"], "left_semi")
