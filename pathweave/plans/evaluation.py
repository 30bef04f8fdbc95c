"""The same question asked of every layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.operators.bbox import bbox_points, bbox_segments
from pathweave.operators.compare import layout_parity
from pathweave.operators.knn import (
    Point,
    knn_fixed_index,
    knn_geoparquet,
    knn_grid_index,
    knn_points,
)
from pathweave.plans.layouts import CATEGORY
from pathweave.schemas import BBox


# strategies of the box query: result name, layout asked, coarse filter of segments
BOX_STRATEGIES = (
    ("Base Parquet", "Base Parquet", None),
    ("CSV", "CSV", None),
    ("GeoParquet", "GeoParquet", None),
    ("GeoParquet (small groups)", "GeoParquet (small groups)", None),
    ("Fixed Segments (bounds)", "Fixed Segments", "bounds"),
    ("Fixed Segments (points)", "Fixed Segments", "points"),
    ("Grid Segments (bounds)", "Grid Segments", "bounds"),
    ("Grid Segments (points)", "Grid Segments", "points"),
)
CATEGORIES = {name: CATEGORY[layout] for name, layout, _ in BOX_STRATEGIES}


def bbox_results(layouts: dict[str, DataFrame], box: BBox) -> dict[str, DataFrame]:
    """Box query per layout and strategy, for the layouts given (by the names of
    :func:`pathweave.plans.layouts.open_layouts`); others are skipped."""
    return {
        name: bbox_points(layouts[layout], box)
        if coarse is None
        else bbox_segments(layouts[layout], box, coarse)
        for name, layout, coarse in BOX_STRATEGIES
        if layout in layouts
    }


def bbox_report(layouts: dict[str, DataFrame], box: BBox) -> DataFrame:
    """Matches per layout, grouped by category."""
    return layout_parity(bbox_results(layouts, box), CATEGORIES).orderBy(
        F.col("category"), F.col("layout")
    )


def knn_results(
    layouts: dict[str, DataFrame], point: Point, k: int, top_n_centroids: int = 10_000
) -> dict[str, DataFrame]:
    """k-NN per layout, for the layouts given."""
    asked = {
        "Base Parquet": lambda df: knn_points(df, point, k),
        "Fixed Segments (index)": lambda df: knn_fixed_index(
            df, point, k, top_n_centroids
        ),
        "Grid Segments (index)": lambda df: knn_grid_index(df, point, k),
        "GeoParquet (small groups)": lambda df: knn_geoparquet(df, point, k),
    }
    return {name: ask(layouts[name]) for name, ask in asked.items() if name in layouts}
