"""Which rows of an approximate k-NN answer are proven to be exact.

An index query leaves segments out. The least distance to their bounds is a distance
that no position in them can fall below, so every row of the answer nearer than that
has the place it would have in the exact answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.bounds_distance import least_metres
from pathweave.functions.grid import Grid
from pathweave.functions.predicates import bounds_contain_point, bounds_off_globe
from pathweave.operators.knn import (
    Point,
    knn_fixed_index,
    knn_grid_index,
    nearest_centroids,
    resolve_grid,
    ring_filter,
)
from pathweave.operators.segmentation import CELL_SIZE
from pathweave.session import stored_table

_BOUNDS = ("min_x", "max_x", "min_y", "max_y")
# distances are ranked by the micrometre
SLACK_M = 2e-6


def with_proof(answer: DataFrame, skipped: DataFrame, point: Point) -> DataFrame:
    """``answer`` with ``proven``: whether nothing in the ``skipped`` segments can be as
    near as the row. Without skipped segments all is proven; a skipped segment with
    bounds off the globe proves nothing. Only bounds are read, and one row is left of them.
    """
    nearest = least_metres(F.lit(point[0]), F.lit(point[1]), *(F.col(c) for c in _BOUNDS))
    known = F.when(bounds_off_globe(), F.lit(0.0)).otherwise(nearest)
    # segments without positions have no bounds and hide nothing
    bound = skipped.where(F.col("min_x").isNotNull()).agg(F.min(known)).scalar()
    return answer.withColumn("proven", F.coalesce(F.col("distance") < bound - SLACK_M, F.lit(True)))


def proven_knn_fixed_index(index: DataFrame, point: Point, k: int, top_n_centroids: int = 300) -> DataFrame:
    """``knn_fixed_index`` with ``proven``. The proven rows come first; if all k rows are,
    the answer is the exact one."""
    identity = ["entity_id", "segment_id", "part"]
    kept = nearest_centroids(index.where(bounds_contain_point(*point)), point, top_n_centroids).select(*identity)
    skipped = index.select(*identity, *_BOUNDS).join(kept, identity, "left_anti")
    return with_proof(knn_fixed_index(index, point, k, top_n_centroids), skipped, point)


def proven_knn_grid_index(index: DataFrame, point: Point, k: int, ring: int = 1, grid: Grid | None = None, cell_size: float = CELL_SIZE) -> DataFrame:
    """``knn_grid_index`` with ``proven``: the segments of entities that have none in the
    ring of cells are the skipped ones. The entities are stored when this is called."""
    grid = grid or resolve_grid(index, cell_size)
    entities = stored_table(ring_filter(index, point, grid, ring).select("entity_id").distinct(), "entities")
    skipped = index.select("entity_id", *_BOUNDS).join(entities, "entity_id", "left_anti")
    return with_proof(knn_grid_index(index, point, k, ring, grid, cell_size), skipped, point)
