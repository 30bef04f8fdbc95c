"""How rows are laid out in files, common to all Parquet layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# cells per tile edge; tiles keep neighbouring cells of both axes in one file
TILE_CELLS = 64
# planned size of a file before compression
FILE_BYTES = 512 * 1024 * 1024


def partitions_for(df: DataFrame, file_bytes: int = FILE_BYTES) -> int | None:
    """How many files ``df`` should fill by the planner's estimate of its size; None
    while the session's shuffle partitions are enough, as AQE then merges small ones.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // file_bytes)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # without statistics the planner answers with its largest number
    return wanted if usual < wanted and size < 1 << 60 else None


def clustered(
    df: DataFrame,
    lat: Column,
    lon: Column,
    tie: list[str],
    cell_size: float = 0.001,
    partitions: int | None = None,
    first: Sequence[Column] = (),
) -> DataFrame:
    """Range-partition and sort rows by ``first``, tile, cell, then ``tie``.

    Row-group statistics of the written files then cover small areas, which is
    what lets pushed-down ranges skip data. ``tie`` ends the key with columns
    that tell rows of one cell apart, so a crowded cell is spread over as many
    partitions as its share of the rows asks for.
    """
    cell_i = F.floor(lat / F.lit(cell_size))
    cell_j = F.floor(lon / F.lit(cell_size))
    keys = [
        *first,
        F.floor(cell_i / TILE_CELLS),
        F.floor(cell_j / TILE_CELLS),
        cell_i,
        cell_j,
        *[F.col(c) for c in tie],
    ]
    if partitions is None:
        partitions = partitions_for(df)
    ranged = (
        df.repartitionByRange(*keys)
        if partitions is None
        else df.repartitionByRange(partitions, *keys)
    )
    return ranged.sortWithinPartitions(*keys)
