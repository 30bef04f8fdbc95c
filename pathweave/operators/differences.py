"""Where the answers of layouts differ, row by row.

Every result is first folded to one digest that does not depend on the order of rows.
Only results whose digest differs from the first one's are looked at again: digests of
their tiles name the tiles that differ, and only rows of these tiles are compared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.session import stored_table

POSITION_COLUMNS = ("traj_id", "lat", "lon", "timestamp")
TILE_DEGREES = 0.001
_SEEDS = (17, 91)
_DIGEST = ["_n", "_d0", "_d1"]


def as_positions(result: DataFrame) -> DataFrame:
    """The columns that answers over points and over segments have in common."""
    owner = "traj_id" if "traj_id" in result.columns else "entity_id"
    return result.select(F.col(owner).alias("traj_id"), *POSITION_COLUMNS[1:])


def _digest(columns: Sequence[str]) -> list[Column]:
    """Number of rows and two sums of 64-bit hashes, whatever the order of rows.

    A hash passes over nulls, so which columns are null is part of what is hashed; sums
    are decimal, which no number of rows overflows.
    """
    nulls = [F.col(c).isNull() for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns, *nulls).cast("decimal(20,0)")) for seed in _SEEDS]
    return [F.count(F.lit(1)).alias("_n"), *(s.alias(name) for s, name in zip(sums, _DIGEST[1:]))]


def _tiles(tile_degrees: float) -> list[Column]:
    """Tile of a position; rows without one share the tile null."""
    return [F.floor(F.col(c) / F.lit(tile_degrees)).alias(name) for c, name in (("lat", "_ti"), ("lon", "_tj"))]


def layout_agreement(results: Mapping[str, DataFrame], columns: Sequence[str] = POSITION_COLUMNS) -> DataFrame:
    """``layout, n_rows, agrees``: whether a result holds the same rows, each as often,
    as the first one. One aggregation a result, which leaves one row."""
    digests = _digests(results, columns)
    first = digests[0]
    # one row per result
    rows = [(name, d["_n"], all(d[c] == first[c] for c in _DIGEST)) for name, d in zip(results, digests)]
    spark = next(iter(results.values())).sparkSession
    return spark.createDataFrame(rows, "layout string, n_rows long, agrees boolean")


def _digests(results: Mapping[str, DataFrame], columns: Sequence[str]) -> list:
    if not results:
        raise ValueError("no results to compare")
    folded = [
        r.agg(*_digest(columns)).select(F.lit(place).alias("_place"), *_DIGEST)
        for place, r in enumerate(results.values())
    ]
    return sorted(reduce(DataFrame.unionByName, folded).collect(), key=lambda d: d["_place"])


def differing_tiles(first: DataFrame, other: DataFrame, columns: Sequence[str] = POSITION_COLUMNS, tile_degrees: float = TILE_DEGREES) -> DataFrame:
    """``_ti, _tj`` and the row numbers ``n_first, n_other`` of tiles that differ. Rows
    fold on the map side, so only tiles are shuffled."""
    keys = ["_ti", "_tj"]
    sides = [side.groupBy(*_tiles(tile_degrees)).agg(*_digest(columns)).alias(name) for side, name in ((first, "a"), (other, "b"))]
    # an empty tile is no row on its side, so the join's nulls differ from any digest
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    equal = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _DIGEST])
    present = F.col("a._n").isNotNull()
    return (
        sides[0]
        .join(sides[1], same, "full")
        .where(~equal)
        .select(
            *[F.when(present, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in keys],
            F.coalesce("a._n", F.lit(0)).cast("long").alias("n_first"),
            F.coalesce("b._n", F.lit(0)).cast("long").alias("n_other"),
        )
    )


def differing_rows(first: DataFrame, other: DataFrame, columns: Sequence[str] = POSITION_COLUMNS, tile_degrees: float = TILE_DEGREES) -> DataFrame:
    """``columns``, ``n_first`` and ``n_other`` of every row that the two hold unequally
    often; nulls equal nulls.

    When called, the differing tiles are stored, and a job of one row finds their
    frame, so that scans with statistics skip what lies outside. Rows are then folded
    to counts of equal ones before they meet.
    """
    tiles = stored_table(differing_tiles(first, other, columns, tile_degrees).select("_ti", "_tj"), "differing-tiles")
    frame = tiles.agg(
        *[f(c).alias(f"{f.__name__}{c}") for c in ("_ti", "_tj") for f in (F.min, F.max)],
        F.count(F.when(F.col("_ti").isNull() | F.col("_tj").isNull(), 1)).alias("nulls"),
    ).first()

    def counted(side: DataFrame, places: tuple[int, int]) -> DataFrame:
        rows = side
        if frame["nulls"] == 0 and frame["min_ti"] is not None:
            for c, tile in (("lat", "_ti"), ("lon", "_tj")):
                # a tile more on each side: division may round an edge either way
                rows = rows.where(F.col(c).between((frame[f"min{tile}"] - 1) * tile_degrees, (frame[f"max{tile}"] + 2) * tile_degrees))
        keyed = rows.select(*columns, *_tiles(tile_degrees)).alias("r")
        on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("_ti", "_tj")]
        kept = keyed.join(tiles.alias("t"), on, "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        return kept.select(*columns, *(F.col("_n") * k if k else F.lit(0).cast("long") for k in places)).toDF(*columns, "n_first", "n_other")

    both = counted(first, (1, 0)).unionByName(counted(other, (0, 1)))
    summed = both.groupBy(*columns).agg(F.sum("n_first").alias("n_first"), F.sum("n_other").alias("n_other"))
    return summed.where(F.col("n_first") != F.col("n_other"))


def layout_differences(results: Mapping[str, DataFrame], columns: Sequence[str] = POSITION_COLUMNS, tile_degrees: float = TILE_DEGREES) -> DataFrame:
    """``layout``, ``columns``, ``n_first``, ``n_other``: the rows in which each result
    differs from the first one. Results need the columns, ``lat`` and ``lon`` among them.

    Equal results cost one aggregation each when this is called and are not read again.
    """
    digests = _digests(results, columns)
    (_, first), *others = results.items()
    found = [
        differing_rows(first, other, columns, tile_degrees).select(F.lit(name).alias("layout"), "*")
        for (name, other), digest in zip(others, digests[1:])
        if any(digest[c] != digests[0][c] for c in _DIGEST)
    ]
    if found:
        return reduce(DataFrame.unionByName, found)
    none = first.limit(0).select(F.lit("").alias("layout"), *columns)
    return none.withColumns({c: F.lit(0).cast("long") for c in ("n_first", "n_other")})
