"""Segments of trajectories that arrive piece by piece.

Both segmentations need a dense number for every point of a trajectory, which no
micro-batch can give alone. So each trajectory keeps a small state: how many points it
had, its last point and that point's cell, and the segment that is still open. A point
leaves as a row of its segment as soon as it is known; a segment grows over batches and
nothing waits for its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathweave.operators.extent import with_cells
from pathweave.operators.segmentation import (
    CELL_SIZE,
    FIXED_SEGMENT_POINTS,
    PART_POINTS,
    finish_segments,
    with_segment_bounds,
)
from pathweave.schemas import GridSpec

MEMBERS = "entity_id string, segment_id long, part long, pos long, lat double, lon double, timestamp timestamp_ntz"
STATE = "points long, segment long, begun long, lat double, lon double, micros long, cell_i long, cell_j long"

#: (numbers of the points, whether each lies in another cell than the one before) to
#: where segments start.
Cut = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def advance(state: tuple | None, lat: np.ndarray, lon: np.ndarray, micros: np.ndarray, cell_i: np.ndarray, cell_j: np.ndarray, cut: Cut, part_points: int) -> tuple[tuple, dict[str, np.ndarray]]:
    """New points of one trajectory, in order: its new state and the rows they make.

    A segment after the first begins with the point before it, in a row with ``pos``
    -1, which is told when the first own point arrives.
    """
    points, segment, begun, *last = state or (0, 0, 0, 0.0, 0.0, 0, cell_i[0], cell_j[0])
    number = points + np.arange(len(lat))
    columns = [np.concatenate([[old], new]) for old, new in zip(last, (lat, lon, micros, cell_i, cell_j))]
    moved = (columns[3][1:] != columns[3][:-1]) | (columns[4][1:] != columns[4][:-1])
    starts = cut(number, moved) & (number > 0)
    own = segment + np.cumsum(starts)
    since = np.maximum.accumulate(np.where(starts, number, begun))
    first = np.flatnonzero(starts)
    # the point before a start is one place earlier, as the columns begin with the last
    rows = {
        "segment_id": np.concatenate([own, own[first]]),
        "pos": np.concatenate([number - since, np.full(len(first), -1)]),
        **{n: np.concatenate([c[1:], c[first]]) for n, c in zip(("lat", "lon", "micros"), columns)},
    }
    rows["part"] = np.maximum(rows["pos"] // part_points, 0)
    held = (int(number[-1]) + 1, int(own[-1]), int(since[-1]), float(lat[-1]), float(lon[-1]), int(micros[-1]), int(cell_i[-1]), int(cell_j[-1]))
    return held, rows


def _members(points: DataFrame, key: Sequence[str], order: Sequence[str], cut: Cut, part_points: int) -> DataFrame:
    """``points`` has ``lat, lon, timestamp, cell_i, cell_j`` and the named columns."""
    order, n_keys = list(order), len(key)

    def run(group: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        met = pd.concat(list(pieces)).sort_values(order, kind="stable")
        held, rows = advance(
            state.get if state.exists else None,
            *(met[c].to_numpy() for c in ("lat", "lon")),
            _micros(met["timestamp"]),
            *(met[c].to_numpy().astype(np.int64) for c in ("cell_i", "cell_j")),
            cut,
            part_points,
        )
        state.update(held)
        out = pd.DataFrame({c: rows[c] for c in ("segment_id", "part", "pos", "lat", "lon")})
        out.insert(0, "entity_id", "/".join(str(x) for x in group if x is not None) if n_keys > 1 else group[0])
        out["timestamp"] = rows["micros"].astype("datetime64[us]")
        yield out

    # a cell number out of range is null; all of these are one cell
    nowhere = F.lit(-(1 << 40)).cast("long")
    cells: dict[str, Column] = {c: F.coalesce(F.col(c).cast("long"), nowhere) for c in ("cell_i", "cell_j")}
    wanted = points.withColumns(cells).select(*key, *order, "lat", "lon", "timestamp", "cell_i", "cell_j")
    return wanted.groupBy(*key).applyInPandasWithState(run, MEMBERS, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_fixed_members(points: DataFrame, max_segment_size: int = FIXED_SEGMENT_POINTS, key: Sequence[str] = ("user_id", "traj_id"), order: Sequence[str] = ("seq",), part_points: int = PART_POINTS) -> DataFrame:
    """The rows of ``fixed_members`` for points that arrive in a stream, numbered by
    arrival; see ``stream_grid_members``."""
    size = int(max_segment_size)
    if size < 1:
        raise ValueError(f"segment size must be positive: {size}")
    placed = points.withColumns({"cell_i": F.lit(0), "cell_j": F.lit(0)})
    return _members(placed, key, order, lambda number, moved: number % size == 0, int(part_points))


def stream_grid_members(points: DataFrame, grid: GridSpec, cell_size: float = CELL_SIZE, key: Sequence[str] = ("user_id", "traj_id"), order: Sequence[str] = ("seq",), part_points: int = PART_POINTS) -> DataFrame:
    """The rows of ``grid_members`` for points that arrive in a stream.

    Points of one micro-batch count in ``order`` (which may have gaps), those of later
    batches after them, also if their ``seq`` begins anew, as in the next log of the
    same trajectory. A task holds the points that one trajectory gets in one batch; the
    stream's trigger bounds them. Append the rows to a table, and make segments of it
    with ``segments_of_members``. The state goes with the stream's checkpoint.
    """
    placed = with_cells(points, grid, cell_size, label=False)
    return _members(placed, key, order, lambda number, moved: moved, int(part_points))


def segments_of_members(members: DataFrame) -> DataFrame:
    """SEGMENTS rows of what a stream has appended so far. One job asks whether any
    segment has several parts, whose bounds then are those of the whole segment."""
    rows = finish_segments(members)
    return rows if members.where("part > 0").isEmpty() else with_segment_bounds(rows)
