"""Proven rows of approximate answers against exact ones."""

import random

import pytest

from pathweave.operators.certificate import proven_knn_fixed_index, proven_knn_grid_index
from pathweave.operators.extent import point_extent
from pathweave.operators.index import fixed_index, grid_index
from pathweave.operators.segmentation import fixed_segments, grid_segments
from tests.helpers import nearest, points


def tracks():
    rng = random.Random(6)
    out = {}
    for t in range(12):
        lat, lon, track = 40 + rng.uniform(0, 0.02), 116 + rng.uniform(0, 0.02), []
        for _ in range(120):
            lat, lon = lat + rng.uniform(-2e-4, 2e-4), lon + rng.uniform(-2e-4, 2e-4)
            track.append((lat, lon))
        out[f"t{t:02}"] = track
    return out


@pytest.mark.parametrize("kind", ["fixed", "grid"])
def test_proven_rows_are_the_exact_ones(spark, kind):
    own = tracks()
    rows = points(spark, own)
    if kind == "fixed":
        index, ask = fixed_index(fixed_segments(rows, 25)).cache(), lambda p, k: proven_knn_fixed_index(index, p, k)
    else:
        index = grid_index(grid_segments(rows, point_extent(rows), 0.001)).cache()
        ask = lambda p, k: proven_knn_grid_index(index, p, k)
    every = [(t, *p) for t, track in own.items() for p in track]
    proven = unproven = 0
    for at in [own["t00"][60], own["t05"][10], (40.01, 116.01), (40.3, 116.3)]:
        at = (at[0] + 1e-6, at[1] - 2e-6)
        found = ask(at, 8).orderBy("distance").collect()
        flags = [r.proven for r in found]
        assert flags == sorted(flags, reverse=True)
        n = sum(flags)
        assert [(r.traj_id, r.lat, r.lon) for r in found[:n]] == nearest(every, at, 8)[:n]
        proven, unproven = proven + n, unproven + len(found) - n
    assert proven > 0 and (kind == "grid" or unproven > 0)
    index.unpersist()


def test_nothing_skipped_proves_all_and_nothing_found_stays_empty(spark):
    rows = points(spark, {"a": [(40 + i * 1e-5, 116 + i * 1e-5) for i in range(20)]})
    index = fixed_index(fixed_segments(rows, 25))
    assert [r.proven for r in proven_knn_fixed_index(index, (40.0001, 116.0001), 5).collect()] == [True] * 5
    assert proven_knn_fixed_index(index, (50.0, 10.0), 5).count() == 0
    assert proven_knn_fixed_index(index.limit(0), (40.0, 116.0), 5).count() == 0
