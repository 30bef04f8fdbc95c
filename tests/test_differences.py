"""Multiset comparison of results, against counters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathweave.operators import differences
from pathweave.operators.differences import as_positions, layout_agreement, layout_differences
from tests.helpers import START

SCHEMA = "traj_id string, lat double, lon double, timestamp timestamp_ntz"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(f"t{rng.randrange(5)}", 40 + rng.randrange(40) / 2000, 116 + rng.randrange(40) / 2000, START) for _ in range(n)]


def compared(spark, first, other):
    frames = {"first": spark.createDataFrame(first, SCHEMA), "other": spark.createDataFrame(other, SCHEMA)}
    found = layout_differences(frames).collect()
    return {(r.traj_id, r.lat, r.lon, r.timestamp): (r.n_first, r.n_other) for r in found}


def wanted(first, other):
    a, b = Counter(first), Counter(other)
    return {r: (a[r], b[r]) for r in a | b if a[r] != b[r]}


def test_changed_rows_are_named(spark):
    first = rows(400)
    assert compared(spark, first, first[::-1]) == {}
    changes = [
        first[1:],
        first + [first[3]] * 2,
        [(t, lat + 0.5 if n == 7 else lat, lon, at) for n, (t, lat, lon, at) in enumerate(first)],
        [(t, lat, lon, None if n == 9 else at) for n, (t, lat, lon, at) in enumerate(first)],
        [(None if n == 4 else t, lat, lon, at) for n, (t, lat, lon, at) in enumerate(first)],
        [(t, None if n == 5 else lat, lon, at) for n, (t, lat, lon, at) in enumerate(first)],
        first + [(None, None, None, None)] * 3,
        [],
        rows(400, seed=2),
    ]
    for other in changes:
        assert compared(spark, first, other) == wanted(first, other)
        assert compared(spark, other, first) == wanted(other, first)
    assert compared(spark, [], []) == {}


def test_nulls_are_told_apart_by_their_column(spark):
    """A hash passes over nulls, so which columns they stand in must count."""
    schema = "lat double, lon double, a string, b string"
    one = spark.createDataFrame([(1.0, 2.0, None, "x")], schema)
    two = spark.createDataFrame([(1.0, 2.0, "x", None)], schema)
    columns = ["lat", "lon", "a", "b"]
    assert [r.agrees for r in layout_agreement({"one": one, "two": two}, columns).collect()] == [True, False]
    assert layout_differences({"one": one, "two": two}, columns).count() == 2


def test_agreement_counts_copies(spark):
    first = rows(50)
    frames = {n: spark.createDataFrame(r, SCHEMA) for n, r in {"a": first, "turned": first[::-1], "twice": first[1:] + [first[1]], "none": []}.items()}
    found = {r.layout: (r.n_rows, r.agrees) for r in layout_agreement(frames).collect()}
    assert found == {"a": (50, True), "turned": (50, True), "twice": (50, first[0] == first[1]), "none": (0, False)}
    with pytest.raises(ValueError, match="no results"):
        layout_agreement({})


def test_equal_results_are_not_read_again(spark, monkeypatch):
    first = spark.createDataFrame(rows(100), SCHEMA)
    monkeypatch.setattr(differences, "differing_rows", lambda *a: pytest.fail("compared by rows"))
    found = layout_differences({"a": first, "b": first.repartition(5), "c": first.orderBy(F.desc("lat"))})
    assert found.columns == ["layout", "traj_id", "lat", "lon", "timestamp", "n_first", "n_other"]
    assert found.count() == 0


def test_only_differing_tiles_are_compared(spark):
    """The change lies in one tile; no row of another reaches the comparison."""
    first = [(f"t{n}", 40 + n / 100, 116.0, START) for n in range(200)]
    frames = [spark.createDataFrame(r, SCHEMA) for r in (first, first[:120] + first[121:])]
    tiles = differences.differing_tiles(*frames).collect()
    assert [(t.n_first, t.n_other) for t in tiles] == [(1, 0)]
    assert [r.traj_id for r in differences.differing_rows(*frames).collect()] == ["t120"]


def test_entities_are_trajectories(spark):
    found = as_positions(spark.createDataFrame(rows(3), SCHEMA).withColumnRenamed("traj_id", "entity_id").withColumn("more", F.lit(1)))
    assert found.columns == list(differences.POSITION_COLUMNS)
