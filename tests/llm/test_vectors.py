"""Hard negatives and vector codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.llm import code_compression, hard_negatives
from tests.llm.helpers import ordered, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank string, _row string, code string, error string, vector string, tree int"
CLASH = (1, "r", "row", "c", "e", "v", 2)


def frame(spark, rows):
    """(vec_id, vector, label) rows with columns whose names operators use."""
    return spark.createDataFrame([(i, v, label, *CLASH) for i, v, label in rows], SCHEMA)


def made(n, width=8, seed=0, labels=3):
    """Vectors around a few middles, with exact copies, ties and every awkward row."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, width))
    rows = []
    for i in range(n):
        v = middles[i % 4] + rng.normal(size=width) * 0.3
        rows.append((i, np.float32(np.round(v * 8) / 8).tolist(), int(rng.integers(labels))))
    same = rows[5][1]
    rows += [(n + i, same, i % labels) for i in range(n // 3)]
    rows += [(0, rows[0][1], 1), (0, rows[0][1], 1), (50, rows[7][1], 2), (50, None, 1), (n + 500, rows[3][1], None), (None, rows[3][1], 0)]
    bad = [float("nan"), float("inf"), float("-inf"), None]
    rows += [(n + 600 + i, [x] + rows[1][1][1:], 0) for i, x in enumerate(bad)]
    return rows + [(n + 700, rows[2][1][:5], 1), (n + 701, [], 2), (-7, rows[9][1], 1)]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(rows, scale, width):
    return [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v)), label) for i, v, label in rows if fine(v)]


def brute_negatives(rows, is_anchor):
    rows = [r for r in padded(rows, 256, 8) if r[0] is not None and r[2] is not None]
    out = []
    for a, (anchor, v, label) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lab) for b, (i, w, lab) in enumerate(rows) if b != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted((s, i) for s, i, lab in scored if lab != label and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out += [(anchor, pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(fit)]
    return ordered(out)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives(spark, seed):
    rows = made(150, seed=seed)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    df = frame(spark, rows).repartition(5)
    assert len(want) > 100
    assert rows_of(hard_negatives.mine(df, F.col("vec_id") % 10 == 0), *MINED) == want
    # small blocks, each with a pass of its own
    assert rows_of(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block_bytes=1000), *MINED) == want


def test_hard_negatives_of_nothing(spark):
    rows = made(30)
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, rows), F.lit(False)).count() == 0
    alone = hard_negatives.mine(frame(spark, [(0, [1.0], 1), (1, [2.0], 1)]), F.col("vec_id") == 0)
    assert alone.count() == 0 and alone.columns == list(MINED)


def test_hard_negatives_of_whole_numbers_beyond_doubles(spark):
    rows = [(i, [random.Random(i).uniform(-1, 1) * 2**20 for _ in range(3)], i % 2) for i in range(40)]
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    ours = [(i, v, label) for i, v, label in rows]
    want = brute_negatives([(i, v, label) for i, v, label in ours], lambda i: i % 5 == 0)
    assert rows_of(hard_negatives.mine(frame(spark, ours), F.col("vec_id") % 5 == 0), *MINED) == want
    with pytest.raises(ValueError, match="64-bit"):
        hard_negatives.mine(frame(spark, [(0, [1e30], 0)]), F.col("vec_id") == 0)


def test_spanning_tree_bounds_and_length():
    rng = np.random.default_rng(3)
    points = rng.integers(-200, 200, size=(60, 6))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(60)) and parent[0] == -1
    assert all(0 <= p < i for i, p in enumerate(parent.tolist()) if i)
    assert np.allclose(edge[1:], [np.linalg.norm(points[order[i]] - points[order[parent[i]]]) for i in range(1, 60)])
    # as long in all as Kruskal's tree
    pairs = sorted((np.linalg.norm(points[a] - points[b]), a, b) for a in range(60) for b in range(a))
    root, total = list(range(60)), 0.0
    for d, a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[a], total = b, total + d
    assert np.isclose(edge.sum(), total)


def test_bounds_spare_candidates():
    """Anchors and candidates in far clusters: few pairs are scored, none is missed."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 16)) * 2000
    anchors = np.rint(middles[np.arange(48) % 6] + rng.normal(size=(48, 16)) * 5).astype(np.int64)
    seen = np.rint(middles[0] + rng.normal(size=(500, 16)) * 5).astype(np.int64)
    order, parents, edges = hard_negatives.spanning_tree(anchors)
    whole = anchors[order]
    packed = {"rows": np.arange(48), "ids": np.arange(48), "labels": np.zeros(48, dtype=np.int64), "parents": parents, "vectors": whole}
    tree = hard_negatives.Tree({k: v.astype(np.int64).tobytes() for k, v in packed.items()} | {"edges": edges.tobytes()}, 16, np.float64)

    class Seen:
        rows, vectors = np.arange(500), seen.astype(float)
        middle = seen.mean(axis=0)
        norms = np.linalg.norm(seen - seen.mean(axis=0), axis=1)

    truth = whole @ seen.T
    floor = int(np.percentile(truth, 90))
    count = 0

    def asked(level, low, high):
        assert (low <= truth[level] + 1e-6).all() and (truth[level] <= high + 1e-6).all()
        return high >= floor

    for at, chosen, values in tree.scores(Seen, asked):
        assert (values == truth[at, chosen]).all()
        left = np.setdiff1d(np.arange(500), chosen)
        assert (truth[at, left] < floor).all()
        count += len(chosen)
    assert count < 0.5 * truth.size


def brute_codes(rows, width):
    own = sorted(padded(rows, 1024, width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = width // 4
    cut = [[tuple(v[p * part : (p + 1) * part]) for p in range(4)] for _, v, _ in own]
    books = [[c[p] for c in cut[:256]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            met = {}
            for c in cut:
                met.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for n, xs in met.items():
                books[p][n] = tuple(sum(x[i] for x in xs) // len(xs) for i in range(part))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(4)] for c in cut]
    by_label = {}
    for (_, _, label), f in zip(own, found):
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in f)
    return ordered(
        (i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), by_label[label], digest) for (i, _, label), f in zip(own, found)
    )


CODED = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_code_compression(spark, monkeypatch):
    rows = made(400, seed=2)
    want = brute_codes(rows, 8)
    assert rows_of(code_compression.compress(frame(spark, rows).repartition(3)), *CODED) == want
    monkeypatch.setattr(code_compression, "BLOCK_ROWS", 37)
    monkeypatch.setattr(code_compression, "AT_ONCE", 10)
    assert rows_of(code_compression.compress(frame(spark, rows)), *CODED) == want


def test_codes_of_few_and_odd_vectors(spark):
    few = [(3, [0.5, -0.25, 1.0, 0.0, 2.0], 1), (3, [0.5, -0.25], 1), (None, [0.0, 0.0, 0.0], None), (9, [], None), (7, [-1e4] * 5, 2)]
    assert rows_of(code_compression.compress(frame(spark, few)), *CODED) == brute_codes(few, 8)
    assert code_compression.compress(frame(spark, [])).count() == 0
    assert code_compression.compress(frame(spark, [(1, None, 1)])).columns == list(CODED)
    with pytest.raises(ValueError, match="64-bit"):
        code_compression.compress(frame(spark, [(0, [1e30], 0)]))


def test_codes_stand_for_near_vectors(spark):
    rows = [r for r in made(300, seed=5) if fine(r[1]) and len(r[1]) == 8 and r[0] is not None]
    blocks = code_compression.to_blocks(frame(spark, rows))
    books = code_compression.fit(blocks)
    known = {}
    for r in code_compression.encode(blocks, books).collect():
        known.setdefault(r.vec_id, []).append((books.decode(r.code), r.error))
    for i, v, _ in padded(rows, 1024, 8):
        assert any(((np.array(v) - w) ** 2).sum() == error for w, error in known[i])
