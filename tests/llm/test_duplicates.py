"""Suffix de-duplication and the Jaccard join against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathweave.llm import jaccard_join, suffix_dedup
from pathweave.llm.components import components
from tests.llm.helpers import awkward, blanks, frame, lower, ordered, rows_of, words


def cut(rows):
    """Brute force over rows (doc_id, text); rows without an id take no part."""
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            w = raw[i : i + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49 if d is not None else 0):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def shredded():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab \n") for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice([base[rng.randrange(6)][rng.randrange(200) :][: rng.randrange(20, 140)], "x" * rng.randrange(90), f"é{rng.randrange(99)}"]) for _ in range(rng.randrange(8))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("buckets, long", [(None, 1024), (1, 2), (40, 2)])
def test_suffixes(spark, monkeypatch, buckets, long):
    monkeypatch.setattr(suffix_dedup, "LONG_LIST", long)
    rows = awkward() + [(100 + d, t) for d, t in shredded()]
    found = suffix_dedup.find_repeats(frame(spark, rows), buckets=buckets)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut(rows)


def test_suffixes_of_nothing(spark):
    assert suffix_dedup.find_repeats(frame(spark, [])).count() == 0
    only = suffix_dedup.find_repeats(frame(spark, [(1, None), (2, "")]))
    assert rows_of(only, "doc_id", "n_bytes", "n_removed") == [(1, 0, 0), (2, 0, 0)]


def test_places_of_many_rows_are_read_at_once():
    """Ranges of a whole column of lists, some of them null, empty or long, and of a slice."""
    rng = random.Random(8)
    sizes = [0, 60, 5000, 300, 90, 700]
    full = [(2, p) for p in range(0, 4900, 97)] + [(5, p) for p in (0, 40, 650)]
    pairs = [(2, 4990, 5000), (3, 0, 50), (3, 50, 100), (3, 200, 250), (4, 0, 90)]
    found = {r: [] for r in range(6)}
    for r, p in full:
        found[r].append({"kind": suffix_dedup.FULL, "places": np.array([p], "<u4").tobytes()})
    for r, a, b in pairs:
        found[r].append({"kind": suffix_dedup.RANGES, "places": np.array([a, b], "<u4").tobytes()})
    for one in found.values():
        rng.shuffle(one)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("places", pa.binary())]))
    column = pa.array([None if r == 1 else found[r] for r in range(6)], kind)
    gone = [bytearray(n) for n in sizes]
    for r, p in full:
        a, b = max(p - suffix_dedup.REACH, 0), min(p + suffix_dedup.SPAN, sizes[r])
        gone[r][a:b] = b"\1" * (b - a)
    for r, a, b in pairs:
        gone[r][a:b] = b"\1" * (b - a)
    for first in (0, 3):
        got = [bytearray(n) for n in sizes]
        row, begin, end = suffix_dedup.removed_ranges(np.array(sizes[first:]), *suffix_dedup._pieces(column[first:]))
        for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist()):
            assert not any(got[first + r][max(a - 1, 0) : b])
            got[first + r][a:b] = b"\1" * (b - a)
        assert got[first:] == gone[first:]



def linked(rows, size, threshold):
    sets = []
    for _, t in rows:
        own = blanks(lower(t))
        sets.append({tuple(own[i : i + size]) for i in range(len(own) - size + 1)} or ({tuple(own)} if own else set()))
    low = {d: d for d, _ in rows}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    lists = {}
    for n, own in enumerate(sets):
        if rows[n][0] is None:
            continue
        for m, c in Counter(m for g in own for m in lists.get(g, ())).items():
            if 100 * c >= threshold * (len(own) + len(sets[m]) - c):
                a, b = sorted((find(rows[n][0]), find(rows[m][0])))
                low[b] = a
        for g in own:
            lists.setdefault(g, []).append(n)
    return ordered([(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)])


def near_copies():
    """Chains of near copies, a passage in many texts, and texts of nothing else."""
    rng = random.Random(5)
    rows, passage = [], words(60, 77)
    for family in range(6):
        text = words(rng.choice([3, 5, 40, 300]), family)
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = f"new{rng.randrange(9)}"
            text += words(rng.randrange(3), rng.random())
    for i in range(25):
        rows.append((len(rows), " ".join(words(40, 100 + i) + passage + words(30, 200 + i))))
        rows.append((len(rows), " ".join(passage[: 40 + i])))
    return rows


@pytest.mark.parametrize("size, threshold, common, rounds, gain", [(4, 85, 65536, 4, 16), (5, 80, 4, 1, 0), (4, 85, 4, 4, 0)])
def test_links(spark, monkeypatch, size, threshold, common, rounds, gain):
    for name, value in (("COMMON", common), ("STAR_ROUNDS", rounds), ("STAR_GAIN", gain), ("BLOCK", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies()
    found = jaccard_join.link(frame(spark, rows), size, threshold)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == linked(rows, size, threshold)


def test_links_of_awkward_rows(spark):
    rows = awkward()
    found = jaccard_join.link(frame(spark, rows))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == linked(rows, 4, 85)
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 8, None, 10, 12}
    assert jaccard_join.link(frame(spark, [])).count() == 0


def test_links_of_a_text_met_first_without_an_id(spark):
    text = words(40, 9)
    near = [*text[:-1], "other"]
    rows = [(None, " ".join(text)), (1, " ".join(text)), (2, " ".join(near)), (3, " ".join(text)), (None, " ".join(near))]
    one_task = frame(spark, rows).coalesce(1)
    assert rows_of(jaccard_join.link(one_task), "doc_id", "n_shingles", "component_id") == linked(rows, 4, 85)
    assert rows_of(jaccard_join.keep_one(one_task), "doc_id") == [(None,), (None,), (1,)]


def several_texts():
    """Threes of ids, one of them with two texts: one near the text of the second id, one
    near that of the third. All share the rarest words, so that any may be the centre."""
    rng, rows = random.Random(8), []
    for group in range(12):
        own = [f"g{group}n{k}" for k in range(60)]
        own.sort(key=lambda w: jaccard_join.shingle_sets([w], 1)[0][0])
        rare, one, other, ids = own[:4], own[4:20], own[20:36], rng.sample(range(1000 * group, 1000 * group + 1000), 3)
        texts = [(0, one), (1, other), (2, [*one[1:], own[40]]), (2, [*other[1:], own[41]])]
        rows += [(ids[n], " ".join(rare + rest)) for n, rest in texts]
    return rows


def test_links_of_ids_with_several_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 0)
    rows = several_texts()
    found = jaccard_join.link(frame(spark, rows), 1, 85)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == linked(rows, 1, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (103, 101), (101, 100)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert rows_of(found, "node", "component") == [*((i, 0) for i in range(41)), (100, 100), (101, 100), (103, 100)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert found.select(F.max("node")).first()[0] == 103


def test_outlines_bound_what_two_sets_share():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n, m, both = (int(x) for x in rng.integers(1, 900, size=3))
        own = rng.integers(0, 2**64, size=n + m + both, dtype=np.uint64)
        if rng.random() < 0.2:
            own >>= np.uint64(50)
        x, y = np.unique(own[: n + both]), np.unique(own[n:])
        common = len(np.intersect1d(x, y))
        bound = jaccard_join.most_common(len(x), jaccard_join.outline(x), len(y), jaccard_join.outline(y))
        assert common <= bound <= min(len(x), len(y))
    same = np.arange(400, dtype=np.uint64)
    assert jaccard_join.outline(same) == b"" and jaccard_join.most_common(400, b"", 300, b"x" * 16) == 300
    # apart sets of equal size are told apart
    x, y = (np.unique(rng.integers(0, 2**64, size=500, dtype=np.uint64)) for _ in range(2))
    assert jaccard_join.most_common(500, jaccard_join.outline(x), 500, jaccard_join.outline(y)) < 0.6 * 500


def test_pairs_left_open_within_blocks():
    """No pair that links is ruled out, pairs far apart are; equal parts never meet."""
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (40, 90, 3000)]
    sets = []
    for k in range(45):
        own = base[k % 3].copy()
        own[rng.random(len(own)) < 0.02 * (k % 9)] = rng.integers(0, 2**64, dtype=np.uint64)
        sets.append(np.unique(own))
    sets.append(np.arange(400, dtype=np.uint64))  # more than 255 in one place of a sketch
    sets.append(np.arange(30, 400, dtype=np.uint64))

    def block(places):
        rows = [
            {"node": k, "n": len(sets[k]), "place": 0, "beside": len(sets[k]), "shared": len(sets[k]), "part": k // 2, "sketch": None if k == 4 else jaccard_join.sketch(sets[k])}
            for k in places
        ]
        return jaccard_join._Block(pa.array(rows))

    halves = [list(range(0, len(sets), 2)), list(range(1, len(sets), 2))]
    left, right = map(block, halves)
    found = set()
    for one, other in ((left, left), (left, right), (right, right)):
        x, y = jaccard_join.open_pairs(one, other, one is other, 85)
        pairs = [tuple(sorted(p)) for p in zip(one.node[x].tolist(), other.node[y].tolist())]
        assert len(pairs) == len(set(pairs))
        found |= set(pairs)
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if a // 2 != b // 2 and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    assert want and want <= found
    assert all(a // 2 != b // 2 for a, b in found) and len(found) < 2 * len(want) + len(sets)
