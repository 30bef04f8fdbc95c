"""The quality classifier against plain loops and on held-out rows."""

import math
import re
import zlib

import numpy as np

from pathweave.llm import quality_classifier as quality
from tests.llm.helpers import awkward, frame, words


def plain_ngrams(text):
    """Places and shares by the definition, one n-gram at a time."""
    own = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text.lower())]
    first, second = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    place = lambda x: (x % 2**64) >> 46
    met = {}
    for h in own:
        met[place(h * first)] = met.get(place(h * first), 0) + 1
    for a, b in zip(own, own[1:]):
        p = 0 if a == b else place(a * first + b * second)
        met[p] = met.get(p, 0) + 1
    total = sum(met.values())
    return {p: 10 * c / total for p, c in met.items()}


def test_ngrams_of_whole_texts(monkeypatch):
    texts = ["", " \n", "one", "a a a b, b!! ### x", "Ünï “q” 12,5 " + "la " * 50, " ".join(words(900, 2, 50))]
    for size in (quality.PIECE_WORDS, 7):
        monkeypatch.setattr(quality, "PIECE_WORDS", size)
        for text in texts:
            places, values = quality.ngrams(text, quality._Hashes())
            want = plain_ngrams(text)
            assert places.tolist() == sorted(want) and np.allclose(values, [want[p] for p in sorted(want)])


def test_learner_follows_the_regularised_leader():
    """Each step against the closed form that minimises the sum of all slopes so far,
    the proximal terms and both penalties, found by plain search."""
    rng = np.random.default_rng(0)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.1
    learner = quality.FtrlLearner(alpha, beta, l1, l2)
    slopes, steps, at = [], [], np.array([3, 9])
    for n in range(6):
        x, label = rng.normal(size=2), int(rng.integers(2))
        w = learner.weights(at)
        for j in range(2):
            total = sum(g[j] for g in slopes)
            rates = [(math.sqrt(sum(g[j] ** 2 for g in slopes[: k + 1])) - math.sqrt(sum(g[j] ** 2 for g in slopes[:k]))) / alpha for k in range(len(slopes))]

            def cost(v, j=j, total=total, rates=rates):
                near = sum(r * (v - s[j]) ** 2 / 2 for r, s in zip(rates, steps))
                return total * v + near + l1 * abs(v) + (beta / alpha + l2) * v * v / 2

            grid = np.linspace(w[j] - 0.5, w[j] + 0.5, 20001)
            assert cost(w[j]) <= min(map(cost, grid)) + 1e-9
        p = learner.learn(at, x, label)
        assert math.isclose(p, 1 / (1 + math.exp(-float(w @ x))))
        slopes.append((p - label) * x)
        steps.append(w)


def test_scores_are_sparse_dot_products():
    model = quality.learn([(*quality.ngrams(f"good text {w}", quality._Hashes()), 1) for w in words(60, 1)] + [(*quality.ngrams(f"bad ### {w}", quality._Hashes()), 0) for w in words(60, 2)])
    for text in ("good text", "bad ###", "", "something else"):
        z = float(model.weights[quality.BIAS]) + sum(float(model.weights[p]) * v for p, v in plain_ngrams(text).items())
        assert math.isclose(model.score(text, quality._Hashes()), 1 / (1 + math.exp(-z)), rel_tol=1e-6)
    assert model.score("good text", quality._Hashes()) > 0.7 > model.score("bad ###", quality._Hashes())


def labelled(n=600):
    rows, labels = [], []
    for i in range(n):
        own = words(40, i, 2000)
        if i % 3 == 0:
            own = [w + ("###", "!!", "")[i % 9 // 3] for w in own] if i % 2 else [w for w in own[:8] for _ in range(5)]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 3 > 0)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled()
    table = spark.createDataFrame(labels + [(None, 1), (5, None), (10**6, 1), (4, 1), (7, 3)], "doc_id long, quality int")
    docs = frame(spark, rows + [(4, "another text of id 4"), rows[4]])
    model = quality.fit(docs, table)
    again = quality.fit(docs.repartition(7), table.repartition(3))
    assert (model.weights == again.weights).all()
    truth = dict(labels)
    more = awkward() + [(3000, "long " + " ".join(words(700_000, 8)))]
    got = quality.score(frame(spark, rows + more), model).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in got if r.held_out and 20 < r.doc_id < 3000]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    empty = {r.score for r in got if r.doc_id in (2, 3) and r.doc_id not in truth}
    assert len({r.score for r in quality.score(frame(spark, [(1, None), (2, ""), (3, " ")]), model).collect()} | empty) == 1
    assert quality.score(frame(spark, []), model).count() == 0


def test_held_out_labels_are_never_learned(spark):
    rows, labels = labelled()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    turned = [(i, 1 - q if held(i) else q) for i, q in labels]
    docs = frame(spark, rows)
    a, b = (quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.weights.any()


def test_nothing_to_learn_from(spark):
    rows, labels = labelled(30)
    docs = frame(spark, rows)
    for some in ([], [x for x in labels if x[1]]):
        model = quality.fit(docs, spark.createDataFrame(some, "doc_id long, quality int"))
        assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_sample_is_bounded(spark, monkeypatch):
    rows, labels = labelled(400)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality, "learn", lambda documents: taken.append([label for *_, label in documents]))
    quality.fit(frame(spark, rows), table, sample_docs=20)
    assert [taken[0].count(0), taken[0].count(1)] == [20, 20]
