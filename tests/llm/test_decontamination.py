"""Fingerprints and their extension against brute force, on repetitive texts."""

import random
import time

import numpy as np
import pytest

from pathweave.llm import decontamination
from pathweave.llm.decontamination import Block, blocks_of, merged, words_of


def looked_up(items, documents, span=13, gram=5):
    """(hit word places, items) of each document."""
    block = Block(items, span, gram)
    numbered = [np.array([block.numbers.get(w, 0) for w in words_of(d)], dtype=np.int64) for d in documents]
    return [({x for a, b in ranges for x in range(a, b)}, own) for ranges, own in block.hits(numbered)]


def by_windows(items, document, span):
    words, hit, own = words_of(document), set(), set()
    for item, text in items:
        theirs = words_of(text)
        n = min(span, len(theirs))
        windows = {tuple(theirs[a : a + n]) for a in range(len(theirs) - n + 1)} if n else set()
        for a in range(len(words) - n + 1):
            if tuple(words[a : a + n]) in windows:
                hit |= set(range(a, a + n))
                own.add(item)
    return hit, own


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
@pytest.mark.parametrize("span,gram", [(13, 5), (4, 2), (6, 3)])
def test_blocks_find_every_shared_window(letters, span, gram):
    rng = random.Random(letters * 100 + span)
    text = lambda: " ".join(rng.choices("abcdefgh"[:letters], k=rng.randrange(0, 60)))
    for _ in range(20):
        items = [(n // 2, text()) for n in range(rng.randrange(0, 8))]
        documents = [text() + (f" zz {rng.choice(items)[1]}" if items and n % 2 else "") for n in range(6)]
        assert looked_up(items, documents, span, gram) == [by_windows(items, d, span) for d in documents]


def test_pairs_are_compared_in_pieces(monkeypatch):
    monkeypatch.setattr(decontamination, "PAIRS", 3)
    rng = random.Random(5)
    items = [(n, " ".join(rng.choices("ab", k=40))) for n in range(6)]
    documents = [" ".join(rng.choices("ab", k=50)) for _ in range(5)]
    assert looked_up(items, documents) == [by_windows(items, d, 13) for d in documents]


def timed(items, document):
    block = Block(items)
    numbered = [np.array([block.numbers.get(w, 0) for w in words_of(document)], dtype=np.int64)]
    start = time.perf_counter()
    ((ranges, own),) = block.hits(numbered)
    return time.perf_counter() - start, sum(b - a for a, b in merged(ranges)), len(own)


def test_repetition_costs_little():
    """One repeated word, and one line that many items share."""
    spent, n_hit, n_items = timed([(1, "spam " * 4000)], "spam " * 4000)
    assert spent < 1 and (n_hit, n_items) == (4000, 1)
    line = " ".join(f"x{n}" for n in range(15))
    spent, n_hit, n_items = timed([(n, f"a{n} {line} c{n}") for n in range(1000)], " q ".join([line] * 20))
    assert spent < 1 and (n_hit, n_items) == (300, 1000)


def test_long_items_are_cut_and_lose_no_window(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(400)}" for _ in range(700)]
    items = [(1, " ".join(long)), (2, "w1 w2"), (3, None), (4, " , "), (None, "w9"), (5, " ".join(long[100:113]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    for size in (1, 13, 20, 100, 10**6):
        blocks = list(blocks_of(benchmark, block_words=size))
        assert all(sum(len(words_of(t)) for _, t in b) <= max(size, 13) for b in blocks)
        whole = {(i, tuple(words_of(t)[a : a + 13])) for b in blocks for i, t in b for a in range(max(len(words_of(t)) - 12, 1))}
        assert whole == {(1, tuple(w.encode() for w in long[a : a + 13])) for a in range(688)} | {(2, (b"w1", b"w2")), (5, tuple(w.encode() for w in long[100:113]))}
    # parts of the long item in documents, found in pieces as in the whole
    documents = [(n, " ".join(long[n * 60 : n * 60 + 14 + n])) for n in range(11)]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    for size in (40, 10**6):
        found = {r.doc_id: (r.n_hit, r.items) for r in decontamination.find_hits(docs, benchmark, block_words=size).collect()}
        for n, text in documents:
            hit, own = by_windows([(i, t) for i, t in items if i is not None], text, 13)
            assert found[n] == (len(hit), sorted(own))
