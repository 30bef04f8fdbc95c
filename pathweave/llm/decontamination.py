"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` neighbouring word ``GRAM``-grams the one with the smallest
hash is a fingerprint, in documents and items alike, so any shared run of ``SPAN`` words
shares one. Equal fingerprints are joined and extended to both sides as far as a window
of ``SPAN`` words around them reaches; extended runs of ``SPAN`` words or more are hits.
Every window of a longer run holds a fingerprint of its own, so nothing farther away has
to be looked at, and fingerprints with the same words around them are compared once, be
they of a thousand items or of a page of one repeated word. Items with fewer words count
as one window of all their words, which is looked up under its own length.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words. Tasks cut longer items
into pieces that overlap by a window less a word, so no block is larger; more blocks mean
more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.common import numbered_columns, slices, texts_of
from pathweave.session import stored_table

SPAN = 13
GRAM = 5
BLOCK_WORDS = 1_000_000
#: Pairs of words around fingerprints that are compared at once (21 words each).
PAIRS = 200_000
#: A document is contaminated if one word in so many is hit.
SHARE = 20

#: ASCII capitals become small letters; other ASCII that isn't a letter or a digit parts words.
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` ids, equal for equal runs."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def winnow(ids: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints: the last smallest hash of every window."""
    hashes = _hashes(ids, gram)
    width = span - gram + 1
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), hashes[:0]
    least, place = hashes[:n].copy(), np.arange(n)
    for k in range(1, width):
        later = hashes[k : k + n]
        closer = later <= least
        least = np.where(closer, later, least)
        place = np.where(closer, np.arange(k, k + n), place)
    chosen = np.zeros(len(hashes), dtype=bool)
    chosen[place] = True
    places = np.flatnonzero(chosen)
    return places, hashes[places]


def _unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, a place where each stands, and each row's number among them."""
    distinct, first, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return distinct, first, inverse.reshape(-1)


class Block:
    """Some of the benchmark, ready to be looked up.

    ``contexts`` holds the distinct surroundings of fingerprints, in the order of their
    hashes: as many words before and after the gram as a window can reach. Outside a
    text stands -1 in items and 0 in documents, which equals no word.
    """

    def __init__(self, items: list[tuple[int, str | None]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram, self.reach = span, gram, span - gram
        self.numbers: dict[bytes, int] = {}  # words of the block, from 1 on
        outside = np.full(span, -1, dtype=np.int32)
        texts, places, hashes, owners, end = [outside], [], [], [], span
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], dtype=np.int64)
            if len(ids) >= span:
                at, values = winnow(ids, span, gram)
                places.append(at + end)
                hashes.append(values)
                owners.append(np.full(len(at), item_id, dtype=np.int64))
                texts += [ids.astype(np.int32), outside]
                end += len(ids) + span
            elif len(ids):
                self.short[len(ids)][ids.tobytes()].append(item_id)
        self.short = {n: {words: sorted(set(ids)) for words, ids in x.items()} for n, x in self.short.items()}
        self.short_values = {n: np.array(sorted(int(_hashes(np.frombuffer(k, dtype=np.int64), n)[0]) for k in x), dtype=np.uint64) for n, x in self.short.items()}
        none = np.zeros(0, dtype=np.int64)
        distinct, first, inverse = _unique_rows(self._around(np.concatenate(texts), np.concatenate([none, *places])))
        values = np.concatenate([none.astype(np.uint64), *hashes])[first]
        order = np.argsort(values, kind="stable")
        self.contexts = distinct[order]
        self.values, self.starts = np.unique(values[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        held = np.unique(np.stack([rank[inverse], np.concatenate([none, *owners])], axis=1), axis=0)
        self.items, self.item_starts = held[:, 1].copy(), np.searchsorted(held[:, 0], np.arange(len(order) + 1))

    def _around(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The words around grams; ``words`` begins and ends with enough of outside."""
        width = 2 * self.reach + self.gram
        if not len(places):
            return np.zeros((0, width), dtype=words.dtype)
        return np.lib.stride_tricks.sliding_window_view(words, width)[places - self.reach]

    def hits(self, documents: list[np.ndarray]) -> Iterator[tuple[list[tuple[int, int]], set[int]]]:
        """For each document (as numbers of the block's words, 0 for others): its hit
        word ranges and the items with occurring windows."""
        # zeros around documents: no gram over a border can match
        gap = np.zeros(self.span, dtype=np.int64)
        joined = np.concatenate([gap, *(x for d in documents for x in (d, gap))])
        ends = np.cumsum([0, *(len(d) for d in documents)])
        starts = ends[:-1] + self.span * np.arange(1, len(documents) + 1)
        found: list[list] = [[] for _ in documents]
        items: list[set] = [set() for _ in documents]
        places, values = winnow(joined, self.span, self.gram)
        # a gram that holds a zero may begin outside a document or end there
        known = np.isin(values, self.values) & (joined[places] > 0) & (joined[places + self.gram - 1] > 0)
        places, values = places[known], values[known]
        owners = np.searchsorted(starts, places, side="right") - 1
        around, first, number = _unique_rows(self._around(joined.astype(np.int32), places))
        left, right, rows = self._extended(around, values[first])
        hit = np.flatnonzero(left[number] >= 0)
        for owner, a, n in zip(owners[hit].tolist(), (places - starts[owners])[hit].tolist(), number[hit].tolist()):
            found[owner].append((a - int(left[n]), a + self.gram + int(right[n])))
        for owner, n in set(zip(owners[hit].tolist(), number[hit].tolist())):
            for row in rows[n]:
                items[owner].update(self.items[self.item_starts[row] : self.item_starts[row + 1]].tolist())
        self._short_hits(joined, starts, found, items)
        return zip(found, items)

    def _extended(self, around: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """For each of the distinct surroundings in documents: how many words the runs
        it shares with the block's go on to the left and right at most (-1: no run of
        ``span`` words), and the contexts with such runs. All these runs hold the gram,
        so together they are one range."""
        slots = np.searchsorted(self.values, values)
        starts, sizes = self.starts[slots], self.ends[slots] - self.starts[slots]
        left = np.full(len(around), -1, dtype=np.int64)
        right = left.copy()
        rows: list[list[int]] = [[] for _ in range(len(around))]
        ends = np.cumsum(sizes)
        low = 0
        while low < len(around):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
            size = sizes[low:high]
            mine = np.repeat(np.arange(low, high), size)
            row = np.arange(len(mine)) - np.repeat(ends[low:high] - size - before, size) + np.repeat(starts[low:high], size)
            same = self.contexts[row] == around[mine]
            to_left = np.logical_and.accumulate(same[:, : self.reach][:, ::-1], axis=1).sum(axis=1)
            to_right = np.logical_and.accumulate(same[:, self.reach + self.gram :], axis=1).sum(axis=1)
            run = same[:, self.reach : self.reach + self.gram].all(axis=1) & (to_left + to_right + self.gram >= self.span)
            np.maximum.at(left, mine[run], to_left[run])
            np.maximum.at(right, mine[run], to_right[run])
            for n, context in zip(mine[run].tolist(), row[run].tolist()):
                rows[n].append(context)
            low = high
        return left, right, rows

    def _short_hits(self, joined: np.ndarray, starts: np.ndarray, found: list[list], items: list[set]) -> None:
        """Whole items of fewer than ``span`` words, by their length."""
        for n, windows in self.short.items():
            hashes = _hashes(joined, n)
            told = set()
            for place in np.flatnonzero(np.isin(hashes, self.short_values[n])).tolist():
                words = joined[place : place + n].tobytes()
                if words in windows:
                    owner = int(np.searchsorted(starts, place, side="right")) - 1
                    a = place - int(starts[owner])
                    found[owner].append((a, a + n))
                    if (owner, words) not in told:
                        told.add((owner, words))
                        items[owner].update(windows[words])


def _pieces(piece_words: int, span: int = SPAN):
    """Items as pieces of at most ``piece_words`` words, in tasks. Neighbouring pieces
    share ``span - 1`` words, so that every window lies in one of them whole."""
    step = max(piece_words - span + 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for at in range(0, max(len(words) - span + 1, min(len(words), 1)), step):
                    piece = words[at : at + step + span - 1]
                    rows.append((item_id, b" ".join(piece).decode(), len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "text", "words"])

    return run


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of ``block_words`` words at most (but a window at
    least). Only one block and one partition of pieces is on the driver at a time."""
    items = texts_of(benchmark, id_col, text_col).where("doc_id IS NOT NULL")
    pieces = items.mapInArrow(_pieces(max(block_words, SPAN)), "doc_id long, text string, words long")
    held, size = [], 0
    for row in pieces.toLocalIterator():
        if held and size + row.words > block_words:
            yield held
            held, size = [], 0
        held.append((row.doc_id, row.text))
        size += row.words
    if held:
        yield held


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Columns added beside those of the caller.
_RANGES, _ITEMS, _WORDS = "_hit_ranges", "_hit_items", "_hit_words"


def _searched(rows: DataFrame, benchmark: DataFrame, text_col: str, block_words: int) -> DataFrame:
    """``rows`` with merged hit word ranges (flat: start, end, ...), the items with
    windows in the text, and the number of words. One pass for each block; with more
    than one, what a pass has found is written before the next block is sent."""
    spark = rows.sparkSession
    longs = T.ArrayType(T.LongType())
    added = [T.StructField(_RANGES, longs), T.StructField(_ITEMS, longs), T.StructField(_WORDS, T.LongType())]
    empty = F.array().cast(longs)
    rows = rows.withColumns({_RANGES: empty, _ITEMS: empty, _WORDS: F.lit(0).cast("long")})
    schema = T.StructType([*rows.schema.fields[:-3], *added])
    blocks = blocks_of(benchmark, block_words=block_words)
    items, following = next(blocks, []), next(blocks, None)
    while True:
        rows = rows.mapInArrow(_search(spark.sparkContext.broadcast(Block(items)), text_col), schema)
        if following is None:
            return rows
        rows = stored_table(rows, "decontamination")
        items, following = following, next(blocks, None)


def _search(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        number = block.numbers.get
        for batch in slices(batches, text_col):
            documents = []
            for text in batch.column(text_col).to_pylist():
                words = words_of(text)
                documents.append(np.fromiter((number(w, 0) for w in words), dtype=np.int64, count=len(words)))
            ranges, items = [], []
            before = zip(batch.column(_RANGES).to_pylist(), batch.column(_ITEMS).to_pylist())
            for (flat, known), (found, own) in zip(before, block.hits(documents)):
                both = merged(list(zip(flat[::2], flat[1::2])) + found)
                ranges.append([x for pair in both for x in pair])
                items.append(sorted(own.union(known)))
            for name, values in ((_RANGES, ranges), (_ITEMS, items), (_WORDS, [len(d) for d in documents])):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, type=batch.schema.field(at).type))
            yield batch

    return run


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


#: The sum of all ends less the sum of all starts.
_N_HIT = f"aggregate({_RANGES}, 0L, (before, x) -> x - before)"


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, ranges and items of
    each row of ``docs``; ranges are hit word ranges as flat [start, end, ...].

    Null and empty texts have no words and no hits; items without words or id hit
    nothing; a null doc_id stays null; repeated rows give equal rows; other columns play
    no part; an empty benchmark gives rows without hits, no documents no rows.
    """
    found = _searched(texts_of(docs, id_col, text_col), benchmark, "text", block_words)
    listed = F.concat_ws(",", F.array_sort(F.transform(F.array_distinct(_ITEMS), lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        F.col(_WORDS).alias("n_words"),
        F.expr(_N_HIT).alias("n_hit"),
        F.size(_ITEMS).cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        F.col(_RANGES).alias("ranges"),
        F.col(_ITEMS).alias("items"),
    ).withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, which may
    have any names."""
    plain, text = numbered_columns(docs, text_col)
    found = _searched(plain, benchmark, text, block_words)
    return found.where(~_contaminated(F.expr(_N_HIT), F.col(_WORDS))).select(*plain.columns).toDF(*docs.columns)
