"""Hard negatives by bounds along spanning trees of anchors.

Anchors are put into groups of near ones, and each group into a spanning tree of short
edges. A candidate's score with the root is computed; along an edge of length d a score
changes by at most d times the candidate's norm, so a parent's score bounds its
children's. Only candidates whose bounds overlap what an anchor still asks for are scored
again. Norms are taken from the middle of a batch of candidates, whose own part of the
change is known exactly, which makes the bounds narrower where candidates lie together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import batch_of, stage_table
from pathweave.llm.vectors import exact_type, matrix, shape, usable, whole

#: Anchors of a tree, candidates met by a tree at once.
TREE, AT_ONCE = 256, 2048
#: Most bytes of anchors sent to the tasks at once; each such block reads all rows.
BLOCK_BYTES = 32 << 20
#: Above this share of open (anchor, candidate) pairs of a level, all its anchors are
#: scored with the candidates that any of them has open, else pair by pair.
DENSE = 0.05

_TREE_DDL = "tree long, n_bytes long, rows binary, ids binary, labels binary, parents binary, edges binary, vectors binary"
_TREE = pa.schema([("tree", pa.int64()), ("n_bytes", pa.int64()), *((n, pa.binary()) for n in ("rows", "ids", "labels", "parents", "edges", "vectors"))])


def clean(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """``_row, vec_id, label, vector`` of the rows that take part: a label, an id to
    name them by, and a vector without null or non-finite components, of which
    floor(scale * x) is kept. ``_row`` tells rows of equal ids apart. Stored."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    return stage_table(rows.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "label", whole(F.col("vector"), scale).alias("vector")), "vectors")


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows in an order in which a parent, given by its place in
    that order, comes first; the lengths of the edges; the root has parent -1. A
    minimum spanning tree by Prim's method, started at the row nearest the middle."""
    points = vectors.astype(np.float64)
    n = len(points)
    squares = (points**2).sum(axis=1)
    middle = points.mean(axis=0)
    root = int(((points - middle) ** 2).sum(axis=1).argmin())
    order, parent, edge = [root], [-1], [0.0]
    reach = np.full(n, np.inf)
    via = np.zeros(n, dtype=np.int64)
    done = np.zeros(n, dtype=bool)
    done[root], last = True, root
    for _ in range(n - 1):
        away = squares + squares[last] - 2 * (points @ points[last])
        nearer = away < reach
        reach[nearer], via[nearer] = away[nearer], len(order) - 1
        last = int(np.where(done, np.inf, reach).argmin())
        done[last] = True
        parent.append(int(via[last]))
        edge.append(float(np.sqrt(((points[last] - points[order[via[last]]]) ** 2).sum())))
        order.append(last)
    return np.array(order), np.array(parent), np.array(edge)


def _levels(parents: np.ndarray) -> list[np.ndarray]:
    """Places in the tree's order by their distance from the root."""
    depth = np.zeros(len(parents), dtype=np.int64)
    for at in range(1, len(parents)):
        depth[at] = depth[parents[at]] + 1
    return [np.flatnonzero(depth == d) for d in range(depth.max() + 1)] if len(parents) else []


def plant_trees(rows: DataFrame, anchors: Column, width: int) -> DataFrame:
    """A stored row for each tree of up to ``TREE`` anchors, near ones together: they
    are range-partitioned by label and the first component, equal ones by row."""
    picked = rows.where(anchors).select("_row", "vec_id", "label", "vector")
    keys = ["label", F.try_element_at("vector", F.lit(1)), "_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                piece = batch.slice(at, TREE)
                if count + piece.num_rows > TREE:
                    yield _tree(held, width)
                    held, count = [], 0
                held.append(piece)
                count += piece.num_rows
        if held:
            yield _tree(held, width)

    ranged = picked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    planted = stage_table(ranged.mapInArrow(run, _TREE_DDL), "anchor-trees")
    return stage_table(planted.withColumn("tree", F.monotonically_increasing_id()), "numbered-trees")


def _tree(held: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    vectors = matrix(table.column("vector").combine_chunks(), width).astype(np.int64)
    order, parents, edges = spanning_tree(vectors)
    own = {n: table.column(c).to_numpy()[order].astype(np.int64).tobytes() for n, c in (("rows", "_row"), ("ids", "vec_id"), ("labels", "label"))}
    packed = {**own, "parents": parents.astype(np.int64).tobytes(), "edges": edges.tobytes(), "vectors": vectors[order].tobytes()}
    return batch_of(_TREE, tree=[0], n_bytes=[sum(map(len, packed.values()))], **{k: [v] for k, v in packed.items()})


def blocks_of(trees: DataFrame, limit: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Ranges (first, last) of tree numbers that hold about ``limit`` bytes each. Two
    numbers a tree, not the anchors, come to the driver for this."""
    out: list[list[int]] = []
    held = 0
    for row in trees.select("tree", "n_bytes").orderBy("tree").toLocalIterator():
        if not out or held + row["n_bytes"] > limit:
            out.append([row["tree"], row["tree"]])
            held = 0
        out[-1][1] = row["tree"]
        held += row["n_bytes"]
    return [(a, b) for a, b in out]


class Tree:
    """A group of anchors as tasks use it."""

    def __init__(self, packed: dict[str, bytes], width: int, exact: type):
        self.rows, self.ids, self.labels, self.parents = (np.frombuffer(packed[c], dtype=np.int64) for c in ("rows", "ids", "labels", "parents"))
        self.edges = np.frombuffer(packed["edges"], dtype=np.float64)
        self.vectors = np.frombuffer(packed["vectors"], dtype=np.int64).reshape(len(self.rows), width).astype(exact)
        self.levels = _levels(self.parents)

    def scores(self, batch: Batch, asked) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor's place, candidates, exact scores), candidates in the batch's order.

        ``asked(level, low, high)`` tells which candidates an anchor of the level may
        still take, given bounds of their scores. What it leaves out is never scored:
        their bounds go on to the anchor's children, widened by the edge.
        """
        n = len(batch.rows)
        low, high = np.zeros((len(self.rows), n)), np.zeros((len(self.rows), n))
        for depth, level in enumerate(self.levels):
            own = self.vectors[level]
            if depth == 0:
                open_ = np.ones((1, n), dtype=bool)
                wanted = None
            else:
                parents = self.parents[level]
                step = (own - self.vectors[parents]).astype(np.float64) @ batch.middle
                far = self.edges[level][:, None] * batch.norms[None, :] * (1 + 1e-9)
                # and a hair for what doubles round
                far += 1 + 1e-12 * (np.abs(low[parents]) + np.abs(high[parents]) + np.abs(step)[:, None])
                low[level] = low[parents] + step[:, None] - far
                high[level] = high[parents] + step[:, None] + far
                wanted = open_ = asked(level, low[level], high[level])
            share = open_.mean() if open_.size else 0.0
            if share > DENSE:
                columns = np.flatnonzero(open_.any(axis=0))
                found = own @ batch.vectors[columns].T
            for k, at in enumerate(level):
                chosen = np.flatnonzero(open_[k])
                if not len(chosen):
                    continue
                if share <= DENSE:
                    values = batch.vectors[chosen] @ own[k]
                elif len(chosen) == len(columns):
                    values = found[k]
                else:
                    values = found[k][np.searchsorted(columns, chosen)]
                low[at, chosen] = high[at, chosen] = values
                if wanted is None:
                    keep = asked(level, low[level], high[level])[0]
                    chosen, values = chosen[keep], values[keep]
                yield int(at), chosen, values


class Batch:
    """Candidates in the order of their ids, so that the first of equal scores wins."""

    def __init__(self, batch: pa.RecordBatch, width: int, exact: type):
        ids = batch.column("vec_id").to_numpy()
        order = np.lexsort((batch.column("_row").to_numpy(), ids))
        self.ids, self.rows = ids[order], batch.column("_row").to_numpy()[order]
        self.labels = batch.column("label").to_numpy()[order]
        self.vectors = matrix(batch.column("vector"), width)[order].astype(exact)
        floats = self.vectors.astype(np.float64)
        self.middle = floats.mean(axis=0)
        self.norms = np.sqrt(((floats - self.middle) ** 2).sum(axis=1))


class Best:
    """The first k of (score, id, row) met so far in each slot: higher scores, then
    smaller ids and rows."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.held = [np.zeros((0, 3), dtype=np.int64) for _ in range(slots)]
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def offer(self, slot: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates in the order of their ids."""
        first = np.argsort(-scores, kind="stable")[: self.k]
        more = np.stack([scores[first].astype(np.int64), ids[first], rows[first]], axis=1)
        both = np.concatenate([self.held[slot], more])
        both = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.k]]
        self.held[slot] = both
        if len(both) == self.k:
            self.least[slot] = both[-1, 0]


_FOUND_DDL = "anchor_row long, anchor_id long, rank int, score long, vec_id long, _row long"
_FOUND = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("rank", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("_row", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch], width: int, exact: type) -> Iterator[Batch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield Batch(batch.slice(at, AT_ONCE), width, exact)


def _emit(trees: list[Tree], best: list[Best], slots: int) -> Iterator[pa.RecordBatch]:
    """What each task has found, a few rows for each anchor and slot."""
    for tree, own in zip(trees, best):
        at = np.repeat(np.arange(len(own.held)), [len(h) for h in own.held])
        found = np.concatenate(own.held) if own.held else np.zeros((0, 3), dtype=np.int64)
        if len(at):
            yield batch_of(_FOUND, anchor_row=tree.rows[at // slots], anchor_id=tree.ids[at // slots], rank=at % slots + 1, score=found[:, 0], vec_id=found[:, 1], _row=found[:, 2])


def _search_positives(rows: DataFrame, shared, width: int, exact: type, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(t, width, exact) for t in shared.value[0]]
        best = [Best(len(t.rows), k) for t in trees]
        for batch in _pieces(batches, width, exact):
            for tree, own in zip(trees, best):

                def asked(level: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    same = tree.labels[level][:, None] == batch.labels[None, :]
                    return same & (high >= own.least[level][:, None])

                for at, chosen, values in tree.scores(batch, asked):
                    fit = (values >= own.least[at]) & (batch.rows[chosen] != tree.rows[at])
                    if fit.any():
                        taken = chosen[fit]
                        own.offer(at, values[fit], batch.ids[taken], batch.rows[taken])
        yield from _emit(trees, best, 1)

    return rows.mapInArrow(run, _FOUND_DDL)


def _search_negatives(rows: DataFrame, shared, width: int, exact: type, positives: int, k: int, low_pct: int, high_pct: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, scores = shared.value
        trees = [Tree(t, width, exact) for t in packed]
        best = [Best(len(t.rows) * positives, k) for t in trees]
        windows = []
        for tree in trees:
            of = np.array([[s if s is not None else -1 for s in scores.get(int(r), [None] * positives)] for r in tree.rows], dtype=np.int64)
            # whole scores s with low_pct * p <= 100 * s <= high_pct * p; none below zero
            low = np.array([[-((-low_pct * int(p)) // 100) for p in line] for line in of], dtype=np.int64)
            high = np.array([[(high_pct * int(p)) // 100 for p in line] for line in of], dtype=np.int64)
            windows.append((np.where(of < 0, 1, low).reshape(-1, positives), np.where(of < 0, 0, high).reshape(-1, positives)))
        for batch in _pieces(batches, width, exact):
            for tree, own, (low_end, high_end) in zip(trees, best, windows):
                least = own.least.reshape(-1, positives)

                def asked(level: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    # from the lowest score that any of the positives still asks for
                    none = high_end[level] < low_end[level]
                    floor = np.where(none, np.iinfo(np.int64).max, np.maximum(low_end[level], least[level])).min(axis=1)
                    roof = high_end[level].max(axis=1)
                    other = tree.labels[level][:, None] != batch.labels[None, :]
                    return other & (high >= floor[:, None]) & (low <= roof[:, None])

                for at, chosen, values in tree.scores(batch, asked):
                    for p in range(positives):
                        fit = (values <= high_end[at, p]) & (values >= max(low_end[at, p], least[at, p]))
                        if fit.any():
                            taken = chosen[fit]
                            own.offer(at * positives + p, values[fit], batch.ids[taken], batch.rows[taken])
        yield from _emit(trees, best, positives)

    return rows.mapInArrow(run, _FOUND_DDL)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of what all tasks have found; each sent k rows for a key at most."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "_row")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_pct: int = 50,
    high_pct: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says by the column ``vec_id`` which rows are anchors. Anchors go to the
    tasks in blocks of ``block_bytes``, one after the other, and each block meets all
    rows: the best rows of a label first, then the best of other labels between
    ``low_pct`` and ``high_pct`` hundredths of each positive's score.

    Rows without a label, an id or a vector, or with a null or non-finite component,
    take no part. Repeated rows and ids are rows of their own: an anchor's copy is one
    of its positives, and equal scores go by id. Vectors of several lengths count as
    filled up with zeros. A positive with a negative score has an empty window.
    Anchors without positives or negatives give no rows, an empty table gives none.
    Scores that could exceed a 64-bit number make the call fail and say so. Columns
    beside the named ones play no part.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, scale, id_col, vector_col, label)
    size = shape(rows, "vector")
    exact = exact_type(size.largest**2 * max(size.width, 1), "scores")
    trees = plant_trees(rows, anchor, size.width)
    nearest, mined = [], []
    for first, last in blocks_of(trees, block_bytes):
        packed = trees.where(F.col("tree").between(first, last)).drop("tree", "n_bytes").toArrow().to_pylist()
        shared = spark.sparkContext.broadcast((packed, None))
        found = stage_table(_search_positives(rows, shared, size.width, exact, positives), "near-rows")
        shared.destroy()
        best = stage_table(_first(found, ["anchor_row"], positives).withColumn("rank", F.col("_n")).drop("_n"), "positives")
        scores: dict[int, list[int | None]] = {}
        # a few numbers for each anchor of the block
        for row in best.select("anchor_row", "rank", "score").toLocalIterator():
            scores.setdefault(row[0], [None] * positives)[row[1] - 1] = row[2]
        shared = spark.sparkContext.broadcast((packed, scores))
        mined.append(stage_table(_search_negatives(rows, shared, size.width, exact, positives, negatives, low_pct, high_pct), "negatives"))
        shared.destroy()
        nearest.append(best)
    if not nearest:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    best, found = nearest[0], mined[0]
    for more, others in zip(nearest[1:], mined[1:]):
        best, found = best.unionByName(more), found.unionByName(others)
    chosen = _first(found, ["anchor_row", "rank"], negatives)
    known = best.select("anchor_row", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(known, ["anchor_row", "rank"]).select(
        "anchor_id", "positive_id", F.col("_n").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
