"""N-gram Jaccard self-join by prefix lists with set-relation skipping.

A document is the set of its word shingles. In one order of all shingles (common ones
last) two sets that link share a shingle in their first few, their *prefixes*. So every
shingle of a prefix has a list of sets, and only sets of one list are compared.

* Equal sets are one entry, whatever the number of copies.
* In each list all sets are first compared with one of them, its centre. What links
  with the centre takes over the centre's answers: it is in the same component, and
  only lists that still hold several components are looked at again.
* Such lists are cut into blocks by distance from the centre; blocks carry the ranges
  of sizes and positions of their sets, so pairs of blocks that can't link are skipped
  whole. A pair of blocks is one row; which pairs of their sets are left open is found
  in the task, by sizes, positions, the centre and sketches of the sets.
* Of what is left, an overlap with a set near a centre follows within bounds from the
  centre's own overlap and the difference between the two; only pairs that the bounds
  leave open are looked at.
* A set has an outline, the counts of its shingles in about as many buckets as it has
  shingles. Where two outlines differ in d places, at least d shingles are in one set
  only; texts are compared of the pairs alone whose outlines leave room for a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import batch_of, bit_filter, has_bit, slices, stage_table, texts_of, tidied
from pathweave.llm.components import stars

SHINGLE = 4
THRESHOLD = 85  # percent
#: Shingles known to be common: a table of fixed size, which only sets the order.
COMMON = 65_536
TASK_COMMON = 16_384
BLOCK = 256
#: Further rounds of centres while lists hold this many times more pairs than sets and
#: a round takes away some hundredths of the pairs.
STAR_ROUNDS = 3
STAR_GAIN = 16
#: Centres of a list in each further round.
CENTRES = 8

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; with fewer words than ``size`` the whole
    sequence is one shingle."""
    numbers: dict[bytes, int] = {}
    words, lengths = [], []
    for text in texts:
        own = words_of(text)
        words += own
        lengths.append(len(own))
    for w in set(words):
        numbers[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words))
    out, at = [], 0
    with np.errstate(over="ignore"):
        n = max(len(hashes) - size + 1, 0)
        rolled = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            rolled = _mixed(rolled, hashes[k : k + n])
        for length in lengths:
            if length >= size:
                out.append(np.unique(rolled[at : at + length - size + 1]))
            elif length:
                single = np.full(1, length, dtype=np.uint64)
                for k in range(length):
                    single = _mixed(single, hashes[at + k : at + k + 1])
                out.append(single)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += length
    return out


def _mixed(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    state = (state ^ value) * _GOLDEN
    state ^= state >> np.uint64(32)
    return state * np.uint64(0xD6E8FEB86659FD93)


#: Buckets of the smallest and the largest outline, as powers of two.
OUTLINE_BITS = (4, 14)


def outline(own: np.ndarray) -> bytes:
    """Counts of shingles by the upper bits of their hash; empty (which bounds nothing)
    where a count exceeds a byte."""
    bits = min(max(len(own).bit_length(), OUTLINE_BITS[0]), OUTLINE_BITS[1])
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


#: Buckets of a sketch, as a power of two.
SKETCH_BITS = 8


def sketch(own: np.ndarray) -> bytes:
    """An outline of the same length for all sets. Counts stop at 255, which brings two
    sketches only nearer to each other, so that they bound as outlines do."""
    counts = np.bincount((own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_common(n_x: int, x: bytes, n_y: int, y: bytes) -> int:
    """An upper bound of what two sets share, by their outlines. The longer outline is
    folded to the length of the other: buckets by upper bits add up in neighbours."""
    if not x or not y:
        return min(n_x, n_y)
    x, y = sorted((np.frombuffer(x, dtype=np.uint8).astype(np.int32), np.frombuffer(y, dtype=np.uint8).astype(np.int32)), key=len)
    if len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return min((n_x + n_y - int(np.abs(x - y).sum())) // 2, n_x, n_y)


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    """So many of the first shingles meet those of any set it links with."""
    return n - -(-threshold * n // 100) + 1 if n else 0


def _ordered(own: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set in the common order: shingles of the table last, the most common at the end."""
    if not len(common) or not len(own):
        return own
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    rank = np.where(common[at] == own, ranks[at], -1)
    return own[np.lexsort((own, rank))]


def _common_shingles(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the shingles in most documents, by summed-up task counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
        held, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        pending: list[np.ndarray] = []
        waiting = 0

        def fold():
            values = np.concatenate([held, *pending])
            weights = np.concatenate([counts, *(np.ones(len(p), dtype=np.int64) for p in pending)])
            unique, inverse = np.unique(values, return_inverse=True)
            totals = np.bincount(inverse, weights=weights).astype(np.int64)
            if len(unique) > 4 * TASK_COMMON:  # keep what may still be common
                keep = totals > 1 if (totals > 1).sum() <= 16 * TASK_COMMON else totals >= np.sort(totals)[-16 * TASK_COMMON]
                unique, totals = unique[keep], totals[keep]
            return unique, totals

        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            pending += sets
            waiting += sum(map(len, sets))
            if waiting > 1_500_000:
                held, counts = fold()
                pending, waiting = [], 0
        held, counts = fold()
        top = np.lexsort((held, -counts))[:TASK_COMMON]
        top = top[counts[top] > 2]
        if len(top):
            yield batch_of(schema, token=held[top].view(np.int64), n=counts[top])

    counted = rows.mapInArrow(tidied(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    hashes = found.column("token").to_numpy().view(np.uint64)
    ranks = np.arange(len(hashes))[::-1]
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


_SETS_DDL = "doc_id long, n long, key binary, prefix array<long>, outline binary, sketch binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("outline", pa.binary()), ("sketch", pa.binary())])


def _prefixes(rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """One row a document: size and hash of its set, its prefix in order, its
    outline and its sketch. Within a task these three are given once for equal sets, with
    a row that has an id."""
    common, ranks = _common_shingles(rows, size)
    shared = rows.sparkSession.sparkContext.broadcast((common, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        met: set[bytes] = set()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            prefixes, outlines, sketches = [], [], []
            for own, key, named in zip(sets, keys, batch.column("doc_id").is_valid().to_pylist()):
                if not named or key in met or not len(own):
                    prefixes.append(None)
                    outlines.append(None)
                    sketches.append(None)
                else:
                    met.add(key)
                    prefixes.append(_ordered(own, *table)[: prefix_length(len(own), threshold)].view(np.int64))
                    outlines.append(outline(own))
                    sketches.append(sketch(own))
            yield batch_of(_SETS, doc_id=batch.column("doc_id"), n=[len(s) for s in sets], key=keys, prefix=prefixes, outline=outlines, sketch=sketches)

    return rows.mapInArrow(tidied(run), _SETS_DDL)


def _sizes_allow(n1: Column, n2: Column, threshold: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * threshold


def _least_overlap(n1: Column, n2: Column, threshold: int) -> Column:
    """100 * common >= threshold * (n1 + n2 - common), solved for common."""
    return F.ceil((n1 + n2) * threshold / (100 + threshold) - 1e-9)


def _positions_allow(n1, p1, n2, p2, threshold: int) -> Column:
    """Whether this can be the first shingle the two sets share."""
    return 1 + F.least(n1 - p1, n2 - p2) - 1 >= _least_overlap(n1, n2, threshold)


_KNOWN_DDL = "a long, b long, n_a long, n_b long, low long, high long, linked boolean"
_KNOWN = pa.schema([*((c, pa.int64()) for c in ("a", "b", "n_a", "n_b", "low", "high")), ("linked", pa.bool_())])


def _outlined(pairs: DataFrame, outlines: DataFrame, threshold: int, name: str) -> DataFrame:
    """The pairs (a, b) with bounds (low, high) of what their sets share by their
    outlines; ``linked`` is false where that leaves no room for a link and null where it
    does, or where one of the two is no single set."""
    first = outlines.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("outline").alias("of_b"))
    second = outlines.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("outline").alias("of_a"))
    met = pairs.select("a", "b").join(first, "b", "left").join(second, "a", "left")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "of_b"):
            n_a, n_b, of_a, of_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "of_a", "of_b"))
            high = [None if x is None or y is None else most_common(n, x, m, y) for n, m, x, y in zip(n_a, n_b, of_a, of_b)]
            hopeless = [c is not None and 100 * c < threshold * (n + m - c) for c, n, m in zip(high, n_a, n_b)]
            yield batch_of(_KNOWN, a=batch.column("a"), b=batch.column("b"), n_a=n_a, n_b=n_b, low=[0 if h else None for h in hopeless], high=high, linked=[False if h else None for h in hopeless])

    return stage_table(met.select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(tidied(bound), _KNOWN_DDL), name)


def _overlaps(pairs: DataFrame, rows: DataFrame, outlines: DataFrame, size: int, threshold: int, name: str) -> DataFrame:
    """(a, b, n_a, n_b, low, high, linked) of the pairs: bounds of what the two share,
    equal ones wherever there is room for a link. Only texts of such pairs meet, by
    joins that split hot keys; they take less room than their sets, which are made
    where both have met.

    A repeated pair of ids comes up once for each pair of their texts.
    """
    bounded = _outlined(pairs, outlines, threshold, f"{name}-outlined")
    pairs = bounded.where("linked IS NULL")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    texts = has_bit(rows, "doc_id", rows.sparkSession.sparkContext.broadcast(bit_filter(ids, "doc_id")))
    first = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("of_b"))
    second = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("of_a"))
    met = pairs.select("a", "b").join(first, "b").join(second, "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "of_b"):
            # rows of one ``a`` come together, so most texts of it are met again
            texts: dict[str, int] = {}
            places = [[texts.setdefault(t, len(texts)) for t in batch.column(c).to_pylist()] for c in ("of_a", "of_b")]
            sets = shingle_sets(list(texts), size)
            rows = []
            for x, y in zip(*places):
                x, y = sorted((sets[x], sets[y]), key=len)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                rows.append((common, 100 * common >= threshold * (len(x) + len(y) - common)))
            common, linked = map(list, zip(*rows)) if rows else ([], [])
            n_a, n_b = ([len(sets[k]) for k in own] for own in places)
            yield batch_of(_KNOWN, a=batch.column("a"), b=batch.column("b"), n_a=n_a, n_b=n_b, low=common, high=common, linked=linked)

    compared = stage_table(met.select("a", "b", "of_a", "of_b").mapInArrow(tidied(compare), _KNOWN_DDL), name)
    return compared.unionByName(bounded.where("NOT linked"))


def _lists(sets: DataFrame, heads: DataFrame) -> DataFrame:
    """(token, node, n, place) of the shingles that stand in several prefixes."""
    spark = sets.sparkSession
    tokens = sets.select(F.explode("prefix").alias("token"))
    several = stage_table(tokens.groupBy("token").count().where("count > 1").select("token"), "shared-shingles")
    shared = spark.sparkContext.broadcast(bit_filter(several, "token"))
    placed = sets.select("n", "key", F.posexplode("prefix").alias("place", "token"))
    entries = has_bit(placed, "token", shared).join(several, "token")
    named = entries.join(heads.select("key", "node"), "key")
    return stage_table(named.select("token", "node", "n", "place").distinct(), "shingle-lists")


def _centres(lists: DataFrame, turn: int) -> DataFrame:
    """(token, centre, cn): one set of each list at first, then up to ``CENTRES``,
    other ones each turn: the first of each part of the list by a hash."""
    h = F.xxhash64("node", F.lit(turn))
    slot = F.pmod(F.shiftright(h, 32), F.lit(CENTRES if turn else 1))
    found = lists.groupBy("token", slot.alias("slot")).agg(F.min(F.struct(h.alias("h"), "node", "n")).alias("c"))
    return found.select("token", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"))


def _stars(lists: DataFrame, centres: DataFrame, threshold: int) -> DataFrame:
    """Each set of a list with the list's centre, where the sizes allow a link."""
    met = lists.join(centres, "token")
    met = met.where((F.col("node") != F.col("centre")) & _sizes_allow(F.col("n"), F.col("cn"), threshold))
    return met.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()


def _measured(lists: DataFrame, centres: DataFrame, known: DataFrame) -> DataFrame:
    """``lists`` with ``beside``, the most shingles that a set may have beside the centre
    of its list, and ``shared``, the most that it may share with it: as known, or as
    wide as can be where nothing is."""
    overlaps = known.groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    own = centres.groupBy("token").agg(F.min("centre").alias("centre"))
    placed = lists.join(own, "token", "left").withColumns({"a": F.greatest("node", "centre"), "b": F.least("node", "centre")})
    own = F.col("node") == F.col("centre")
    low = F.when(own, F.col("n")).otherwise(F.coalesce("low", F.lit(0)))
    high = F.when(own, F.col("n")).otherwise(F.coalesce("high", F.col("n")))
    return placed.join(overlaps, ["a", "b"], "left").select(*lists.columns, (F.col("n") - low).alias("beside"), high.alias("shared"))


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components, with ``part``, the component."""
    named = lists.drop("part").join(labels, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    mixed = named.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token")
    return stage_table(named.join(mixed, "token", "left_semi"), "open-lists")


_SET_FIELDS = ("node", "n", "place", "beside", "shared", "part", "sketch")
_PAIRS_DDL = "a long, b long, n_a long, n_b long"
_PAIRS = pa.schema([(c, pa.int64()) for c in ("a", "b", "n_a", "n_b")])
#: Pairs of sketches compared at once.
SKETCHES_AT_ONCE = 16_384


class _Block:
    """The sets of one block, column by column."""

    def __init__(self, rows: pa.StructArray) -> None:
        self.node, self.n, place, self.beside, self.shared, self.part = (
            rows.field(c).to_numpy(zero_copy_only=False) for c in _SET_FIELDS[:-1]
        )
        self.rest = self.n - place
        drawn = rows.field("sketch").to_pylist()
        self.drawn = np.array([s is not None for s in drawn])
        blank = bytes(1 << SKETCH_BITS)
        self.sketch = np.frombuffer(b"".join(s or blank for s in drawn), dtype=np.uint8).reshape(len(drawn), -1)


def open_pairs(left: _Block, right: _Block, same: bool, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the pairs of different components that may link,
    by sizes, by the positions of the list's shingle, by
    common(x, y) <= shared(x) + beside(y), and by the sketches. A set without a sketch
    is bound by the others alone."""
    n = left.n[:, None] + right.n[None, :]
    least = -(-n * threshold // (100 + threshold))
    most = np.minimum(left.rest[:, None], right.rest[None, :])
    most = np.minimum(most, left.shared[:, None] + right.beside[None, :])
    most = np.minimum(most, left.beside[:, None] + right.shared[None, :])
    smaller = np.minimum(left.n[:, None], right.n[None, :])
    may = (most >= least) & (smaller >= least) & (left.part[:, None] != right.part[None, :])
    x, y = np.nonzero(np.triu(may, 1) if same else may)
    stay = np.ones(len(x), dtype=bool)
    for at in range(0, len(x), SKETCHES_AT_ONCE):
        i, j = x[at : at + SKETCHES_AT_ONCE], y[at : at + SKETCHES_AT_ONCE]
        own, other = left.sketch[i], right.sketch[j]
        apart = (np.maximum(own, other) - np.minimum(own, other)).sum(axis=1, dtype=np.int64)
        stay[at : at + SKETCHES_AT_ONCE] = ((n[i, j] - apart) // 2 >= least[i, j]) | ~(left.drawn[i] & right.drawn[j])
    return x[stay], y[stay]


def _block_pairs(lists: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs of sets of different components in one list, by way of blocks.

    A block holds sets of one list that lie about as far from the list's centre. Two
    blocks are skipped if all their sets are of one component, if their sizes differ too
    much, if too little of their sets follows the shingle, or if what one shares with
    the centre and what the other has beside it can't add up to a link.
    """
    distance = F.floor(F.log2(F.col("beside") + 1)).cast("int")
    marked = lists.withColumn("distance", distance).join(sketches, "node", "left")
    sizes = lists.groupBy("token", distance.alias("distance")).count().withColumn("cuts", F.ceil(F.col("count") / BLOCK).cast("long"))
    salted = marked.join(sizes.select("token", "distance", "cuts"), ["token", "distance"]).withColumn("cut", F.pmod(F.xxhash64("node"), "cuts"))
    blocks = salted.groupBy("token", "distance", "cut").agg(
        F.min("n").alias("n0"),
        F.max("n").alias("n1"),
        F.min("part").alias("part0"),
        F.max("part").alias("part1"),
        F.max(F.col("n") - F.col("place")).alias("rest"),
        F.max("beside").alias("beside"),
        F.max("shared").alias("shared"),
        F.collect_list(F.struct(*_SET_FIELDS)).alias("sets"),
    )
    left, right = blocks.alias("l"), blocks.alias("r")
    once = F.struct("l.distance", "l.cut") <= F.struct("r.distance", "r.cut")
    mixed = F.least("l.part0", "r.part0") < F.greatest("l.part1", "r.part1")
    near = (F.col("l.n1") * 100 >= F.col("r.n0") * threshold) & (F.col("r.n1") * 100 >= F.col("l.n0") * threshold)
    most = F.least("l.rest", "r.rest", F.col("l.shared") + F.col("r.beside"), F.col("r.shared") + F.col("l.beside"))
    reach = most >= _least_overlap(F.col("l.n0"), F.col("r.n0"), threshold)
    met = left.join(right, (F.col("l.token") == F.col("r.token")) & once & mixed & near & reach)
    same = (F.col("l.distance") == F.col("r.distance")) & (F.col("l.cut") == F.col("r.cut"))
    both = met.select(F.col("l.sets").alias("sets"), F.when(~same, F.col("r.sets")).alias("others"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for sets, others in zip(batch.column("sets"), batch.column("others")):
                left = _Block(sets.values)
                right = _Block(others.values) if others.is_valid else left
                x, y = open_pairs(left, right, right is left, threshold)
                found.append(np.stack([left.node[x], right.node[y], left.n[x], right.n[y]]))
            if found:
                p, q, n_p, n_q = np.concatenate(found, axis=1)
                yield batch_of(_PAIRS, a=np.maximum(p, q), b=np.minimum(p, q), n_a=np.where(p > q, n_p, n_q), n_b=np.where(p > q, n_q, n_p))

    return both.mapInArrow(tidied(compare), _PAIRS_DDL).distinct()


def _derived(pairs: DataFrame, known: DataFrame, several: DataFrame, threshold: int) -> DataFrame:
    """The pairs that what is known leaves open: for x near a centre c with known
    overlaps, common(x, y) <= common(c, y) + |x| - common(x, c). Overlaps are known by
    id, so that this says nothing of an x in ``several``, the ids with several sets."""
    both = known.select("a", "b", "n_a", "n_b", "low", "high", "linked").union(known.select("b", "a", "n_b", "n_a", "low", "high", "linked"))
    gap = F.struct((F.col("n_a") - F.col("low")).alias("gap"), F.col("b").alias("centre"))
    single = both.where("linked").join(several.select(F.col("doc_id").alias("a")), "a", "left_anti")
    nearest = single.groupBy("a").agg(F.min(gap).alias("g")).select(F.col("a").alias("x"), F.col("g.centre").alias("centre"), F.col("g.gap").alias("gap"))
    overlaps = both.groupBy(F.col("a").alias("centre"), F.col("b").alias("y")).agg(F.max("high").alias("near"))
    left = pairs
    for x, y in (("a", "b"), ("b", "a")):
        left = left.join(nearest.withColumnRenamed("x", x), x, "left").join(overlaps.withColumnRenamed("y", y), ["centre", y], "left")
        hopeless = F.col("near") + F.col("gap") < _least_overlap(F.col("n_a"), F.col("n_b"), threshold)
        left = left.where(~F.coalesce(hopeless, F.lit(False))).select("a", "b", "n_a", "n_b")
    return left.join(known.select("a", "b"), ["a", "b"], "left_anti")


def link(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Two documents link when 100 * |common shingles| >= threshold * |all shingles|; the
    component is the smallest id reachable. A null or empty text has an empty set and
    links with nothing. A row without an id links with nothing and has no component.
    Rows that share an id are one document with several texts, which links if one of
    them does. Other columns play no part; an empty table gives an empty result. The
    call runs jobs and keeps what they find below the shared folder.
    """
    if not 50 <= threshold <= 100:
        raise ValueError("the threshold is a percentage from 50 to 100")
    rows = texts_of(docs, id_col, text_col)
    sets = stage_table(_prefixes(rows, size, threshold), "shingle-prefixes")
    real = sets.where("n > 0 AND doc_id IS NOT NULL")
    heads = stage_table(real.groupBy("key").agg(F.min("doc_id").alias("node")), "shingle-sets")
    # rows of one id are one document, whatever their texts
    several = real.groupBy("doc_id").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).where("k1 <> k2")
    same = stage_table(several.select("doc_id"), "several-sets")
    alike = real.join(same, "doc_id", "left_semi").join(heads, "key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    edges = stage_table(alike, "same-ids")
    texts = rows.where("doc_id IS NOT NULL")
    given = real.where("prefix IS NOT NULL")
    lists = _lists(given, heads)
    # several tasks may have met a set; an id with several sets has no outline
    drawn = given.groupBy("key").agg(F.first("n").alias("n"), F.first("outline").alias("outline"), F.first("sketch").alias("sketch")).join(heads, "key")
    single = drawn.join(same.select(F.col("doc_id").alias("node")), "node", "left_anti")
    outlines = stage_table(single.select("node", "n", "outline", "sketch"), "outlines")
    known = None
    labels = None
    before = float("inf")
    for turn in range(STAR_ROUNDS):
        centres = stage_table(_centres(lists, turn), "centres")
        stars_of = _stars(lists, centres, threshold)
        if known is not None:
            stars_of = stars_of.join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = _overlaps(stage_table(stars_of, "stars"), texts, outlines, size, threshold, "overlaps")
        known = found if known is None else known.unionByName(found)
        labels = stars(known.where("linked").select("a", "b").union(edges))
        lists = _open_lists(lists, labels)
        per_list = lists.groupBy("token", "part").count().groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.col("count") ** 2).alias("own"))
        total = per_list.agg(F.sum("n").alias("n"), F.sum((F.col("n") ** 2 - F.col("own")) / 2).alias("pairs")).first()
        if not total.n or total.pairs <= STAR_GAIN * total.n or total.pairs > 0.98 * before:
            break
        before = total.pairs
    if total.n:
        left = stage_table(_derived(stage_table(_block_pairs(_measured(lists, centres, known), outlines.select("node", "sketch"), threshold), "block-pairs"), known, same, threshold), "open-pairs")
        found = _overlaps(left, texts, outlines, size, threshold, "overlaps")
        if not found.where("linked").isEmpty():
            merged = found.where("linked").select("a", "b").union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = stars(merged)
    classes = heads.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    named = sets.select("doc_id", "n", "key").join(classes, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with its id. Rows
    with an empty set or without an id stay."""
    found = link(docs, size, threshold)
    others = found.where("component_id IS NOT NULL AND component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
