"""Compression of vectors to codes: four parts, each the number of its nearest entry.

Rows are stored once in blocks. In a block every dimension keeps a dictionary of its
distinct whole numbers and, for each row, the number's place in it. To compare a block
with a codebook, the squared differences of each dictionary value to all entries are
tabulated; the distances of all rows then are gathers of table rows by dictionary code,
added up over the dimensions of the part. No row's own numbers are multiplied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import batch_of, stage_table
from pathweave.llm.vectors import exact_type, matrix, shape, usable, whole

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows of a block: its dictionaries are no longer, its codes fit 16 bits.
BLOCK_ROWS = 8192
#: Rows whose distances to all entries are held at once.
AT_ONCE = 1024

_BLOCK_DDL = "ids array<long>, labels array<string>, starts binary, dictionary binary, codes binary"
_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("starts", pa.binary()), ("dictionary", pa.binary()), ("codes", pa.binary())])


@dataclass(frozen=True)
class Blocks:
    """Vectors as stored blocks of dictionary codes; ``first`` holds the rows that the
    codebooks start from, ``width`` is the length of a part."""

    frame: DataFrame
    first: np.ndarray
    width: int
    exact: type


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]``: a row for each entry, whole numbers."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([part[at] for part, at in zip(self.entries, code)])


def to_blocks(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Blocks:
    """Reads the table once into stored blocks.

    Rows whose vector is null or has a null or non-finite component go. Components are
    floor(scale * x). Vectors of several lengths are filled up with zeros to the
    longest, and that to a multiple of four. A vector whose squared distances could
    exceed a 64-bit number makes the call fail with an error that says so. The
    codebooks start from the 256 smallest ids, nulls last, rows of equal ids by their
    components; repeated rows are rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where(usable(F.col("vector"))).select("vec_id", "label", whole(F.col("vector"), scale).alias("vector"))
    size = shape(rows, "vector")
    width = -(-size.width // PARTS)
    most = 4 * size.largest**2 * max(width, 1)
    exact = np.int32 if most < 1 << 31 else exact_type(most, "squared distances")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    start = np.zeros((len(first), PARTS * width), dtype=np.int64)
    for at, row in enumerate(first):
        start[at, : len(row.vector)] = row.vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                if count + piece.num_rows > BLOCK_ROWS:
                    yield _block(held, PARTS * width)
                    held, count = [], 0
                held.append(piece)
                count += piece.num_rows
        if held:
            yield _block(held, PARTS * width)

    return Blocks(stage_table(rows.mapInArrow(run, _BLOCK_DDL), "vector-blocks"), start, width, exact)


def _block(held: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    values = matrix(table.column("vector").combine_chunks(), width)
    starts, dictionary, codes = [0], [], []
    for j in range(width):
        distinct, place = np.unique(values[:, j], return_inverse=True)
        dictionary.append(distinct)
        codes.append(place.astype(np.uint16))
        starts.append(starts[-1] + len(distinct))
    joined = np.concatenate(dictionary) if dictionary else np.zeros(0, dtype=np.int64)
    return batch_of(
        _BLOCK,
        ids=[table.column("vec_id").to_pylist()],
        labels=[table.column("label").to_pylist()],
        starts=[np.array(starts, dtype=np.int32).tobytes()],
        dictionary=[joined.astype(np.int64).tobytes()],
        codes=[np.concatenate(codes).tobytes() if codes else b""],
    )


class _Dictionaries:
    """One stored block: dictionaries and codes of every dimension."""

    def __init__(self, starts: bytes, dictionary: bytes, codes: bytes, rows: int):
        at = np.frombuffer(starts, dtype=np.int32)
        values = np.frombuffer(dictionary, dtype=np.int64)
        self.values = [values[a:b] for a, b in zip(at[:-1], at[1:])]
        self.codes = np.frombuffer(codes, dtype=np.uint16).reshape(len(self.values), rows)
        self.rows = rows

    def nearest(self, part: int, entries: np.ndarray, exact: type) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of a part of all rows; ties to the lower entry."""
        width = entries.shape[1]
        dims = range(part * width, (part + 1) * width)
        tables = []
        for j, column in zip(dims, entries.T.astype(exact)):
            table = self.values[j].astype(exact)[:, None] - column[None, :]
            tables.append(np.multiply(table, table, out=table))
        chosen, distance = np.zeros(self.rows, dtype=np.int64), np.zeros(self.rows, dtype=np.int64)
        for a in range(0, self.rows, AT_ONCE):
            b = min(a + AT_ONCE, self.rows)
            total = np.zeros((b - a, len(entries)), dtype=exact)
            gathered = np.empty_like(total)
            for j, table in zip(dims, tables):
                total += np.take(table, self.codes[j, a:b], axis=0, out=gathered, mode="clip")
            chosen[a:b] = total.argmin(axis=1)
            distance[a:b] = total[np.arange(b - a), chosen[a:b]]
        return chosen, distance

    def sums(self, part: int, width: int, chosen: np.ndarray, entries: int) -> np.ndarray:
        """Sums of the components by entry, gathered from the dictionaries."""
        out = np.zeros((entries, width), dtype=np.int64)
        for at in range(width):
            j = part * width + at
            # counted by (entry, dictionary code) first: whole numbers stay exact
            size = len(self.values[j])
            both = np.bincount(chosen * size + self.codes[j], minlength=entries * size)
            out[:, at] = both.reshape(entries, size) @ self.values[j]
        return out


def fit(blocks: Blocks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds of assigning and averaging.

    A round is one job. Each task adds up its blocks, so at most a row for each part
    and entry leaves it; the sums of all tasks, a fixed number of rows, come to the
    driver, where means are floored in whole numbers. Entries without parts stay.
    """
    spark, width = blocks.frame.sparkSession, blocks.width
    entries = [blocks.first[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    out = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])
    for _ in range(rounds if len(blocks.first) and width else 0):
        shared, exact = spark.sparkContext.broadcast(entries), blocks.exact

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            count = np.zeros((PARTS, len(books[0])), dtype=np.int64)
            total = np.zeros((PARTS, len(books[0]), width), dtype=np.int64)
            for block in _opened(batches):
                for part, book in enumerate(books):
                    chosen, _ = block.nearest(part, book, exact)
                    count[part] += np.bincount(chosen, minlength=len(book))
                    total[part] += block.sums(part, width, chosen, len(book))
            part, entry = np.nonzero(count)
            yield batch_of(out, part=part, entry=entry, count=count[part, entry], sums=list(total[part, entry]))

        met = blocks.frame.select("ids", "starts", "dictionary", "codes").mapInArrow(run, "part int, entry int, count long, sums array<long>")
        added = met.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        entries = [e.copy() for e in entries]
        for row in added.collect():
            entries[row["part"]][row["entry"]] = [x // row["count"] for x in row["sums"]]
        shared.destroy()
    return Codebooks(entries)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[_Dictionaries]:
    for batch in batches:
        counts = pa.compute.list_value_length(batch.column("ids")).to_pylist()
        for rows, *rest in zip(counts, *(batch.column(c).to_pylist() for c in ("starts", "dictionary", "codes"))):
            yield _Dictionaries(*rest, rows)


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.binary()), ("error", pa.int64())])


def encode(blocks: Blocks, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (one byte a part) and error (squared distances summed over
    the parts) of every row of the blocks. Null ids and labels stay null; an empty
    table gives an empty result."""
    shared, exact = blocks.frame.sparkSession.sparkContext.broadcast(codebooks.entries), blocks.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in enumerate(_opened([batch])):
                found = [block.nearest(part, book, exact) for part, book in enumerate(shared.value)]
                codes = np.stack([chosen for chosen, _ in found], axis=1).astype(np.uint8).tobytes()
                yield batch_of(
                    _CODED,
                    vec_id=batch.column("ids")[at].values,
                    label=batch.column("labels")[at].values,
                    code=[codes[i : i + PARTS] for i in range(0, len(codes), PARTS)],
                    error=sum(distance for _, distance in found),
                )

    return blocks.frame.mapInArrow(run, "vec_id long, label string, code binary, error long")


def compress(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error (error summed over equal labels,
    nulls together) and codebooks_sha256, a row for each usable vector.

    The codes are stored before the sums by label are, so that the planner knows how
    small the sums are and no row is shuffled by its label. See ``to_blocks`` for
    nulls, lengths and ties; columns beside the three named play no part.
    """
    blocks = to_blocks(vectors, scale, id_col, vector_col, label_col)
    codebooks = fit(blocks)
    coded = stage_table(encode(blocks, codebooks), "vector-codes")
    sums = stage_table(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256")
    )
