"""What several of the operators need: tables, batches, per-worker state."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.session import stored_table

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, a null text taken as empty; other columns play no part."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def numbered_columns(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with its columns named by number, so that none has the name of a column
    that an operator adds, and the new name of the text."""
    names = [f"_column_{n}" for n in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(text_col)]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each piece
    (one row at least), which bounds what NumPy has to hold at once."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def worker_state(key: object, make: Callable[[], object]) -> object:
    """A value kept as long as the Python worker lives, also over tasks.

    Functions are sent by value, so a module's globals begin anew in each task.
    One value is kept for each kind (the first item of ``key``).
    """
    home = sys.modules.setdefault("pathweave_worker_state", types.ModuleType("pathweave_worker_state"))
    kind = key[0] if isinstance(key, tuple) else key
    held = home.__dict__.get(str(kind))
    if held is None or held[0] != key:
        held = (key, make())
        home.__dict__[str(kind)] = held
    return held[1]


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives back what it has freed.

    A worker lives on for tasks of other operators; without this the pages that large
    arrays have left behind stay with it.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidy


def batch_of(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(n).type) for n, x in ((f.name, columns[f.name]) for f in schema)],
        schema=schema,
    )


#: Settings while a table is staged: shuffle files go when it is written, and no batch
#: of rows with long binary columns outgrows a Python worker.
_STAGING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``stored_table``, and the shuffle files that made it are removed at once, as
    nothing reads them again."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in _STAGING}
    for key, value in _STAGING.items():
        conf.set(key, value)
    try:
        return stored_table(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


FILTER_BITS = 25


def _bit(column: str, bits: int):
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def bit_filter(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of 2 ** ``bits`` bits, one set for each value of ``column`` by its hash.

    It is summed up by Spark and has the same size whatever the input. Rows whose bit
    isn't set have no partner in ``df``; with more values than bits it lets more rows
    pass, never fewer, so it only saves shuffling. See ``has_bit``.
    """
    places = df.select(_bit(column, bits).alias("at"))
    words = places.groupBy(F.expr("int(at div 64)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def has_bit(df: DataFrame, column: str, shared, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be in a broadcast ``bit_filter``."""
    marked = with_bit(df, column, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = only_set(batch, shared.value)
            if found.num_rows:
                yield found

    return marked.mapInArrow(run, marked.schema).drop("_at")


def with_bit(df: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``_at``, the place of the column's bit, for ``only_set``."""
    return df.withColumn("_at", _bit(column, bits))


def only_set(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch whose bit is set, inside a task."""
    at = batch.column("_at").to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(((table[at >> 6] >> (at & 63)) & 1).astype(bool)))
