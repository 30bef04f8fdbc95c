"""Raw token files with a minimal perfect hash index.

A *shard file* is, in this order: the ids of its documents, raw and little-endian (two
or four bytes each); the documents' ids as i64; their copy numbers and null flags as
i64; the end of each document counted in tokens as i64; then a footer of four i64 (shard
number, documents, bytes per token, format version) and the magic ``PWTOKENS``. Spark's
own text writer puts one row into one file, so files go through Spark's commit protocol
to any file system Spark can write, and a task that runs again leaves no half file.

The *index* has one row per hash bucket of about ``BUCKET_KEYS`` documents: a seed for
each small group of keys, which sends every key to a slot of its own, and per slot a
fingerprint, shard, offset and length. A key is found by one bucket, one seed and one
slot; the fingerprint tells keys that were never stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.llm.chunk_encoder import worker_column_encoder
from pathweave.llm.common import batch_of, slices, texts_of, tidied
from pathweave.session import stored_table

MAGIC = "PWTOKENS"
VERSION = 1
SHARD_BYTES = 16 << 20
BUCKET_KEYS = 4096
GROUP_KEYS = 4
#: Shards of one partition; shard numbers of different partitions never meet.
PART_SHARDS = 1 << 24
_SPLITTER_ERROR = 0.002
#: Keyed reads open shards by their names up to this many; a read of more opens all.
MOST_OPENED = 10_000
#: Of the seeds tried for a group of keys before equal hashes are looked for.
_MANY_TRIES = 1 << 16


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encodes ``docs`` and writes ``folder/shards`` and ``folder/index``.

    Documents lie in ascending order of their id, over all shards; rows without an id
    come first, rows with the same id by their ids. A null text is empty and still has
    its end id. An empty table gives no shard and an empty index. Ids are moved once,
    after the encoding, to the range of their document.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = texts_of(docs, id_col, text_col)
    splitters = chosen.approxQuantile("doc_id", [i / n for i in range(1, n)], _SPLITTER_ERROR) if n > 1 else []
    splitters = sorted({int(x) for x in splitters})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_column_encoder(tokenizer)
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("width", pa.int32()), ("ids", pa.binary())])
        edges = np.asarray(splitters, dtype=np.int64)
        for batch in slices(batches):
            ids = batch.column("doc_id")
            keys = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield batch_of(
                schema,
                doc_id=ids,
                part=np.searchsorted(edges, keys, side="right").astype(np.int32),
                width=np.full(len(keys), encoder.width, dtype=np.int32),
                ids=[x + end for x in encoder.encode(batch.column("text"))],
            )

    encoded = chosen.mapInArrow(tidied(encode), "doc_id long, part int, width int, ids binary")
    placed = encoded.repartitionById(len(splitters) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    shards = placed.mapInArrow(tidied(_shard_writer(shard_bytes)), "value binary")
    (
        shards.select(F.col("value").cast("string"))
        .write.option("lineSep", MAGIC)
        .option("maxRecordsPerFile", 1)
        .text(f"{folder}/shards")
    )
    _write_index(spark, folder)


def _shard_writer(shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])
        held, size, shard = [], 0, None
        last, copies = (None, None), 0

        def flush():
            width = held[0][3]
            keys = np.array([[h[0] or 0, h[1] * 2 + (h[0] is None)] for h in held], dtype="<i8")
            ends = np.cumsum([len(h[2]) // width for h in held], dtype="<i8")
            tail = np.array([shard, len(held), width, VERSION], dtype="<i8")
            return b"".join([*(h[2] for h in held), keys[:, 0].tobytes(), keys[:, 1].tobytes(), ends.tobytes(), tail.tobytes()])

        for batch in batches:
            for doc, part, width, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard is None:
                    shard = part * PART_SHARDS
                elif held and (size + len(ids) > shard_bytes or part > shard // PART_SHARDS):
                    yield batch_of(schema, value=[flush()])
                    shard = max(shard + 1, part * PART_SHARDS)
                    held, size = [], 0
                copies = copies + 1 if last == (doc, True) else 0
                last = (doc, True)
                held.append((doc, copies, ids, width))
                size += len(ids)
        if held:
            yield batch_of(schema, value=[flush()])

    return write


def open_shard(content: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, document ids, tags, ends, ids) of a shard file's bytes; a tag is twice
    the copy number, plus one where the document has no id."""
    if content[-len(MAGIC) :] != MAGIC.encode():
        raise ValueError("not a shard file")
    body = len(content) - len(MAGIC)
    shard, n, width, version = np.frombuffer(content, dtype="<i8", count=4, offset=body - 32).tolist()
    if version != VERSION:
        raise ValueError(f"shard format {version} is not known")
    at = body - 32 - 24 * n
    keys, tags, ends = (np.frombuffer(content, dtype="<i8", count=n, offset=at + 8 * n * i) for i in range(3))
    return shard, keys, tags, ends, np.frombuffer(content, dtype=f"<u{width}", count=at // width)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/shards").select("content")


def _files_of(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(content) of the files of some shards, a table with the column ``shard``.

    The writer names a file after its partition and its place in it, which are the
    number of its shard. Names are listed without opening a file; the list of those
    asked for comes to the driver if it is no longer than ``MOST_OPENED``.
    """
    paths = spark.read.format("binaryFile").load(f"{folder}/shards").select("path")
    part, at = (F.regexp_extract("path", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", n).cast("long") for n in (1, 2))
    named = paths.withColumn("shard", part * PART_SHARDS + at)
    asked = shards.select("shard").distinct().limit(MOST_OPENED + 1).collect()
    if len(asked) > MOST_OPENED:
        return _files(spark, folder)
    if not asked:
        return _files(spark, folder).limit(0)
    wanted = spark.createDataFrame(asked, "shard long")
    found = [r.path for r in named.join(F.broadcast(wanted), "shard", "left_semi").select("path").collect()]
    if len(found) < len(asked):
        raise ValueError(f"{len(asked) - len(found)} shard files of {folder} are missing")
    return spark.read.format("binaryFile").load(found).select("content")


_ENTRIES = pa.schema([("hash", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_ENTRY_DDL = "hash long, shard long, offset long, n_tokens long, ids_crc32 long"


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """What the shard files hold, read back: one row a document with the hash of its
    key, its place, and the crc32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard, keys, tags, ends, ids = open_shard(content.as_buffer().to_pybytes())
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield batch_of(
                    _ENTRIES,
                    hash=key_hash(keys, tags).view(np.int64),
                    shard=np.full(len(keys), shard),
                    offset=starts,
                    n_tokens=ends - starts,
                    ids_crc32=crc,
                )

    return _files(spark, folder).mapInArrow(tidied(read), _ENTRY_DDL)


def key_hash(keys: np.ndarray, tags: np.ndarray | int) -> np.ndarray:
    return _mix(keys.astype(np.int64).view(np.uint64) + _mix(np.asarray(tags, dtype=np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key under its group's seed; a negative seed names the slot."""
    with np.errstate(over="ignore"):
        mixed = _mix(hashes + _mix(seeds.astype(np.int64).view(np.uint64))) % np.uint64(n)
    return np.where(seeds < 0, -seeds - 1, mixed.astype(np.int64))


def _groups(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(8)) % np.uint64(-(-n // GROUP_KEYS))).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Seeds that send ``n`` distinct hashes to the slots 0..n-1, one each.

    Groups of several keys come first, the largest at the front, and try seeds until
    all their slots are free; a group of one key just takes a free slot.
    """
    n = len(hashes)
    group = _groups(hashes, n)
    seeds = np.zeros(-(-n // GROUP_KEYS), dtype=np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(len(seeds) + 1))
    sizes = np.diff(bounds)
    taken = np.zeros(n, dtype=bool)
    tries = np.arange(1, 65, dtype=np.int64)
    for g in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[g])
        if size < 2:
            break
        own = hashes[order[bounds[g] : bounds[g + 1]]]
        base = 0
        while True:
            slots = _slots(own[None, :], (tries + base)[:, None], n)
            good = ~taken[slots].any(axis=1)
            if size > 1:
                ranked = np.sort(slots, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                first = int(good.argmax())
                seeds[g] = base + tries[first]
                taken[slots[first]] = True
                break
            base += len(tries)
            if base == _MANY_TRIES and len(np.unique(own)) < size:
                raise ValueError("two keys have the same 64-bit hash, which no seed can part")
    free = iter(np.flatnonzero(~taken).tolist())
    for g in np.flatnonzero(sizes == 1).tolist():
        seeds[g] = -next(free) - 1
    return seeds


_INDEX = "bucket long, n long, seeds binary, fingerprints binary, shards binary, offsets binary, lengths binary"


def _write_index(spark: SparkSession, folder: str) -> None:
    entries_path = f"{folder}/entries"
    digests(spark, folder).write.parquet(entries_path)
    entries = spark.read.schema(_ENTRY_DDL).parquet(entries_path)
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = frame["hash"].to_numpy(np.int64).view(np.uint64)
        n, seeds = len(hashes), perfect_hash(hashes)
        slots = _slots(hashes, seeds[_groups(hashes, n)], n)
        columns = {}
        for name, source, kind in (("fingerprints", hashes >> np.uint64(32), "<u4"), ("shards", frame["shard"], "<i8"), ("offsets", frame["offset"], "<i8"), ("lengths", frame["n_tokens"], "<i8")):
            out = np.empty(n, dtype=kind)
            out[slots] = np.asarray(source).astype(kind)
            columns[name] = [out.tobytes()]
        return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "n": [n], "seeds": [seeds.astype("<i8").tobytes()], **columns})

    bucketed = entries.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    bucketed.groupBy("bucket").applyInPandas(build, _INDEX).withColumn("buckets", F.lit(buckets).cast("long")).write.parquet(f"{folder}/index")


_PLACES = "doc_id long, shard long, offset long, n_tokens long"


def locate(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, shard, offset, n_tokens) of every key, by the index alone.

    A key that stands in several rows of the stored table has a place for each of its
    copies when ``keys`` holds it as often. Keys that were not stored give no row (the
    32-bit fingerprint lets one in four billion of them through). A null key finds the
    rows stored without an id.
    """
    index = spark.read.parquet(f"{folder}/index")
    found = index.select("buckets").take(1)
    buckets = found[0].buckets if found else 1
    copies = keys.groupBy(F.col(id_col).cast("long").alias("doc_id")).count()
    each = copies.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("copy"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64())])
        for batch in batches:
            ids, missing = batch.column("doc_id"), np.asarray(batch.column("doc_id").is_null())
            tags = np.asarray(batch.column("copy")).astype(np.int64) * 2 + missing
            yield batch_of(schema, doc_id=ids, hash=key_hash(ids.fill_null(0).to_numpy(zero_copy_only=False), tags).view(np.int64))

    def look(keys: pd.DataFrame, buckets: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), **{c: pd.Series(dtype="int64") for c in ("shard", "offset", "n_tokens")}})
        if keys.empty or buckets.empty:
            return empty
        row = buckets.iloc[0]
        n = int(row["n"])
        hashes = keys["hash"].to_numpy(np.int64).view(np.uint64)
        slots = _slots(hashes, np.frombuffer(row["seeds"], "<i8")[_groups(hashes, n)], n)
        stored = np.frombuffer(row["fingerprints"], "<u4")[slots] == (hashes >> np.uint64(32)).astype("<u4")
        out = {"doc_id": keys["doc_id"].astype("Int64")}
        for name, column in (("shard", "shards"), ("offset", "offsets"), ("n_tokens", "lengths")):
            out[name] = np.frombuffer(row[column], "<i8")[slots]
        return pd.DataFrame(out)[stored]

    wanted = each.mapInArrow(hashed, "doc_id long, hash long").withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(look, _PLACES)


def read_ids(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<long>) of the given keys. Places are found by the index and
    stored when this is called; then only the shards they name are opened (beyond
    ``MOST_OPENED`` of them all are, and only those asked for travel)."""
    places = stored_table(locate(spark, folder, keys, id_col), "token-places")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            contents = batch.column("content").to_pylist()
            yield batch_of(schema, shard=[open_shard(c)[0] for c in contents], content=contents)

    def pick(places: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        if files.empty:
            raise ValueError("a shard that the index names is missing")
        if places.empty:
            return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "ids": pd.Series(dtype=object)})
        ids = open_shard(files["content"].iloc[0])[4]
        picked = [ids[a : a + n].astype(np.int64) for a, n in zip(places["offset"], places["n_tokens"])]
        return pd.DataFrame({"doc_id": places["doc_id"].astype("Int64"), "ids": picked})

    shards = _files_of(spark, folder, places).mapInArrow(named, "shard long, content binary")
    needed = shards.join(places.select("shard").distinct(), "shard", "left_semi")
    return places.groupBy("shard").cogroup(needed.groupBy("shard")).applyInPandas(pick, "doc_id long, ids array<long>")


def catalogue(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every key: found by the index, checked
    in the shard files. ``start`` counts the ids of all documents before it."""
    entries = spark.read.schema(_ENTRY_DDL).parquet(f"{folder}/entries")
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    places = locate(spark, folder, keys, id_col)
    return (
        places.join(entries.select("shard", "offset", "ids_crc32"), ["shard", "offset"])
        .join(bases, "shard")
        .select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )
