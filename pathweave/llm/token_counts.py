"""Token counts by a two-tier lookup: a broadcast table of frequent chunks, then
worker caches; no chunk is ever shuffled.

A *chunk* is what stands between two single blanks, that is one pre-token or a few
that always stay together (a word with its full stop).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.chunk_encoder import ChunkEncoder
from pathweave.llm.common import batch_of, slices, texts_of, worker_state

FREQUENT = 32_768
TASK_SUMMARY = 8_192
TASK_HELD = 200_000
FREQUENT_CHARS = 64
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_SUMMARY = pa.schema([("chunk", pa.string()), ("n", pa.int64())])


def frequent_chunks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent chunks over all documents.

    Each task sums up its own texts and hands over its ``TASK_SUMMARY`` most frequent
    chunks; their sums are ranked. The table has ``keep`` entries of at most
    ``FREQUENT_CHARS`` characters, whatever the input, so it may be broadcast. It
    decides what is looked up where, never a count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("encoder-counts", tokenizer), lambda: ChunkEncoder(tokenizer, counts=True))
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update((encoder.chunks(text) if text else None) or ())
            if len(seen) > TASK_HELD:
                seen = Counter(dict(seen.most_common(TASK_HELD // 2)))
        top = [(c, n) for c, n in seen.most_common(TASK_SUMMARY) if n > 1 and len(c) <= FREQUENT_CHARS]
        if top:
            yield batch_of(_SUMMARY, chunk=[c for c, _ in top], n=[n for _, n in top])

    summaries = texts_of(docs, id_col, text_col).mapInArrow(summarise, "chunk string, n long")
    ranked = summaries.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(keep)
    chunks = [row.chunk for row in ranked.collect()]
    return dict(zip(chunks, _lengths(ChunkEncoder(tokenizer, counts=True), chunks)))


def _lengths(encoder: ChunkEncoder, chunks: list[str]) -> list[int]:
    known = encoder._learn(set(chunks)) if chunks else {}
    return [known[c] for c in chunks]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    ``tokenizer`` is the path of a ``.json`` of tokenizers or a ``.model`` of
    sentencepiece. A null text counts as empty; a null id stays null; rows that
    repeat are counted each; other columns play no part; an empty table gives an
    empty result. This call runs the job that finds the frequent chunks (.json only).
    """
    if tokenizer.endswith(".model"):
        return texts_of(docs, id_col, text_col).mapInArrow(_sentence_counter(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    spark = docs.sparkSession
    call = uuid.uuid4().hex
    frequent = spark.sparkContext.broadcast(frequent_chunks(docs, tokenizer, id_col, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("counter", tokenizer, call), lambda: ChunkEncoder(tokenizer, counts=True, known=frequent.value))
        for batch in slices(batches):
            yield _counted(batch, encoder.encode(batch.column("text").to_pylist()), limit)

    return texts_of(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _sentence_counter(model: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = worker_state(("sentencepiece", model), lambda: sentencepiece.SentencePieceProcessor(model_file=model))
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield _counted(batch, [len(x) for x in library.encode(texts, num_threads=1)] if texts else [], limit)

    return count


def _counted(batch: pa.RecordBatch, counts: list[int], limit: int) -> pa.RecordBatch:
    return batch_of(
        _RESULT,
        doc_id=batch.column("doc_id"),
        n_bytes=pa.compute.binary_length(batch.column("text")).cast(pa.int64()),
        n_tokens=counts,
        over_limit=[n > limit for n in counts],
    )
