"""Vector bin packing of examples into sequences under limits on tokens, segments and
loss-bearing tokens.

Each task packs the examples of its own partition, so nothing is shuffled and a task
that runs again gives the same sequences. At most ``POOL`` open examples are held.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.chunk_encoder import CACHE_CHUNKS, worker_encoder
from pathweave.llm.common import batch_of, slices, texts_of, tidied

POOL = 768
OUT_ROWS = 8_192
#: Sequence numbers of one task; numbers of different tasks never meet.
TASK_SEQUENCES = 1 << 36
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _PIECES.split(", ")])


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("limits begin at 1")


class Packer:
    """Greedy vector packing over a bounded pool.

    An open sequence takes the fitting example with the largest dot product of its
    needs and what is left, both as parts of the limits. When none fits, the longest
    one is cut (``cut``) so that the sequence is filled, else the sequence is closed.
    ``add`` and ``finish`` yield (example, start, length, loss, sequence, offset).
    """

    def __init__(self, limits: Limits, cut: bool = True, pool: int = POOL):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
        self.start = np.zeros(pool + 1, dtype=np.int64)
        self.end = np.zeros(pool + 1, dtype=np.int64)
        self.free = np.zeros(pool + 1, dtype=np.int64)  # tokens before it bear no loss
        self.items: list = [None] * (pool + 1)
        self.n = 0
        self.sequence = 0
        self._open()

    def _open(self):
        self.left = [self.limits.tokens, self.limits.segments, self.limits.loss_tokens]
        self.placed: list = []

    def _loss(self, free, start, stop):
        return max(0, stop - max(start, free))

    def add(self, item, tokens: int, prompt: int = 0) -> Iterator[tuple]:
        """``prompt``: so many leading tokens bear no loss."""
        start, limit = 0, self.limits.tokens
        if self.cut:
            while tokens - start >= limit and self._loss(prompt, start, start + limit) <= self.limits.loss_tokens:
                yield (item, start, limit, self._loss(prompt, start, start + limit), self._number(), 0)
                start += limit
        elif tokens > limit or self._loss(prompt, 0, tokens) > self.limits.loss_tokens:
            raise ValueError(f"an example of {tokens} tokens exceeds the limits and may not be cut")
        if start < tokens:
            n = self.n
            self.items[n], self.start[n], self.end[n], self.free[n] = item, start, tokens, prompt
            self.n += 1
        while self.n > self.pool:
            yield from self._step()

    def finish(self) -> Iterator[tuple]:
        while self.n:
            yield from self._step()
        yield from self._close()

    def _number(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _step(self) -> Iterator[tuple]:
        """Places one piece, or closes the sequence."""
        tokens, segments, loss = self.left
        if not tokens or not segments:
            yield from self._close()
            return
        n = self.n
        need = self.end[:n] - self.start[:n]
        bearing = np.maximum(0, self.end[:n] - np.maximum(self.start[:n], self.free[:n]))
        weight = need * (tokens / self.scale[0] ** 2) + segments / self.scale[1] ** 2 + bearing * (loss / self.scale[2] ** 2)
        weight[(need > tokens) | (bearing > loss)] = -1.0
        best = int(weight.argmax())
        if weight[best] < 0:
            best = int(need.argmax())
            start = int(self.start[best])
            length = min(tokens, max(0, int(self.free[best]) - start) + loss)
            if not self.cut or not length:
                yield from self._close()
                return
        else:
            start, length = int(self.start[best]), int(need[best])
        bears = self._loss(int(self.free[best]), start, start + length)
        self.placed.append((self.items[best], start, length, bears))
        self.left = [tokens - length, segments - 1, loss - bears]
        self.start[best] += length
        if self.start[best] == self.end[best]:
            self.n = last = n - 1
            for column in (self.start, self.end, self.free):
                column[best] = column[last]
            self.items[best], self.items[last] = self.items[last], None

    def _close(self) -> Iterator[tuple]:
        """One sequence; where pieces may be cut, one that isn't full (the last of a
        task, or one that has all the segments it may have) becomes sequences whose
        lengths are powers of two and need no padding."""
        placed, offset = self.placed, 0
        self._open()
        total = sum(p[2] for p in placed)
        room = total if not self.cut or total == self.limits.tokens else 1 << max(total.bit_length() - 1, 0)
        if placed:
            number = self._number()
        for item, start, length, bears in placed:
            free = start + length - bears
            while length:
                if offset == room:
                    total -= room
                    room, offset, number = 1 << (total.bit_length() - 1), 0, self._number()
                part = min(length, room - offset)
                yield item, start, part, self._loss(free, start, start + part), number, offset
                start, length, offset = start + part, length - part, offset + part


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_chars_col: str | None = None,
    cache_chunks: int = CACHE_CHUNKS,
) -> DataFrame:
    """Pieces of all documents, each document being its ids and then ``end_id``.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    loss_tokens (how many of the piece's tokens bear loss). ``prompt_chars_col`` holds
    the number of leading characters that are a prompt and bear no loss (null: none).
    Sequences are to be padded to ``limits.tokens`` unless their length is a power of
    two. A null text is empty and still has its end id; a null id stays null; repeated
    rows are packed each; an empty table gives no pieces.
    """
    prompt = F.lit(0) if prompt_chars_col is None else F.coalesce(F.col(prompt_chars_col).cast("int"), F.lit(0))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), prompt.alias("prompt"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, cache_chunks=cache_chunks)
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        packer = Packer(limits)
        first = TaskContext.get().partitionId() * TASK_SEQUENCES
        rows: list = []

        def emit(pieces):
            for (doc, raw), start, length, loss, number, offset in pieces:
                ids = np.frombuffer(raw, dtype=f"<u{encoder.width}", count=length, offset=start * encoder.width)
                rows.append((doc, start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(raw) // encoder.width, first + number, offset, loss))

        for batch in slices(batches):
            texts, prompts = batch.column("text").to_pylist(), batch.column("prompt").to_pylist()
            heads = encoder.encode([t[: max(p, 0)] if p > 0 else "" for t, p in zip(texts, prompts)]) if any(p > 0 for p in prompts) else [b""] * len(texts)
            for doc, raw, head in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), heads):
                whole = raw + end
                emit(packer.add((doc, whole), len(whole) // encoder.width, len(head) // encoder.width))
                if len(rows) >= OUT_ROWS:
                    yield _rows(rows)
                    rows.clear()
        emit(packer.finish())
        if rows:
            yield _rows(rows)

    return chosen.mapInArrow(tidied(pack), _PIECES)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(_ARROW, **dict(zip(_ARROW.names, map(list, zip(*rows)))))


def pack_lengths(examples: DataFrame, limits: Limits, id_col: str = "id", tokens_col: str = "tokens", prompt_col: str | None = None, cut: bool = False) -> DataFrame:
    """The same packing for examples of which only lengths are known: (id, start,
    length, loss_tokens, sequence_id, offset). Null lengths count as 0 and are not
    placed; without ``cut`` an example beyond the limits raises."""
    prompt = F.lit(0) if prompt_col is None else F.coalesce(F.col(prompt_col).cast("long"), F.lit(0))
    chosen = examples.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("tokens"), prompt.alias("prompt"))
    schema = "id long, start long, length long, loss_tokens long, sequence_id long, offset long"
    arrow = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(limits, cut), TaskContext.get().partitionId() * TASK_SEQUENCES

        def as_batch(pieces):
            rows = [(doc, start, length, loss, first + number, offset) for doc, start, length, loss, number, offset in pieces]
            return batch_of(arrow, **dict(zip(arrow.names, map(list, zip(*rows))))) if rows else None

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("id", "tokens", "prompt"))
            if out := as_batch(p for i, t, m in zip(*columns) for p in packer.add(i, t, m)):
                yield out
        if out := as_batch(packer.finish()):
            yield out

    return chosen.mapInArrow(tidied(pack), schema)
