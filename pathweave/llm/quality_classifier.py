"""Quality of texts by logistic regression over hashed word n-grams.

Words and runs of signs are hashed, alone and in pairs, into a fixed number of places; a
place's value is its share of the text's n-grams. Weights are learned one document at a
time by follow-the-regularised-leader, which leaves most places at exactly zero, and a
text is scored as the sparse dot product of its n-grams with the weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import batch_of, slices, texts_of, worker_state
from pathweave.llm.toxicity import held_out

#: So many documents of either label are learned from, at most.
SAMPLE_DOCS = 3000
#: Most numbers (place and value) that the sample brings to the driver.
SAMPLE_NUMBERS = 8_000_000
BITS = 18
EPOCHS = 3
#: Values are shares times this, so that steps of the learner have a usual size.
SCALE = 10.0
THRESHOLD = 0.7
CACHE_WORDS = 300_000
#: Words of longer texts are hashed piece by piece; counts add up.
PIECE_WORDS = 200_000

_word = re.compile(r"\w+|[^\w\s]+")
# fixed values: odd multipliers that spread bits of a hash
_MIX_FIRST, _MIX_SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)
#: The place of every pair of two equal words: saying a word again, whichever it is.
_AGAIN = 0
BIAS = 1 << BITS


class _Hashes(dict):
    """Hashes of words, kept once met; bounded."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


def _pieces(text: str, hashes: _Hashes) -> Iterator[np.ndarray]:
    """Hashes of the words in order, the last one of a piece again before the next."""
    held: list[int] = []
    for m in _word.finditer(text.lower()):
        held.append(hashes[m[0]])
        if len(held) > PIECE_WORDS:
            yield np.array(held, dtype=np.uint64)
            held = held[-1:]
    yield np.array(held, dtype=np.uint64)


def ngrams(text: str, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the whole text: every word and every pair of neighbours."""
    places, counts, first = [], [], True
    for h in _pieces(text, hashes):
        pairs = ((h[:-1] * _MIX_FIRST + h[1:] * _MIX_SECOND) >> _SHIFT).astype(np.int64)
        pairs[h[:-1] == h[1:]] = _AGAIN
        single = ((h if first else h[1:]) * _MIX_FIRST) >> _SHIFT
        p, c = np.unique(np.concatenate([single.astype(np.int64), pairs]), return_counts=True)
        places.append(p)
        counts.append(c)
        first = False
    if len(places) > 1:
        p, back = np.unique(np.concatenate(places), return_inverse=True)
        c = np.bincount(back, weights=np.concatenate(counts))
    else:
        p, c = places[0], counts[0].astype(np.float64)
    return p, c * (SCALE / max(c.sum(), 1.0))


class QualityModel:
    """Weights by place, the bias last; zero weights everywhere before learning."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(BIAS + 1, dtype=np.float32) if weights is None else weights

    def score(self, text: str, hashes: _Hashes) -> float:
        places, values = ngrams(text, hashes)
        z = float(self.weights[places].astype(np.float64) @ values + self.weights[BIAS])
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


class FtrlLearner:
    """Follow-the-regularised-leader, proximal, with a step of its own at each place."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.pull = np.zeros(BIAS + 1)
        self.seen = np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Those that would have been best so far, under the two penalties."""
        pull = self.pull[at]
        beyond = np.sign(pull) * np.maximum(np.abs(pull) - self.l1, 0)
        return -beyond / ((self.beta + np.sqrt(self.seen[at])) / self.alpha + self.l2)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> float:
        """One document; its probability before the update."""
        own = self.weights(places)
        p = 1 / (1 + math.exp(-min(max(float(own @ values), -500.0), 500.0)))
        slope = (p - label) * values
        before = self.seen[places]
        after = before + slope * slope
        self.pull[places] += slope - (np.sqrt(after) - np.sqrt(before)) / self.alpha * own
        self.seen[places] = after
        return p


def learn(documents: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> QualityModel:
    """A model of (places, values, label), gone through in a fixed shuffled order in
    each epoch; the bias is a place of its own with the value 1."""
    if len({label for _, _, label in documents}) < 2:
        return QualityModel()
    learner = FtrlLearner()
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(documents)):
            places, values, label = documents[i]
            learner.learn(np.append(places, BIAS), np.append(values.astype(np.float64), 1.0), label)
    return QualityModel(learner.weights().astype(np.float32))


_SAMPLE_DDL = "doc_id long, label int, tie int, places binary, counts binary"
_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("tie", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """A model of the labelled rows that are not held out.

    Of each label the ``sample_docs`` ids that come first by a hash of the id are used
    (equal ones once; of an id with several texts the one that is smallest by its
    hash). Their n-grams are counted in tasks; what reaches the driver are numbers, of
    ``SAMPLE_NUMBERS`` at most: documents behind that in the order of the hash are
    left out. Labels that are null or belong to no document are ignored; with fewer
    than two labels nothing is learned and every score is 0.5.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    picked = []
    for label in (0, 1):
        picked += usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    if not picked:
        return QualityModel()
    chosen = docs.sparkSession.createDataFrame(sorted((r.doc_id, r.label) for r in picked), "doc_id long, label int")
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    # one text for each id, folded before its n-grams are counted
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("quality-hashes", _Hashes)
        for batch in slices(batches):
            found = [ngrams(t, hashes) for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id")
            yield batch_of(
                _SAMPLE,
                doc_id=ids,
                label=batch.column("label"),
                tie=[zlib.crc32(str(i).encode()) & 0x7FFFFFFF for i in ids.to_pylist()],
                places=[p.astype(np.int32).tobytes() for p, _ in found],
                counts=[v.astype(np.float32).tobytes() for _, v in found],
            )

    counted = rows.mapInArrow(run, _SAMPLE_DDL)
    documents, numbers = [], 0
    for r in sorted(counted.toLocalIterator(), key=lambda r: (r.tie, r.doc_id, r.label)):
        places = np.frombuffer(r.places, dtype=np.int32)
        numbers += len(places)
        if numbers > SAMPLE_NUMBERS:
            break
        documents.append((places, np.frombuffer(r.counts, dtype=np.float32), r.label))
    return learn(documents)


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_DDL = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold``) for every row.

    Whole texts count, however long; their words are hashed in bounded pieces. A null
    or empty text has no n-grams and gets the score of the bias alone. A null id stays
    null and counts as not held out; repeated rows and ids are scored one by one and
    alike; a score that equals the threshold is predicted 1; an empty table gives an
    empty result; other columns play no part, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    rows = texts_of(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = QualityModel(shared.value), worker_state("quality-hashes", _Hashes)
        for batch in slices(batches):
            scores = [own.score(t, hashes) for t in batch.column("text").to_pylist()]
            yield batch_of(_RESULT, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=scores, predicted=[int(s >= threshold) for s in scores])

    return rows.mapInArrow(run, _DDL)
