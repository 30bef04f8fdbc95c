"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is offensive with the logistic of the sum
of its words' weights; a document is toxic unless none of its sentences is (noisy-or).
The weights are learned from labels of documents alone, and then tell which sentences
are to blame.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import batch_of, slices, texts_of

#: So many documents of either label are learned from, at most.
SAMPLE_DOCS = 3000
#: Features in fewer toxic documents of the sample carry no weight.
LEAST_DOCS = 3
#: Lengths of the word beginnings that are features beside the words.
PREFIXES = (4, 5, 6)
EPOCHS = 200
CHANCE_DOCS = 1.0
#: The bias of a sentence when nothing is learned.
NO_BIAS = -6.0
CACHE_WORDS = 400_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
_sentence = re.compile(r"[^.!?\n]+")
_edges = ".,;:!?\"'()[]{}<>*#$%&|-"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is never learned from: by the crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence."""
    for m in _sentence.finditer(text):
        words = [w.strip(_edges) for w in m[0].lower().split()]
        if words:
            yield m.start(), m.end(), words


def features(word: str) -> list[str]:
    """A word and its beginnings, marked as such; inflected forms share the latter."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)]


class _WordWeights(dict):
    """Weights of words, summed up from their features when first met; bounded."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


class ToxicityModel:
    """Weights of word features and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.of = _WordWeights(weights)

    def __reduce__(self):
        return type(self), (self.weights, self.bias)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], epochs: int = EPOCHS, chance_docs: float = CHANCE_DOCS, rate: float = 0.5) -> ToxicityModel:
        """Maximum likelihood of the document labels under noisy-or, by proximal
        Adagrad: a feature stays at zero unless it does
        more than ``chance_docs`` documents could do by chance."""
        if not texts or len(set(labels)) < 2:
            return cls({}, NO_BIAS)
        # texts are gone through several times, so that only numbers are held of them
        guilty: Counter = Counter()
        for text, label in zip(texts, labels):
            if label:
                guilty.update(_features_of(text))
        seen = dict.fromkeys((f for f, c in guilty.items() if c >= LEAST_DOCS), 0)
        for text in texts:
            for f in _features_of(text) & seen.keys():
                seen[f] += 1
        # what is not more frequent in toxic documents can't show that a sentence is
        even = sum(labels) / len(labels)
        numbers = {f: n for n, f in enumerate(sorted(f for f, c in seen.items() if guilty[f] > even * c))}
        del guilty, seen
        feature, sentence, owner = array("i"), array("i"), array("i")
        for d, text in enumerate(texts):
            for _, _, words in sentences(text):
                known = [numbers[f] for f in {f for w in set(words) for f in features(w)} if f in numbers]
                feature.extend(known)
                sentence.extend([len(owner)] * len(known))
                owner.append(d)
        feature, sentence, owner = (np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, dtype=np.int32) for x in (feature, sentence, owner))
        toxic = np.array(labels) == 1
        share = 1 / len(texts)
        least = chance_docs * share
        weights, bias = np.zeros(len(numbers)), NO_BIAS
        speed, speed_b = np.full(len(numbers), 1e-8), 1e-8
        for _ in range(epochs):
            z = np.bincount(sentence, weights=weights[feature], minlength=len(owner)) + bias
            total = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(texts))
            slope = np.where(toxic, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * share
            slope = slope[owner] / (1 + np.exp(-z))
            down = np.bincount(feature, weights=slope[sentence], minlength=len(numbers))
            down_b = slope.sum()
            speed += down**2
            speed_b += down_b**2
            step = rate / np.sqrt(speed)
            weights -= step * down
            weights = np.sign(weights) * np.maximum(np.abs(weights) - step * least, 0)
            bias -= rate * down_b / math.sqrt(speed_b)
        evidence = np.bincount(sentence, weights=weights[feature], minlength=len(owner))
        bias = _calibrated(evidence, owner, toxic, bias)
        return cls({f: float(weights[n]) for f, n in numbers.items() if weights[n]}, bias)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and (start, end, score) of its sentences above the
        threshold, the worst first."""
        of, bias, total, worst = self.of.__getitem__, self.bias, 0.0, []
        for start, end, words in sentences(text):
            # a word counts once in a sentence, as in training
            z = bias + sum(map(of, set(words)))
            total += math.log1p(math.exp(z)) if z < 30 else z
            if z > -1:
                worst.append((start, end, 1 / (1 + math.exp(-min(z, 500)))))
        offending = sorted((s for s in worst if s[2] >= THRESHOLD), key=lambda s: (-s[2], s[0]))
        return min(max(-math.expm1(-total), 0.0), 1.0), offending


def _features_of(text: str) -> set[str]:
    return {f for w in {w for _, _, words in sentences(text) for w in words if w} for f in features(w)}


def _calibrated(evidence: np.ndarray, owner: np.ndarray, toxic: np.ndarray, bias: float) -> float:
    """The bias, from the learned one down, whose decisions at the threshold have the
    best F1 on the sample; the middle of several that are equally good."""
    found = []
    for candidate in np.arange(bias + 1, bias - 12, -0.25):
        total = np.bincount(owner, weights=np.logaddexp(0, evidence + candidate), minlength=len(toxic))
        said = -np.expm1(-total) >= THRESHOLD
        found.append((2 * (said & toxic).sum() / max(said.sum() + toxic.sum(), 1), float(candidate)))
    best = max(f for f, _ in found)
    good = [b for f, b in found if f >= best - 1e-9]
    return good[len(good) // 2]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model of the labelled rows that are not held out.

    Of each label the ``sample_docs`` documents that come first by a hash of their id
    are used; only these ids and texts reach the driver. Labels that are null or of
    unknown documents are ignored.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    picked = []
    for label in (0, 1):
        picked += usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    if not picked:
        return ToxicityModel({}, NO_BIAS)
    chosen = docs.sparkSession.createDataFrame(sorted({(r.doc_id, r.label) for r in picked}), "doc_id long, label int")
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = sorted(rows.limit(4 * sample_docs).collect())
    return ToxicityModel.fit([r.text for r in rows], [r.label for r in rows])


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_offending", pa.int32()), ("worst_start", pa.int32()), ("worst_end", pa.int32())])
_DDL = "doc_id long, held_out boolean, score double, predicted int, n_offending int, worst_start int, worst_end int"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and where: the number of offending sentences
    and the range of the worst one (null if none).

    A null or empty text has no sentences and scores 0; a null id stays null and counts
    as not held out; repeated rows score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts_of(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = [own.score(t) for t in batch.column("text").to_pylist()]
            scores = [s for s, _ in found]
            yield batch_of(
                _RESULT,
                doc_id=batch.column("doc_id"),
                held_out=batch.column("held_out"),
                score=scores,
                predicted=[int(s >= THRESHOLD) for s in scores],
                n_offending=[len(x) for _, x in found],
                worst_start=[x[0][0] if x else None for _, x in found],
                worst_end=[x[0][1] if x else None for _, x in found],
            )

    return rows.mapInArrow(run, _DDL)
