"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of the codewords a binary n-gram classifier
tells the languages whose bit is one from the others. A text gets the language whose
codeword has the least loss under the classifiers' answers, each answer weighted by how
often it is right for that language; close seconds are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import batch_of, slices, texts_of
from pathweave.llm.toxicity import held_out

GRAM_BITS = 16
TABLE = 2 << GRAM_BITS  # pairs of bytes, then hashed triples
EXHAUSTIVE = 6
SMOOTHING = 0.5
UNKNOWN = "und"
#: A second language this close in score makes the answer ambiguous.
CLOSE = 0.15
_CHUNK = 1 << 19

#: ASCII capitals become small letters; all other ASCII than letters a blank.
_FOLD = np.array([c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)], dtype=np.uint32)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, pairs, triples): gram numbers of all texts, each between blanks; those
    of text n are at bounds[n]:bounds[n + 1] (its last two may span the next border)."""
    joined = b"".join(b"  " + t for t in texts) + b"    "
    raw = _FOLD[np.frombuffer(joined, dtype=np.uint8)]
    bounds = np.cumsum([0, *(len(t) + 2 for t in texts)])
    n = int(bounds[-1])
    pairs = raw[:n] << np.uint32(8) | raw[1 : n + 1]
    mixed = (pairs << np.uint32(8) | raw[2 : n + 2]) * np.uint32(2654435761)
    return bounds, pairs, (mixed >> np.uint32(32 - GRAM_BITS)) + np.uint32(1 << GRAM_BITS)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of -1 and 1: all ways to part the languages in two while these
    are few, else the best spread of a fixed series of random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        ways = np.arange(1, 1 << (n - 1))
        return np.where((ways[None, :] << 1 >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, best, spread = np.random.default_rng(7), None, -1
    length = 10 * int(np.ceil(np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, length))
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + length * np.eye(n, dtype=int)
        if abs(code.sum(axis=0)).max() < n and apart.min() > spread:
            best, spread = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # TABLE x bits, float32
    scale: np.ndarray  # per bit
    trust: np.ndarray  # languages x bits, rows sum to one

    def answers(self, texts: list[bytes]) -> np.ndarray:
        """The classifiers' answers, texts x bits: mean weights of a text's grams."""
        out = np.zeros((len(texts), self.code.shape[1]))
        bounds, *numbers = grams(texts)
        for low in range(0, int(bounds[-1]), _CHUNK):
            high = min(low + _CHUNK, int(bounds[-1]))
            first = int(np.searchsorted(bounds, low, side="right")) - 1
            last = int(np.searchsorted(bounds, high, side="left"))
            cuts = np.maximum(bounds[first:last], low) - low
            for part in numbers:
                out[first:last] += np.add.reduceat(self.weights[part[low:high]], cuts, axis=0)
        return out / np.maximum(np.diff(bounds), 1)[:, None] / self.scale

    def losses(self, answers: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text to each codeword."""
        agree = np.clip(answers, -3, 3)[:, None, :] * self.code[None]
        return (np.exp(-agree) * self.trust[None]).sum(axis=2)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        use = [n for n, t in enumerate(texts) if self.languages and any(map(str.isalpha, t))]
        if not use:
            return out
        losses = self.losses(self.answers([texts[n].encode() for n in use]))
        chance = np.exp(-2 * (losses - losses.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        ranked = np.sort(chance, axis=1)
        for n, k, own, row in zip(use, best.tolist(), chance, ranked):
            second = row[-2] if len(row) > 1 else 0.0
            out[n] = (self.languages[k], float(own[k]), bool(own[k] - second < CLOSE))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from every row with a language that isn't held out.

    One job sums up gram counts by language (a table of fixed size for each task and
    language), a second one counts how often each bit is answered rightly for each
    language. Rows without text or language are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    rows = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((TABLE, 1), dtype=np.float32), np.ones(1), np.ones((0, 1)))
    counts = np.zeros((len(languages), TABLE))
    # at most TABLE rows for each language, whatever the input
    sums = rows.mapInArrow(_count_grams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    owners = pa.compute.index_in(sums.column("lang"), pa.array(languages)).to_numpy()
    counts[owners, sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    code = codewords(len(languages))
    shares = counts + SMOOTHING
    for part in (slice(0, 1 << GRAM_BITS), slice(1 << GRAM_BITS, TABLE)):
        shares[:, part] /= shares[:, part].sum(axis=1, keepdims=True)
    weights = np.zeros((TABLE, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        ones, others = code[:, bit] > 0, code[:, bit] < 0
        if ones.any() and others.any():
            weights[:, bit] = np.log(shares[ones].mean(axis=0)) - np.log(shares[others].mean(axis=0))
    model = LanguageModel(languages, code, weights, np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    shared = spark.sparkContext.broadcast(model)
    right, size, seen = np.zeros(code.shape), np.zeros(code.shape), np.zeros(len(languages))
    for row in _judged(rows, shared).collect():
        k = languages.index(row.lang)
        right[k], size[k], seen[k] = row.correct, row.size, row.n
    trust = (right + 1) / (seen[:, None] + 2)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    model.scale = np.maximum(size.sum(axis=0) / max(seen.sum(), 1), 1e-6)
    return model


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])
    tables: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = np.array([t.encode() for t in batch.column("text").to_pylist()], dtype=object)
        for lang in set(langs.tolist()):
            _, pairs, triples = grams(texts[langs == lang].tolist())
            table = tables.setdefault(lang, np.zeros(TABLE, dtype=np.int64))
            table += np.bincount(pairs, minlength=TABLE) + np.bincount(triples, minlength=TABLE)
    for lang, table in tables.items():
        at = np.flatnonzero(table)
        yield batch_of(schema, lang=[lang] * len(at), gram=at.astype(np.int32), n=table[at])


def _judged(rows: DataFrame, shared) -> DataFrame:
    """Per language: texts, and per bit how many were answered rightly, and the sum of
    the answers' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        schema = pa.schema([("lang", pa.string()), ("bit", pa.int32()), ("n", pa.int64()), ("correct", pa.int64()), ("size", pa.float64())])
        right, size, seen = np.zeros(model.code.shape, dtype=np.int64), np.zeros(model.code.shape), np.zeros(len(model.languages), dtype=np.int64)
        places = {lang: n for n, lang in enumerate(model.languages)}
        for batch in slices(batches):
            own = np.array([places[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            answers = model.answers([t.encode() for t in batch.column("text").to_pylist()])
            np.add.at(right, own, np.sign(answers) == model.code[own])
            np.add.at(size, own, np.abs(answers))
            np.add.at(seen, own, 1)
        for k, lang in enumerate(model.languages):
            bits = model.code.shape[1]
            if seen[k]:
                yield batch_of(schema, lang=[lang] * bits, bit=np.arange(bits, dtype=np.int32), n=np.full(bits, seen[k]), correct=right[k], size=size[k])

    sums = rows.mapInArrow(run, "lang string, bit int, n long, correct long, size double")
    bits = sums.groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("size").alias("size"))
    ordered = F.array_sort(F.collect_list(F.struct("bit", "correct", "size")))
    packed = bits.groupBy("lang").agg(F.max("n").alias("n"), ordered.alias("b"))
    return packed.select("lang", "n", F.col("b.correct").alias("correct"), F.col("b.size").alias("size"))


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    under a model that has seen no language; a null id stays null; repeated rows get
    equal answers; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts_of(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = own.predict(batch.column("text").to_pylist())
            yield batch_of(
                _RESULT,
                doc_id=batch.column("doc_id"),
                held_out=batch.column("held_out"),
                lang_pred=[x[0] for x in found],
                score=[x[1] for x in found],
                ambiguous=[x[2] for x in found],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
