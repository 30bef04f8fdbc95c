"""Secret scan: fixed patterns, and a linear-chain CRF that adds spans of its own.

The CRF tags tokens as begin, inside or outside of a secret, from their shape, the words
around them and features of the file, and is decoded by Viterbi. It learns from the
spans of the patterns in a bounded sample of windows, so it finds values that look and
stand like secrets without having the length or the keyword a pattern asks for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.common import batch_of, slices, texts_of, tidied
from pathweave.session import stored_table

# fixed values: the base patterns, their kinds in order, and least lengths
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE, ACCESS_CHARS = 12, 18
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KEYWORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "access", "private")
#: Of a token's neighbours the window holds so many on each side.
REACH = 6
WINDOW = 32
BUCKETS = 1 << 14
FEATURES = 14
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SAMPLE_WINDOWS = 4000
EPOCHS = 60
_NEVER = -1e4

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_digit = re.compile(r"[0-9]")
_token = re.compile(r"[A-Za-z0-9+/_\-]+|[^\W\d_]+|[^\s]")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret value) by start, then kind."""
    found = []
    lower = text.lower()
    if any(x in lower for x in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _access.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end(), m.start()) for m in _hex.finditer(text)]
    return sorted(found)


def _shape(word: str) -> str:
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "9", word)))
    return shape if len(shape) <= 4 else f"{shape[:2]}~{'9' in shape}{'A' in shape}{'a' in shape}"


def _hashed(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={value}".encode()) % BUCKETS


class Document:
    """Tokens of a text and the windows in which a secret may begin."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in _token.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.suspect = [_suspect(self.words, n) for n in range(len(self.words))]
        digits = sum(map(str.isdigit, text))
        self.file = (len(text).bit_length(), round(20 * digits / max(len(text), 1)), "\n" in text)

    def windows(self) -> Iterator[tuple[int, int]]:
        """Token ranges that hold all suspects with ``REACH`` neighbours each."""
        start = stop = None
        for n, suspect in enumerate(self.suspect):
            if suspect:
                if stop is not None and n - REACH > stop:
                    yield start, stop
                    start = None
                start = max(0, n - REACH) if start is None else start
                stop = min(len(self.words), n + REACH + 1)
        if stop is not None:
            yield start, stop

    def features(self, n: int) -> list[int]:
        word = self.words[n]
        near = lambda k: self.words[n + k].lower() if 0 <= n + k < len(self.words) else ""
        around = "".join(near(-k) for k in (4, 3, 2, 1))
        kinds = sum(bool(re.search(p, word)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        return [
            _hashed("bias", 1),
            _hashed("shape", _shape(word)),
            _hashed("size", len(word).bit_length()),
            _hashed("shape and size", (_shape(word), min(len(word), 40) // 4)),
            _hashed("kinds", kinds),
            _hashed("hex", bool(re.fullmatch(r"[0-9a-f]+", word))),
            _hashed("variety", round(4 * len(set(word)) / len(word))),
            _hashed("before", near(-1)),
            _hashed("before 2", (near(-2), near(-1))),
            _hashed("after", near(1)),
            _hashed("keyword", next((k for k in KEYWORDS if k in around), "")),
            _hashed("glued", n > 0 and self.spans[n - 1][1] == self.spans[n][0]),
            _hashed("file", self.file[:2]),
            _hashed("lines", self.file[2]),
        ]

    def constraints(self, n: int) -> tuple[float, float]:
        """What begin and inside are charged: a secret begins at a suspect and goes on
        without a gap. Outside the windows nothing else than outside is possible."""
        glued = n > 0 and self.spans[n - 1][1] == self.spans[n][0]
        return (0.0 if self.suspect[n] else _NEVER), (0.0 if glued else _NEVER)

    def labels(self, base: list[tuple[int, int, int, int]]) -> list[int]:
        out = [OUTSIDE] * len(self.words)
        at = 0
        for _, _, end, value in base:
            while at < len(self.spans) and self.spans[at][1] <= value:
                at += 1
            n, first = at, True
            while n < len(self.spans) and self.spans[n][0] < end:
                out[n] = max(out[n], BEGIN) if first else INSIDE
                first, n = False, n + 1
        return out


def _suspect(words: list[str], n: int) -> bool:
    word = words[n]
    if len(word) < 6:
        return False
    if any("0" <= c <= "9" for c in word):
        return True
    if word.isalpha() and (word.islower() or word.istitle()) and len(word) < 12:
        return False
    return n > 1 and words[n - 1] in "=:\"'" and any(k in "".join(words[max(0, n - 4) : n]).lower() for k in KEYWORDS)


def _may_hold(text: str) -> bool:
    """False only for texts without any suspect."""
    return bool(_digit.search(text)) or any(k in text.lower() for k in KEYWORDS)


class Crf:
    """Emission weights of hashed features and transitions between the three tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights.astype(np.float64), moves.astype(np.float64)

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, allowed: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS, decay: float = 1e-3) -> Crf:
        """Maximum likelihood by Adagrad over full forward-backward passes.

        features: windows x WINDOW x FEATURES; labels: windows x WINDOW; allowed: what
        begin and inside are charged, windows x WINDOW x 2; lengths: tokens of each.
        """
        weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
        speed_w, speed_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
        windows, steps, _ = features.shape
        real = np.arange(steps)[None, :] < lengths[:, None]
        gold = np.eye(3)[labels] * real[..., None]
        pairs = real[:, 1:]
        counts = np.einsum("wsi,wsj->ij", gold[:, :-1] * pairs[..., None], gold[:, 1:]) if windows else moves
        for _ in range(epochs if windows else 0):
            score = weights[features].sum(axis=2)
            score[..., 1:] += allowed
            forward, backward = np.zeros_like(score), np.zeros_like(score)
            forward[:, 0] = score[:, 0]
            for s in range(1, steps):
                forward[:, s] = _log_sum(forward[:, s - 1][:, :, None] + moves[None], 1) + score[:, s]
            for s in range(steps - 2, -1, -1):
                after = _log_sum(moves[None] + (score[:, s + 1] + backward[:, s + 1])[:, None, :], 2)
                backward[:, s] = np.where(pairs[:, s][:, None], after, 0.0)
            both = forward + backward
            chance = np.exp(both - _log_sum(both, 2)[..., None]) * real[..., None]
            joint = forward[:, :-1, :, None] + moves + (score + backward)[:, 1:, None, :]
            joint = np.exp(joint - joint.max(axis=(2, 3), keepdims=True))
            joint = joint / joint.sum(axis=(2, 3), keepdims=True) * pairs[..., None, None]
            slope_m = (joint.sum(axis=(0, 1)) - counts) / windows + decay * moves
            slope_w = np.zeros_like(weights)
            np.add.at(slope_w, features.reshape(-1), np.repeat((chance - gold).reshape(-1, 3), features.shape[2], axis=0))
            slope_w = slope_w / windows + decay * weights
            speed_w += slope_w**2
            speed_m += slope_m**2
            weights -= 0.5 * slope_w / np.sqrt(speed_w)
            moves -= 0.5 * slope_m / np.sqrt(speed_m)
        return cls(weights, moves)

    def decode(self, features: list[list[int]], allowed: list[tuple[float, float]]) -> list[int]:
        """The most likely tags of a window (Viterbi)."""
        score = self.weights[np.array(features)].sum(axis=1).tolist()
        moves = self.moves.tolist()
        best, back = None, []
        for emission, (begin, inside) in zip(score, allowed):
            own = (emission[0], emission[1] + begin, emission[2] + inside)
            if best is None:
                best = [own[0], own[1], own[2] + _NEVER]
                continue
            step, came = [], []
            for tag in range(3):
                ways = [best[k] + moves[k][tag] + (_NEVER if tag == INSIDE and k == OUTSIDE else 0.0) for k in range(3)]
                k = max(range(3), key=ways.__getitem__)
                step.append(ways[k] + own[tag])
                came.append(k)
            best = step
            back.append(came)
        tag = max(range(3), key=best.__getitem__)
        tags = [tag]
        for came in reversed(back):
            tag = came[tag]
            tags.append(tag)
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


_SAMPLE = pa.schema([("rank", pa.int64()), ("positive", pa.bool_()), ("features", pa.binary()), ("labels", pa.binary()), ("allowed", pa.binary()), ("length", pa.int32())])

_SAMPLE_DDL = "rank long, positive boolean, features binary, labels binary, allowed binary, length int"


def fit(docs: DataFrame, text_col: str = "text", sample_windows: int = SAMPLE_WINDOWS) -> Crf:
    """A CRF fitted to windows of the table, labelled by the base patterns.

    Of all windows with a secret, and of all without, the ``sample_windows`` that come
    first by a hash of their features and labels are taken, equal ones once; that is all
    the driver ever holds. Without any window the CRF has no weights and adds nothing.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, set] = {True: set(), False: set()}
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for row in _sample_windows(text):
                    held[row[1]].add(row)
            for kind, rows in held.items():
                if len(rows) > 2 * sample_windows:
                    held[kind] = set(sorted(rows)[:sample_windows])
        rows = [row for kind in held.values() for row in sorted(kind)[:sample_windows]]
        if rows:
            yield batch_of(_SAMPLE, **dict(zip(_SAMPLE.names, map(list, zip(*rows)))))

    windows = stored_table(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(sample, _SAMPLE_DDL), "secret-windows")
    taken = []
    for kind in (F.col("positive"), ~F.col("positive")):
        taken += windows.where(kind).distinct().orderBy("rank", "labels", "features", "allowed").limit(sample_windows).collect()
    if not taken:
        return Crf(np.zeros((BUCKETS, 3)), np.zeros((3, 3)))
    shape = (len(taken), WINDOW)
    features, labels, allowed = np.zeros((*shape, FEATURES), dtype=np.int64), np.zeros(shape, dtype=np.int64), np.zeros((*shape, 2))
    for n, row in enumerate(taken):
        k = row.length
        features[n, :k] = np.frombuffer(row.features, "<u2").reshape(k, FEATURES)
        labels[n, :k] = np.frombuffer(row.labels, "u1")
        allowed[n, :k] = np.frombuffer(row.allowed, "<f4").reshape(k, 2)
    return Crf.fit(features, labels, allowed, np.array([r.length for r in taken]))


def _sample_windows(text: str) -> Iterator[tuple]:
    """Rows of ``_SAMPLE`` for the windows of a text, labelled by the base spans; a long
    window is cut into pieces that begin anew."""
    if not _may_hold(text):
        return
    document = Document(text)
    if not any(document.suspect):
        return
    labels = document.labels(base_spans(text))
    pieces = ((a, min(stop, a + WINDOW)) for start, stop in document.windows() for a in range(start, stop, WINDOW))
    for start, stop in pieces:
        features = np.array([document.features(n) for n in range(start, stop)], dtype="<u2").tobytes()
        allowed = np.array([document.constraints(n) for n in range(start, stop)], dtype="<f4").tobytes()
        tags = np.array(labels[start:stop], dtype="u1").tobytes()
        rank = int.from_bytes(hashlib.blake2b(features + allowed + tags, digest_size=8).digest(), "little", signed=True)
        yield (rank, any(tags), features, tags, allowed, stop - start)


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(x, T.LongType()) for x in ("n_assign", "n_access", "n_hex", "n_crf")),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_assign", "n_access", "n_hex", "n_crf")), ("base_sha256", pa.string()), ("spans", pa.string())])


def all_spans(text: str, crf: Crf) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans and of CRF spans that overlap none of them."""
    base = base_spans(text)
    found = [x[:3] for x in base]
    if not _may_hold(text):
        return found
    document = Document(text)
    taken = sorted((a, b) for a, _, b in found)
    extra = []
    for start, stop in document.windows():
        tags = crf.decode([document.features(n) for n in range(start, stop)], [document.constraints(n) for n in range(start, stop)])
        for n, tag in enumerate(tags, start):
            if tag == BEGIN:
                extra.append(list(document.spans[n]))
            elif tag == INSIDE:
                extra[-1][1] = document.spans[n][1]
    at = 0
    for a, b in extra:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(x < b and a < y for x, y in taken[at : at + 4]):
            found.append((a, 3, b))
    return sorted(found)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of each row: doc_id, n_assign, n_access, n_hex, n_crf,
    base_sha256 and spans (``kind:start:end`` in code points, by start).

    Without a given ``crf`` one is fitted to the table first, which runs a job. A null
    or empty text has no spans; a null id stays null; repeated rows give equal rows;
    other columns play no part; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf or fit(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = all_spans(text, model.value)
                kinds = [kind for _, kind, _ in spans]
                base = _listed([x for x in spans if x[1] < 3])
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), _listed(spans)))
            columns = dict(zip(_ARROW.names[1:], map(list, zip(*rows)))) if rows else {n: [] for n in _ARROW.names[1:]}
            yield batch_of(_ARROW, doc_id=batch.column("doc_id"), **columns)

    return texts_of(docs, id_col, text_col).mapInArrow(run, _RESULT)


def mask(docs: DataFrame, crf: Crf | None = None, text_col: str = "text", sign: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a text replaced by ``sign``; a null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(crf or fit(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [x if x is None else hide(x, all_spans(x, model.value), sign) for x in batch.column(text_col).to_pylist()]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    return docs.mapInArrow(tidied(run), docs.schema)


def hide(text: str, spans: list[tuple[int, int, int]], sign: str) -> str:
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            if start >= at:
                parts += [text[at:start], sign]
            at = end
    return "".join([*parts, text[at:]]) if parts else text
