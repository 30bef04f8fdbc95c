"""Whole texts to token ids through the tokenizers library, chunk by chunk.

A byte-level or word-level BPE first cuts a text where white space meets a word and
then encodes every cut alone. So the ids of a text are those of its space-separated
chunks, one after the other, and a chunk seen before need not be encoded again. The
library encodes each new chunk; texts whose white space or special strings make such
cuts unsafe, and tokenizers of another kind, are given to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pathweave.llm.common import worker_state

# fixed values: how the two supported tokenizers cut words
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD_SEPARATORS = "\x1c\x1d\x1e\x1f"

CACHE_CHUNKS = 400_000
LONG_CHUNK = 64
GROUP = 256
#: Words of the table of ``ColumnEncoder``, and those given to the library in one call.
TABLE_WORDS = 400_000
CALL_WORDS = 50_000

# white space that does not part two words alone: all but single blanks and line ends
_ODD_SPACE = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# punctuation (but an apostrophe) right after a letter, where byte-level BPE cuts in any case
_WORD_END = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([,.;:!?#$%&*]+)"


class _Cache(dict):
    """Values by chunk; looks in the generation before, and notes what is new."""

    def __init__(self, before: dict, known: dict):
        super().__init__()
        self.before, self.known, self.pending = before, known, set()

    def __missing__(self, chunk):
        value = self.before.get(chunk)
        if value is None:
            value = self.known.get(chunk)
        if value is None:
            self.pending.add(chunk)
        else:
            self[chunk] = value
        return value


class ChunkEncoder:
    """``encode(texts)``: little-endian ids as bytes (two bytes an id while the
    vocabulary allows, ``width`` tells), or with ``counts`` their number.

    Memory is bounded: two generations of ``cache_chunks`` chunks, none of them
    longer than ``LONG_CHUNK`` characters, and the given ``known`` table.
    """

    def __init__(self, file: str, counts: bool = False, known: dict | None = None, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values(), default=0) + 1
        self.width = 2 if size <= 1 << 16 else 4
        self.counts, self.cache_chunks = counts, cache_chunks
        with open(file, encoding="utf-8") as lines:
            self.mode, self.special = _mode(json.load(lines))
        self.edge = np.zeros(size, dtype=bool)
        for token, number in vocabulary.items():
            self.edge[number] = token.startswith("Ġ") if self.mode == "bytes" else token.endswith("</w>")
        self.cache = _Cache({}, known or {})
        self.punctuation = {x: self._whole([x])[0] for x in ",.;:!?"} if self.mode else {}

    def encode(self, texts: list[str]) -> list:
        out = [self._empty()] * len(texts)
        for start in range(0, len(texts), GROUP):
            self._group(texts, start, min(start + GROUP, len(texts)), out)
        return out

    def chunks(self, text: str) -> list[str] | None:
        """What the text is cut into; None if it has to be encoded whole."""
        if not self.mode or any(x in text for x in self.special):
            return None
        if self.mode == "bytes":
            # single blanks and line ends between words, and no other white space
            if text.split() != text.replace("\n", " ").split(" "):
                return None
            return ("\r" + text.replace("\n", " \n")).split(" ")
        if any(x in text for x in _ODD_SEPARATORS):
            return None
        try:  # in Latin-1 lower case is one character for one, in any library
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return text.split()

    def _group(self, texts, start, stop, out):
        cache = self.cache
        look = cache.__getitem__
        cut, whole = {}, []
        for n in range(start, stop):
            if texts[n]:
                pieces = self.chunks(texts[n])
                if pieces is None:
                    whole.append(n)
                else:
                    cut[n] = (pieces, list(map(look, pieces)))
        once = {}
        if cache.pending:
            once = self._learn(cache.pending)
            cache.pending = set()
        for n, (pieces, values) in cut.items():
            if None in values:
                values = [once[p] if v is None else v for p, v in zip(pieces, values)]
            out[n] = sum(values) if self.counts else b"".join(values)
        for n, value in zip(whole, self._whole([texts[n] for n in whole])):
            out[n] = value
        if len(cache) > self.cache_chunks:
            self.cache = _Cache(dict(cache), cache.known)

    def _learn(self, chunks: set[str]) -> dict:
        """The values of new chunks; they go to the cache unless they are long."""
        found, stems, alone, joined = {}, {}, [], []
        for chunk in chunks:
            if chunk[-1] in self.punctuation and chunk[:-1].isalpha():
                stems[chunk] = chunk[:-1]
            elif self.mode == "bytes" and chunk[:1] not in "\n\r" or chunk.isalpha():
                joined.append(chunk)
            else:
                alone.append(chunk)
        more = {s for s in stems.values() if s not in chunks and self.cache.get(s) is None and s not in self.cache.before}
        joined += more
        found.update(self._joined(joined))
        texts = [c[1:] if c[:1] == "\r" else c for c in alone]
        found.update(zip(alone, self._whole(texts)))
        for chunk, stem in stems.items():
            value = found.get(stem)
            if value is None:
                value = self.cache[stem]
            found[chunk] = value + self.punctuation[chunk[-1]]
        self.cache.update((c, v) for c, v in found.items() if len(c) <= LONG_CHUNK)
        return found

    def _joined(self, chunks: list[str]) -> dict:
        """Many chunks in one call; ids that begin (or end) a chunk part them again."""
        if not chunks:
            return {}
        lead = " " if self.mode == "bytes" else ""
        ids = np.asarray(self.library.encode_batch_fast([lead + " ".join(chunks)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(chunks):
            return dict(zip(chunks, self._whole([lead + c for c in chunks])))
        bounds = [*at.tolist(), len(ids)] if self.mode == "bytes" else [0, *(at + 1).tolist()]
        if self.counts:
            return dict(zip(chunks, np.diff(bounds).tolist()))
        raw, w = ids.tobytes(), self.width
        return {c: raw[a * w : b * w] for c, a, b in zip(chunks, bounds, bounds[1:])}

    def _whole(self, texts: list[str]) -> list:
        if not texts:
            return []
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        if self.counts:
            return [len(x) for x in encoded]
        return [np.asarray(x.ids, dtype=f"<u{self.width}").tobytes() for x in encoded]

    def _empty(self):
        return 0 if self.counts else b""


class ColumnEncoder:
    """``encode(column)``: what ``ChunkEncoder`` gives, for an Arrow column of texts.

    With a byte-level BPE all words of a column are looked up at once in a table of
    words and their ids, kept as two Arrow arrays; only words it lacks are given to the
    library, so nothing in Python runs once a word. A word that stands without a blank
    before it (at the beginning, after a line end, punctuation after a letter) has
    ``\\r`` in front. Texts that can't be cut so are encoded whole, other tokenizers are
    left to ``ChunkEncoder``.

    Memory is bounded by the column and ``table_words`` words of at most ``LONG_CHUNK``
    characters; of a full table the half used most often stays.
    """

    def __init__(self, file: str, table_words: int = TABLE_WORDS):
        self.plain = ChunkEncoder(file)
        self.width, self.table_words = self.plain.width, table_words
        self.line_end = self.plain.library.token_to_id("Ċ")
        self.words, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.uses = np.zeros(0, dtype=np.int64)

    def encode(self, column: pa.Array) -> list[bytes]:
        if self.plain.mode != "bytes":
            return self.plain.encode(column.to_pylist())
        texts = column.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for special in self.plain.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = odd.to_numpy(zero_copy_only=False)
        cut = ~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        out = [b""] * len(texts)
        for rows, encode in ((cut, self._cut), (odd, lambda some: self.plain._whole(some.to_pylist()))):
            places = np.flatnonzero(rows)
            if len(places):
                for n, value in zip(places.tolist(), encode(texts.filter(pa.array(rows)))):
                    out[n] = value
        return out

    def _cut(self, texts: pa.Array) -> list[bytes]:
        texts = pc.replace_substring(texts, "\n", " \r\n \r")
        texts = pc.replace_substring_regex(texts, _WORD_END, "\\1 \r\\2")
        lists = pc.split_pattern(pc.binary_join_element_wise(_large("\r"), texts, _large("")), " ")
        known = len(self.words)
        # words of the table come first and are distinct, so they keep their places
        coded = pa.chunked_array([self.words, lists.flatten()]).dictionary_encode().chunks[-1]
        words, codes = coded.dictionary, coded.indices
        values = pa.concat_arrays([self.values, *self._learn(words[known:])])
        joined = values.take(codes)
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[lists.offsets.to_numpy()].tolist()
        ids = memoryview(joined.buffers()[2] or b"")
        self._keep(words, values, known, codes.to_numpy())
        return [bytes(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def _keep(self, words: pa.Array, values: pa.Array, known: int, codes: np.ndarray) -> None:
        uses = np.bincount(codes, minlength=len(words))
        uses[:known] += self.uses
        kept = np.ones(len(words), dtype=bool)
        kept[known:] = pc.utf8_length(words[known:]).to_numpy() <= LONG_CHUNK
        if kept.sum() > self.table_words:
            order = np.argsort(np.where(kept, -uses, 1), kind="stable")
            kept[order[self.table_words // 2 :]] = False
            uses //= 2
        if not kept.all():
            chosen = pa.array(np.flatnonzero(kept))
            words, values, uses = words.take(chosen), values.take(chosen), uses[kept]
        self.words, self.values, self.uses = words, values, uses

    def _learn(self, words: pa.Array) -> list[pa.Array]:
        return [self._values(words[n : n + CALL_WORDS]) for n in range(0, len(words), CALL_WORDS)]

    def _values(self, words: pa.Array) -> pa.Array:
        """The ids of some words, encoded as one text: blanks and line ends part them again."""
        at = pc.index(words, _large("\r\n")).as_py()
        if at >= 0:
            alone = pa.array(self.plain._whole(["\n"]), pa.large_binary())
            return pa.concat_arrays([self._values(words[:at]), alone, self._values(words[at + 1 :])])
        text = " ".join(["", *words.to_pylist()]).replace(" \r", "\n")
        ids = np.asarray(self.plain.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        line = ids == (-1 if self.line_end is None else self.line_end)
        starts = np.flatnonzero(self.plain.edge[ids] | line)
        if len(starts) != len(words):
            texts = [w[1:] if w[0] == "\r" else " " + w for w in words.to_pylist()]
            return pa.array(self.plain._whole(texts), pa.large_binary())
        sizes = np.diff([*starts, len(ids)]) - line[starts] if len(starts) else []
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * self.width
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids[~line])])


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _mode(spec: dict) -> tuple[str | None, list[str]]:
    """'bytes', 'words' or None (encode whole texts), and the special strings."""
    special = [x["content"] for x in spec.get("added_tokens") or []]
    model, cutter, changes = spec.get("model", {}), spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout"):
        return None, special
    if cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and changes is None:
        return "bytes", special
    steps = cutter.get("pretokenizers") or [{}]
    pattern = (steps[0].get("pattern") or {}).get("Regex")
    kinds = [x.get("type") for x in (changes or {}).get("normalizers", [])]
    if pattern == _WORD_PATTERN and model.get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"]:
        return "words", special
    return None, special


def worker_encoder(file: str, counts: bool = False, cache_chunks: int = CACHE_CHUNKS) -> ChunkEncoder:
    """The encoder of this Python worker, kept over tasks."""
    return worker_state((f"encoder-{counts}", file, cache_chunks), lambda: ChunkEncoder(file, counts, cache_chunks=cache_chunks))


def worker_column_encoder(file: str) -> ColumnEncoder:
    """The column encoder of this Python worker, kept over tasks."""
    return worker_state(("column-encoder", file), lambda: ColumnEncoder(file))
