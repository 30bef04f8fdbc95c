"""Token files, token counts and packing against the tokenizers themselves."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pathweave.llm import packing, token_counts, token_files
from pathweave.llm.chunk_encoder import ChunkEncoder, ColumnEncoder, worker_column_encoder
from pathweave.session import shared_folder
from tests.llm.helpers import awkward, crc, frame, ordered, rows_of, words

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_librarys_ids(path, monkeypatch):
    monkeypatch.setattr("pathweave.llm.chunk_encoder.CACHE_CHUNKS", 50)  # generations change
    texts = [t or "" for _, t in awkward()] + ["İ ΣΑΣ naïve", "x.y,z. a_b", "tab\tx", "'s 're", "日本語 テスト。", " lead", "trail\n", "é́ e"]
    for _ in range(2):
        encoder = ChunkEncoder(path)
        assert [memoryview(x).cast("H").tolist() for x in encoder.encode(texts)] == [ids_of(path, t) for t in texts]
        assert ChunkEncoder(path, counts=True).encode(texts) == [len(ids_of(path, t)) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_columns_give_the_librarys_ids(path, monkeypatch):
    monkeypatch.setattr("pathweave.llm.chunk_encoder.CALL_WORDS", 30)
    draw = random.Random(4)
    parts = [*"ab'.,!#é\u0141λ語٣7\r\t\u00a0\x1c\u200b\u0120\u0301\U0001f600", " ", " ", "\n", "'s", "'LL", "don't", "can,", "<|endoftext|>", "word", "x" * 90]
    texts = [t or "" for _, t in awkward()] + ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(3000)]
    texts += [" ".join(draw.choices(["It's,", "a.b", "end.\nNext", "it'd!", "l'eau;", "\u0141,", "٣.", "é?'s"], k=9)) for _ in range(300)]
    encoder = ColumnEncoder(path, table_words=40)
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (len(texts), 100):
        got = []
        for start in range(0, len(texts), size):
            got += encoder.encode(pa.array(texts, pa.string())[start : start + size])
            assert len(encoder.words) <= 40
        assert [memoryview(x).cast("H").tolist() for x in got] == want
    assert encoder.encode(pa.array([], pa.string())) == []


def test_no_object_is_made_for_each_word():
    text = " ".join(words(100, 3) * 3000)
    column = pa.array([text])
    encoder = worker_column_encoder(BYTES)
    first = encoder.encode(column)
    tracemalloc.start()
    again = encoder.encode(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again == first == ChunkEncoder(BYTES).encode([text])
    assert peak < 5 * len(first[0])  # Python strings of the words: 36 times


def test_files_round_trip(spark):
    rows = awkward()
    docs = frame(spark, rows)
    folder = shared_folder(spark, "test-tokens")
    token_files.write_tokens(docs, folder, BYTES, partitions=3, shard_bytes=4000)
    stored = [(d, ids_of(BYTES, t) + [2]) for d, t in rows]
    stored.sort(key=lambda r: (r[0] is not None, r[0], b"".join(i.to_bytes(2, "little") for i in r[1])))
    want, start = [], 0
    for d, ids in stored:
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows_of(token_files.catalogue(spark, folder, docs), "doc_id", "start", "n_tokens", "ids_crc32") == ordered(want)
    keys = spark.createDataFrame([(4,), (6,), (999,)], "doc_id long")
    assert {r.doc_id: list(r.ids) for r in token_files.read_ids(spark, folder, keys).collect()} == {d: i for d, i in stored if d in (4, 6)}


def test_a_key_opens_its_shard_alone(spark, monkeypatch):
    docs = frame(spark, [(n, " ".join(words(80, n))) for n in range(300)])
    folder = shared_folder(spark, "test-tokens")
    token_files.write_tokens(docs, folder, BYTES, partitions=4, shard_bytes=1500)
    everything = token_files._files(spark, folder).inputFiles()
    assert len(everything) > 20
    for key in (0, 77, 150, 299):
        keys = spark.createDataFrame([(key,)], "doc_id long")
        places = token_files.locate(spark, folder, keys)
        opened = token_files._files_of(spark, folder, places)
        assert len(opened.inputFiles()) == 1
        assert token_files.open_shard(bytes(opened.first().content))[0] == places.first().shard
    keys = spark.createDataFrame([(n,) for n in range(0, 300, 7)] + [(5000,)], "doc_id long")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {n: ids_of(BYTES, texts[n]) + [2] for n in range(0, 300, 7)}
    for most in (token_files.MOST_OPENED, 3):
        monkeypatch.setattr(token_files, "MOST_OPENED", most)
        assert {r.doc_id: list(r.ids) for r in token_files.read_ids(spark, folder, keys).collect()} == want
    assert token_files.read_ids(spark, folder, keys.where("doc_id > 4000")).count() == 0


def test_equal_hashes_are_refused():
    import numpy as np

    with pytest.raises(ValueError, match="same 64-bit hash"):
        token_files.perfect_hash(np.array([5, 5, 9], dtype=np.uint64))


def test_empty_files(spark):
    docs = frame(spark, [])
    folder = shared_folder(spark, "test-tokens")
    token_files.write_tokens(docs, folder, BYTES)
    assert token_files.catalogue(spark, folder, docs).count() == 0


def test_perfect_hash_is_minimal():
    import numpy as np

    for n in (1, 2, 7, 1000):
        hashes = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        seeds = token_files.perfect_hash(hashes)
        slots = token_files._slots(hashes, seeds[token_files._groups(hashes, n)], n)
        assert sorted(slots.tolist()) == list(range(n))


def test_counts(spark):
    rows = awkward()
    got = rows_of(token_counts.count_tokens(frame(spark, rows), BYTES, limit=20), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len((t or "").encode()), len(ids_of(BYTES, t)), len(ids_of(BYTES, t)) > 20) for d, t in rows]
    assert got == ordered(want)
    assert token_counts.count_tokens(frame(spark, []), BYTES).count() == 0


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = awkward()
    got = rows_of(token_counts.count_tokens(frame(spark, rows), model), "doc_id", "n_tokens")
    assert got == ordered([(d, len(library.encode(t or ""))) for d, t in rows])


def test_packing_is_exact_and_full(spark):
    rows = awkward()
    limits = packing.Limits(tokens=256, segments=4, loss_tokens=256)
    pieces = packing.pack_documents(frame(spark, rows), WORDS, limits=limits).collect()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:n]) for n in range(len(own))]
        total = sum(p.length for p in own)
        assert len(own) <= 4 and (total == 256 or total & (total - 1) == 0)
    stored = ordered([(d, *ids_of(WORDS, t), 2) for d, t in rows])
    assert sum(p.length for p in pieces) == sum(len(s) - 1 for s in stored)
    for d, t in rows:
        if d not in (7, 8):
            ids, at = ids_of(WORDS, t) + [2], 0
            for p in sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                assert p.ids_crc32 == crc(ids[at : at + p.length])
                at += p.length
            assert at == len(ids)


def test_packing_keeps_every_limit(spark):
    examples = spark.createDataFrame([(i, i * 7 % 90 + 1, i * 3 % 40) for i in range(500)] + [(900, None, None)], "id long, tokens long, prompt long")
    limits = packing.Limits(tokens=100, segments=5, loss_tokens=60)
    for cut in (True,):
        rows = packing.pack_lengths(examples, limits, prompt_col="prompt", cut=cut).collect()
        for number in {r.sequence_id for r in rows}:
            own = [r for r in rows if r.sequence_id == number]
            assert sum(r.length for r in own) <= 100 and len(own) <= 5 and sum(r.loss_tokens for r in own) <= 60
        assert sum(r.length for r in rows) == sum(i * 7 % 90 + 1 for i in range(500))
    short = examples.where("tokens < 50")
    whole = packing.pack_lengths(short, limits, prompt_col="prompt").collect()
    assert len(whole) == short.count()
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0
