"""Small tables with every awkward row, and brute-force answers."""

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept boolean, part string, score string"
EXTRA = ("x", "y", 3, "clash", True, "p", "s")


def frame(spark, rows):
    """(doc_id, text) rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, *EXTRA) for d, t in rows], SCHEMA)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward():
    """Null and empty texts, a null id, ties, repeated rows and ids, one long text."""
    long = " ".join(words(6000, 1))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "Ünïcödé wörds, and 'quotes' it's we'll <|endoftext|> end"),
        (6, long),
        (7, long),
        (7, "another text of the same id " * 3),
        (8, "same row"),
        (8, "same row"),
        (None, "no id at all but some words"),
        (10, "a  b\n\nc\x0bd\x1ce 12,345 ½"),
        (11, long[:9000] + " changed " + long[9000:]),
        (12, "\n".join(["line of words here"] * 9)),
    ]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def blanks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def rows_of(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
