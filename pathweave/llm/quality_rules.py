"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
long with a bit for each failed rule; a policy is a versioned set of rules, so it is
applied, compared and ablated on the ledger alone, by bitwise operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.common import numbered_columns, slices, texts_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; true rejects the document."""

    name: str
    fails: str


#: A rule's bit is its place here; new rules go to the end, so that old ledgers hold.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "2 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("some_symbols", "10 * n_symbols > n_words"),
    Rule("some_repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", "word_chars > 25 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")
#: The rules each policy version rejects by.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "repeated_lines", "short_words"),
    "strict": tuple(r.name for r in RULES),
}
DEFAULT_POLICY = "v1"

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Prefix of columns added beside those of the caller.
_OWN = "_ledger_"


def _entered(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with the measurements and the failure bits added, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = measure_texts([x or "" for x in batch.column(text_col).to_pylist()])
            for name in _MEASURES:
                batch = batch.append_column(_OWN + name, pa.array(found[name], type=pa.int64()))
            yield batch

    schema = T.StructType([*rows.schema.fields, *(T.StructField(_OWN + name, T.LongType()) for name in _MEASURES)])
    failed = F.lit(0).cast("long")
    for n, rule in enumerate(RULES):
        fails = F.expr(re.sub(r"[a-z]\w+", lambda m: _OWN + m[0], rule.fails))
        failed = failed.bitwiseOR(F.when(fails, F.lit(1 << n)).otherwise(F.lit(0)).cast("long"))
    return rows.mapInArrow(run, schema).withColumn(_OWN + "failed", failed)


def measure_texts(texts: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {x: [] for x in _MEASURES}
    numbers: list[int] = []
    lengths = []
    for text in texts:
        raw = text.encode()
        words = raw.split()
        # a word's number is the place where its document has it first
        seen: dict[bytes, int] = {}
        numbers.extend(map(seen.setdefault, words, count(len(numbers))))
        lengths.append(len(words))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(map(text.count, BLANKS)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    covered = np.concatenate([[0], np.cumsum(repeated(np.array(numbers, dtype=np.int64)))])
    ends = np.cumsum([0, *lengths])
    out["n_repeat_words"] = np.diff(covered[ends]).tolist()
    return out


def repeated(words: np.ndarray) -> np.ndarray:
    """Which words lie in a window of ``WINDOW`` words that occurs twice or more.

    A window can only repeat if each pair of neighbours in it does; what survives that
    is compared word by word. Words of different documents have different numbers, so
    no window over a border repeats.
    """
    n = len(words)
    if n <= WINDOW:
        return np.zeros(n, dtype=bool)
    _, pair, times = np.unique(words[:-1] * n + words[1:], return_inverse=True, return_counts=True)
    again = np.concatenate([[0], np.cumsum(times[pair] > 1)])
    starts = np.flatnonzero(again[WINDOW - 1 :] - again[: n - WINDOW + 1] == WINDOW - 1)
    windows = np.ascontiguousarray(words[starts[:, None] + np.arange(WINDOW)])
    _, window, times = np.unique(windows.view(f"V{8 * WINDOW}").ravel(), return_inverse=True, return_counts=True)
    starts = starts[times[window] > 1]
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return np.cumsum(edges)[:n] > 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed`` (the bits of failed rules) of each row.

    Words are runs of anything but blanks (space, tab, line ends, \\v, \\f). A null or
    empty text has no words and zeros throughout; a null id stays null; repeated rows
    are measured each; other columns play no part; an empty table gives an empty one.
    """
    entered = _entered(texts_of(docs, id_col, text_col), "text")
    return entered.select("doc_id", *(F.col(_OWN + x).alias(x) for x in (*_MEASURES, "failed")))


def mask(rules: tuple[str, ...]) -> int:
    places = {rule.name: n for n, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in set(rules))


def passes(policy: str = DEFAULT_POLICY, failed: str = "failed") -> Column:
    """Whether a ledger row is kept under a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(stored: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of the policy: (rule, n_failed, n_only, n_kept_without): documents
    that fail it, that fail it alone, and that would be kept if it were dropped. Rows
    are first summed up by their bits, of which there are at most 2 ** rules."""
    whole = mask(POLICIES[policy])
    patterns = stored.select(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.*")
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    rest = F.col("bits").bitwiseAND(F.lit(whole).cast("long").bitwiseXOR(F.col("bit")))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(rest == 0).alias("n_kept_without"),
    )


def judge(docs: DataFrame, policy: str = DEFAULT_POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (false if base_failed)."""
    base = ~passes("base")
    return ledger(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))


def keep_good(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, without a shuffle. Columns
    may have any names."""
    plain, text = numbered_columns(docs, text_col)
    return _entered(plain, text).where(passes(policy, _OWN + "failed")).select(*plain.columns).toDF(*docs.columns)
