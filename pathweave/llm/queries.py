"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import (
    code_compression,
    decontamination,
    hard_negatives,
    jaccard_join,
    language_id,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
)
from pathweave.llm.common import table
from pathweave.session import shared_folder


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "token-files")
    token_files.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.catalogue(spark, folder, docs)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(len(h) // 2)) AS p FROM d),
windows AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS w FROM starts WHERE 2 * p + 100 <= len(h)),
lows AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
repeats AS MATERIALIZED (SELECT doc_id, p FROM windows JOIN lows USING (w) WHERE low < doc_id),
jumps AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true)::INT AS jump FROM repeats),
runs AS (SELECT doc_id, p, sum(jump) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM jumps),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, g),
pieces AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM spans),
summed AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN summed USING (doc_id)
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), size=4, threshold=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, ws[i + 1 : i + size] AS g
  FROM (SELECT doc_id, ws, least(len(ws), 4) AS size, unnest(range(len(ws) - least(len(ws), 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS low FROM documents
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.low) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
windows AS (
  SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM words),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows WHERE len(g) = 8) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS s(k) GROUP BY r),
counted AS (SELECT r, count(*) AS n, sum(length(w)) AS c FROM words GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(DISTINCT l) AS u
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, coalesce(counted.n, 0) AS n_words, coalesce(counted.c, 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.n - lines.u, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN counted USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
f AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (2 * n_symbols > n_words)::BIGINT
    + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (10 * n_symbols > n_words)::BIGINT
    + 64 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 128 * (word_chars > 25 * n_words)::BIGINT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept, n_lines, failed FROM f
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP9_SQL = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents, fold),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark, fold WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, size, ws[i + 1 : i + size] AS g
  FROM (SELECT item_id, ws, least(len(ws), 13) AS size, unnest(range(len(ws) - least(len(ws), 13) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT r, i, size, ws[i + 1 : i + size] AS g
  FROM (SELECT r, ws, size, unnest(range(len(ws) - size + 1)) AS i FROM d, sizes WHERE len(ws) >= size)),
met AS (SELECT r, i, w.size, item_id FROM doc_windows w JOIN item_windows v ON w.size = v.size AND w.g = v.g),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM met, range(13) AS s(k) WHERE k < size GROUP BY r),
own AS (
  SELECT r, count(*) AS n, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h
  FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
  coalesce(own.h, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP11_SQL = r"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS g
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = c.label AS same, c.r, c.vec_id, list_dot_product(a.g, c.g)::BIGINT AS score
  FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS n FROM s WHERE same QUALIFY n <= 5),
m AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.n ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""


def op12_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(table(spark, sf_dir, "embeddings"))


#: One round: every part to its nearest entry, then the means of the parts.
_OP12_ROUND = """
a{n} AS MATERIALIZED (
  SELECT r, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d FROM (
    SELECT v.r, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{n} c USING (part, pos) GROUP BY v.r, v.part, c.entry)
  GROUP BY r, part),
c{m} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce(u.x, c.x) AS x
  FROM c{n} c LEFT JOIN (
    SELECT part, entry, pos, floor(sum(v.x) / count(*))::BIGINT AS x FROM v JOIN a{n} USING (r, part) GROUP BY part, entry, pos) u USING (part, entry, pos)),"""

OP12_SQL = (
    r"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS g, len(embedding) // 4 AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT r, i // w AS part, i % w AS pos, floor(1024 * g[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT r, g, w, unnest(range(len(g))) AS i FROM e)),
c0 AS (SELECT part, r - 1 AS entry, pos, x FROM v WHERE r <= 256),"""
    + "".join(_OP12_ROUND.format(n=n, m=n + 1) for n in range(5))
    + r"""
coded AS (
  SELECT r, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r),
book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM c4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM e JOIN coded USING (r), book
"""
)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_code_compression": op12_code_compression,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE: dict[str, str] = {
    "op4_suffix_dedup": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_code_compression": OP12_SQL,
}
