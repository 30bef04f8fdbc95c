"""The pipeline's rows against its stages done by hand."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from pathweave.llm import quality_rules, secrets
from pathweave.llm.common import table
from tests.llm.helpers import ordered
from tests.llm.test_duplicates import linked
from tests.llm.test_text_operators import contaminated


def test_stages_are_the_five():
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bad = quality_rules.mask(quality_rules.POLICIES["v1"])
    kept = {r.doc_id for r in quality_rules.ledger(docs).collect() if not r.failed & bad}
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r, found in zip(sorted(rows), linked(sorted(rows), 5, 80)) if found[2] in (r[0], None)]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = [r for r, found in zip(rows, contaminated(rows, items)) if not found[5]]
    clean = docs.where(docs.doc_id.isin([d for d, _ in rows]))
    crf = secrets.fit(clean)
    rows = [(d, secrets.hide(t, secrets.all_spans(t, crf), "[SECRET]")) for d, t in rows]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = ordered([(d, len(encode(t, add_special_tokens=False).ids) + 1) for d, t in rows])
    pieces = pipeline.run(spark, sf_dir).collect()
    assert ordered({(p.doc_id, p.doc_tokens) for p in pieces}) == want
    assert sum(p.length for p in pieces) == sum(n for _, n in want)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id < 20")
    docs = docs.selectExpr("doc_id", "IF(doc_id = 3, NULL, text) AS text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_take_columns_of_any_name(spark, sf_dir):
    """Names that operators use themselves, a null id and repeated rows."""
    docs = table(spark, sf_dir, "documents").where("doc_id < 12")
    extra = {"_hit_words": "1", "_hit_items": "2", "_hit_ranges": "'r'", "_ledger_n_words": "3", "_ledger_failed": "4", "node": "5", "component_id": "6", "_column_0": "7"}
    wide = docs.selectExpr("*", *(f"{v} AS {k}" for k, v in extra.items()))
    wide = wide.union(wide.limit(3)).union(wide.selectExpr("CAST(NULL AS LONG) AS doc_id", *wide.columns[1:]).limit(2))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns, name
        rows = [tuple(r)[5:] for r in out.collect()]
        assert rows and set(rows) == {(1, 2, "r", 3, 4, 5, 6, 7)}, name
