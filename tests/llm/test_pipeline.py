"""The pipeline on a small scale: what each stage keeps and what its decisions are."""

import corpus_pipeline as c
from claimsieve.llm import secrets
from claimsieve.plans.storage import materialize
from tests.llm.test_near_copies import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in c.STAGES[:-1]:
        new = materialize(stage(spark, docs, sf_dir), "stage")
        assert new.columns == columns, name
        ids = {r.doc_id for r in new.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        seen.append((docs, new))
        docs = new
    before, after = seen[1]
    rows = sorted(before.select("doc_id", "text").collect())
    component, _ = brute([r.text for r in rows])  # near copies by their definition, over all pairs
    assert {rows[i].doc_id for i in set(component)} == {r.doc_id for r in after.select("doc_id").collect()}
    before, after = seen[2]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").count() == 0
    before, after = seen[3]
    assert before.count() == after.count()
    assert not any(s[1] < 3 for r in after.select("text").collect() for s in secrets.scan(r.text or ""))
    packed = c.pack(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_with_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", None, 1), (1, "same text of five words", None, None, 3, 2), (None, "same text of five words", "en", "s", 1, 3), (None, "", None, None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity int")
    for _, stage in c.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "toxicity"]
    assert docs.count() == 2
    assert c.pack(spark, docs, sf_dir).count() == 2
    none = docs.limit(0)
    for _, stage in c.STAGES:
        none = materialize(stage(spark, none, sf_dir), "stage")
    assert none.count() == 0
