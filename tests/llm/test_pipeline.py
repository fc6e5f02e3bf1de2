"""The stages one by one on a small folder of tables."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from equiflow.llm import exact_dedup, jaccard_join, toxicity  # noqa: E402

from .test_operators import ROWS, components  # noqa: E402


def test_stages(spark, tmp_path):
    rows = [(r[0], r[1], "en", r[3], len(r[1] or "")) for r in ROWS if r[0] is not None]
    rows += [(5000 + i, f"{'vile foul rotten' if i % 2 else 'plain good words'} number {i} of this text with a tail {i * 7}", "en", "s1", 0) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5000 + i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, sf = docs.columns, str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    bad = {r.doc_id for r in toxicity.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert bad and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - bad and clean.columns == columns
    once = stages["exact dedup"](spark, clean, sf)
    assert once.count() == exact_dedup.exact_groups(clean).filter("kept").count() and once.columns == columns
    near = stages["n-gram Jaccard join"](spark, once, sf)
    left = [(r.doc_id, r.text) for r in once.collect()]
    assert {c for _, n, c in components(left) if n} == {r.doc_id for r in near.collect() if (r.text or "").strip()}
    mixed = stages["mixing sources"](spark, near, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    packed = stages["best-fit packing"](spark, mixed, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_keep_odd_rows(spark, tmp_path):
    """Null ids, one id with several texts, equal rows, null and empty texts; and empty tables."""
    w = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    rows = [(None, w["a"], "s"), (None, w["b"], None), (5, w["c"], "s"), (5, w["d"], "s"), (6, w["d"] + " more", "s"), (7, w["a"], "t"), (8, None, "s"), (9, "", "s")]
    schema = "doc_id long, text string, source string, label string"
    spark.createDataFrame([(*r, "x") for r in rows], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    for k in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, f"{tmp_path}/a")
        assert docs.columns == ["doc_id", "text", "source", "label"]
    left = sorted(((r.text or "")[:2], r.doc_id) for r in docs.collect())
    assert left == [("", 8), ("a0", 7), ("b0", None), ("c0", 5), ("d0", 5)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
