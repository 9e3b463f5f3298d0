"""The pipeline's stages: what goes, what stays, and the columns in between."""

import corpus_pipeline as p
from tests.llm.test_operators import SF_DIR, brute_links


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    calm = p.toxicity(spark, docs, SF_DIR)
    marked = docs.join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    assert calm.columns == docs.columns and calm.count() >= docs.count() - 2 * marked.where("toxic = 1").count() * docs.count() // max(1, marked.count()) - 5
    lined = p.line_dedup(spark, docs, SF_DIR)
    assert lined.columns == docs.columns and lined.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    near = p.near_copies(spark, docs, SF_DIR)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, _, c, _ in brute_links(rows, p.SHINGLE_WORDS, p.SIMILARITY)})
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = p.decontamination(spark, docs, SF_DIR)
    assert not any(x in (r["text"] or "") for r in clean.collect() for x in items)


def test_odd_rows_pass_through(spark, odd, none):
    for name, stage in p.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0, name
    assert p.line_dedup(spark, odd, SF_DIR).count() == 9
    assert p.near_copies(spark, odd, SF_DIR).count() == 8  # the repeated row goes
    assert p.decontamination(spark, odd, SF_DIR).columns == odd.columns
    assert p.encoding(spark, odd, SF_DIR).count() == 9


def test_run(spark):
    got = p.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "tokens"] and 0 < got.count() <= 200


def test_near_copies_with_clashing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a), (5, b), (9, "z only"), (None, a), (7, None), (6, b + " tail"), (6, a + " tail")]
    got = p.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF_DIR)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, a), (5, b), (9, "z only"), (None, a), (7, None)]))
