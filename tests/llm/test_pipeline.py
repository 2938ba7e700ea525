from pyspark.sql import functions as F

import corpus_pipeline
from seedsift.llm import decontaminate, line_templates, minhash, quality_knn
from seedsift.llm.common import without
from tests.conftest import DATA
from tests.llm.test_near_duplicates import brute
from tests.llm.test_text_operators import contamination_brute, lines_brute


def test_stages_one_by_one(spark):
    """Each stage against a plain version of its rule, on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, DATA)
    model = quality_knn.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r.doc_id for r in quality_knn.score_documents(docs, model).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in good.collect()}
    assert set(rows) == kept and good.columns == docs.columns

    cut = stage["line dedup"](spark, good, DATA)
    want = {i: t for i, t in lines_brute([(i, r.text) for i, r in rows.items()]) if t == rows[i].text or t.split()}
    after = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in after.items()} == want and cut.columns == docs.columns

    single = stage["near-duplicates"](spark, cut, DATA)
    groups, _ = brute([(i, r.text) for i, r in after.items()], minhash.WORDS)
    left = {r.doc_id: r.text for r in single.collect()}
    assert set(left) == set(groups.values()) and single.columns == docs.columns

    clean = stage["decontamination"](spark, single, DATA)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {i for i, t in left.items() if not contamination_brute(t, items)[4]}
    assert clean.columns == docs.columns


def test_run_and_empty_input(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_stages_keep_extra_columns(spark):
    """Also ones named as an operator's results, in every stage but the last."""
    extra = {c: F.lit(i) for i, c in enumerate(["score", "predicted", "n_lines", "n_dropped", "kept", "component_id", "spans", "items", "contaminated", "_word"])}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 80").withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.select(*extra).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(extra)))], name


def test_anti_join_shuffles_candidates_only(spark):
    """No exchange of texts below the bitmap's join: the filter by bitmap comes first."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = without(docs, docs.where("doc_id % 10 = 0").select("doc_id"), "doc_id")
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert left.count() == docs.where("doc_id % 10 <> 0").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" not in plan
    lines = plan.split("\n")
    outer = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x and "_gone" not in x and "doc_id" in x)
    assert any("getbit" in x for x in lines[outer:])
    odd = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "doc_id long, text string")
    assert {r.text for r in without(odd, odd.where("doc_id = 2 or doc_id is null").select("doc_id"), "doc_id").collect()} == {"a", "b"}


def test_operators_keep_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 9, 8)], "doc_id long, text string, n_lines long, kept long")
    assert line_templates.drop_recurring_lines(docs).columns == ["doc_id", "text", "kept", "n_lines", "n_dropped"]
    assert decontaminate.scan_documents(docs, spark.createDataFrame([(1, "x")], "item_id long, text string")).columns[:4] == ["doc_id", "text", "n_lines", "kept"]
