import pytest
from pyspark.sql import functions as F

from codeloom.functions.embedding import Provider, token_diagnostics
from codeloom.functions.numeric import fake_embedding
from codeloom.operators import benchmark, documentation, evaluation, index, ledger, lexical


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, text string").withColumn("content_hash", F.sha2("text", 256))


def test_updated_index_equals_a_new_one(spark, tmp_path):
    embed = lambda d: d.select("id", "content_hash", fake_embedding(F.col("text"), 4).alias("vector"))
    config = index.IndexConfig()
    old = index.build(docs(spark, [("a", "rare common"), ("b", "common"), ("c", "gone")]), f"file://{tmp_path}/1", config, embed)
    new_docs = docs(spark, [("a", "rare common"), ("b", "common words"), ("d", "rare new")])
    new = index.update(old, new_docs, f"file://{tmp_path}/2", config, embed)
    anew = index.build(new_docs, f"file://{tmp_path}/3", config, embed)
    for t in ("documents", "postings", "vectors", "statistics"):
        assert evaluation.same_rows(new.table(t).select(*anew.table(t).columns), anew.table(t))
    asked = spark.createDataFrame([(1, "rare words")], "query_id int, query_text string")
    want = lexical.bm25_search(new_docs, asked, 5, key="id").collect()
    assert index.search(new, asked, 5).collect() == want and len(want) == 3
    with pytest.raises(ValueError):
        index.update(old, new_docs, f"file://{tmp_path}/4", index.IndexConfig(lexical.BM25Config(k1=2.0)), embed)
    one = index.index_identity(config, old.table("documents"))
    assert one != index.index_identity(config, new.table("documents")) and one == index.index_identity(config, old.table("documents").repartition(2))


def test_provider(spark):
    def _numbers():  # nested, so that workers get it by value
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("query: ab",), (None,)], "t string")
    p = Provider(_numbers, 2)
    assert [r.q for r in df.select(p.query(F.col("t")).alias("q")).collect()] == [[9.0, 1.0], [9.0, 1.0], [7.0, 1.0]]
    with pytest.raises(Exception):
        df.select(Provider(_numbers, 3).document(F.col("t"))).collect()
    d = df.select(token_diagnostics(F.col("t"), lambda: list, 2, 5).alias("d")).collect()
    assert [(r.d.raw, r.d.total, r.d.truncated) for r in d] == [(2, 4, False), (9, 11, True), (0, 2, False)]


def test_documenting_files(spark):
    def _generator():
        return lambda kind, code: "```\nSays what it does.\n```" if "bad" not in code else "Sure, here it is"

    rows = [("p", "a.py", "python", 'def f(x):\n    return x\n\ndef bad():\n    pass\n\ndef g():\n    """Has one."""\n'), ("p", "B.java", "java", "class B {\n    int f() { return 1; }\n}\n")]
    out = {r.relative_path: r for r in documentation.document_files(spark.createDataFrame(rows, "project_id string, relative_path string, language string, content string"), _generator).collect()}
    assert out["a.py"].output_path == "a_annotated.py" and out["a.py"].outcome == "PARTIAL" and out["a.py"].inserted == 1
    assert out["a.py"].annotated.count("Says what it does.") == 1 and "Has one." in out["a.py"].annotated
    assert out["B.java"].outcome == "SUCCEEDED" and out["B.java"].annotated.count("/**") == 2


def test_matrix_and_runs(spark):
    assert benchmark.matrix(spark).count() == 17
    hit = lambda rows: spark.createDataFrame([(1, k, s, i + 1) for i, (k, s) in enumerate(rows)], "query_id int, doc_id string, score double, rank int")
    steps = spark.createDataFrame([(1, "b", "imports", "forward", 1)], "query_id int, doc_id string, relation string, direction string, hop int")

    def broken():
        raise RuntimeError

    truth = spark.createDataFrame([(1, "b", 2)], "query_id int, doc_id string, grade int")
    good = benchmark.Branches(lambda unit: hit([("a", 2.0), ("b", 1.9)]), lambda: hit([("a", 0.1), ("b", 0.05)]), lambda signals: steps)
    got = {r.experiment: (r.status, r.mrr) for r in benchmark.run(["RQ2-BM25", "RQ4-HYBRID-GRAPH", "RQ4-HYBRID-NO-GRAPH", "RRF-HYBRID-GRAPH"], good, truth.select("query_id"), truth).collect()}
    assert got == {"RQ2-BM25": ("success", 0.5), "RQ4-HYBRID-GRAPH": ("success", 1.0), "RQ4-HYBRID-NO-GRAPH": ("success", 0.5), "RRF-HYBRID-GRAPH": ("success", 1.0)}
    bad = benchmark.Branches(lambda unit: broken(), broken, lambda signals: steps)
    assert benchmark.run(["RQ2-E5"], bad, truth.select("query_id"), truth).first().status == "failed"


def test_validations(spark):
    manifest = spark.createDataFrame([("p", "a", "h")], "project_id string, relative_path string, content_hash string")
    candidates = spark.createDataFrame([("p", "file", "file:a", "a", None, None)], "project_id string, unit string, identity string, relative_path string, start_offset long, end_offset long")
    evaluation.validate_registry(manifest, candidates, manifest)
    evaluation.validate_retrieved(candidates, candidates)
    with pytest.raises(ValueError):
        evaluation.validate_registry(manifest, candidates, manifest.withColumn("content_hash", F.lit("x")))
    with pytest.raises(ValueError):
        evaluation.validate_retrieved(candidates.withColumn("identity", F.lit("x")), candidates)
    with pytest.raises(ValueError):
        evaluation.candidates_for(candidates, "p", "chunk")


def test_pricing_policies(spark):
    t = ledger.TokenPricing("p", "m", "1", "2", 1000, 500)
    usage = spark.createDataFrame([("p", "m", 1000, 500)], "provider string, model string, tokens_in long, tokens_out long")
    assert t.price_usage(usage).first().credits == 2 == spark.range(1).select(t.reserve()).first()[0]
    with pytest.raises(Exception):
        t.price_usage(usage.withColumn("tokens_in", F.lit(1001))).collect()
    with pytest.raises(Exception):
        t.price_usage(usage.withColumn("model", F.lit("other"))).collect()
    with pytest.raises(ValueError):
        ledger.FlatPricing(0)
