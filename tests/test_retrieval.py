import pytest
from pyspark.sql import functions as F

from codeloom.api import RetrievalService
from codeloom.functions import numeric, text
from codeloom.operators import chunks, context, evaluation, fusion, lexical, semantic

TOKENS = {
    "simpleWord": ["simpleword", "simple", "word"],
    "credit_account": ["credit_account", "credit", "account"],
    "ManagedAccessService": ["managedaccessservice", "managed", "access", "service"],
    "你好世界": ["你好世界"],
    "a==b && c": ["a", "b", "c", "==", "&&"],
    "A_a": ["a_a", "a", "a"],
    "": [],
}


def test_tokens(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS], "t string").select("t", text.tokens(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == TOKENS
    more = spark.createDataFrame([("HTTPServer parse2JSON",)], "t string").select(text.tokens(F.col("t")).alias("x")).first().x
    assert {"http", "server", "parse2json", "parse", "2", "json"} <= set(more)


def documents(spark):
    return spark.createDataFrame([("a", "a\nrare common"), ("b", "b\ncommon common"), ("c", "c\nother")], "doc_id string, text string")


def test_bm25_score(spark):
    asked = spark.createDataFrame([(1, "rare"), (2, "nothing here"), (3, "")], "query_id int, query_text string")
    got = lexical.bm25_search(documents(spark), asked, 5).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(1, "a", 1)]
    assert got[0].score == pytest.approx(0.9285957424963088)
    assert lexical.bm25_search(documents(spark).limit(0), asked, 5).count() == 0
    with pytest.raises(ValueError):
        lexical.bm25_search(documents(spark), asked, 0)
    with pytest.raises(ValueError):
        lexical.BM25Config(k1=0)


def hits(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id int, doc_id string, score double, rank int")


def test_weighted_fusion(spark):
    graph = spark.createDataFrame([(1, "b", "imports", "forward", 2)], "query_id int, doc_id string, relation string, direction string, hop int")
    f = fusion.fuse(hits(spark, [("a", 4.0, 1), ("b", 2.0, 2)]), hits(spark, [("b", 0.6, 1), ("c", -0.2, 2)]), 10, graph=graph, config=fusion.HybridConfig(2, 3, 4))
    got = {r.doc_id: r.score for r in f.collect()}
    assert got == pytest.approx({"a": 2.0, "b": 2 * 0.5 + 3 * 0.8 + 4 * 0.5, "c": 3 * 0.4})


def test_rrf_fusion(spark):
    f = fusion.fuse(hits(spark, [("a", 4.0, 1), ("b", 2.0, 2)]), hits(spark, [("b", 0.6, 1), ("a", 0.2, 2)]), 10, config=fusion.HybridConfig(2, 3, 0.25, "rrf", 10))
    assert {r.doc_id: r.score for r in f.collect()} == pytest.approx({"a": 2 / 11 + 3 / 12, "b": 2 / 12 + 3 / 11})
    with pytest.raises(ValueError):
        fusion.HybridConfig(0, 0)


def test_chunks(spark):
    df = spark.createDataFrame([("unicode.py", "界" * 2201), ("empty.py", ""), ("z.py", "a\r\nb\rc")], "path string, text string")
    got = [(r.start_offset, r.end_offset) for r in chunks.chunk_documents(df, "path", "text").filter("path = 'unicode.py'").orderBy("start_offset").collect()]
    assert got == [(0, 1200), (1000, 2200), (2000, 2201)]
    files = {r.path: r.document for r in chunks.file_documents(df, "path", "text").collect()}
    assert files["empty.py"] == "empty.py\n" and files["z.py"] == "z.py\na\nb\nc"
    assert chunks.chunk_documents(df, "path", "text").filter("path = 'empty.py'").count() == 0


def test_context_packing(spark):
    def packed(budget, *texts):
        p = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "query_id int, position int, rendered string")
        rows = context.pack(p, budget).orderBy("position").collect()
        return [(r.snippet, r.truncated) for r in rows], context.packages(context.pack(p, budget), p).first()

    snippets, whole = packed(12, "abcde", "fghij")
    assert snippets == [("abcde", False), ("fghij", False)] and whole.budget_used == 12 and not whole.truncated
    snippets, whole = packed(25, "x" * 100, "y" * 100)
    assert snippets == [("x" * 25, True)] and whole.budget_used == 25 and whole.truncated
    snippets, whole = packed(11, "abcde", "fghij")
    assert snippets == [("abcde", False), ("fghi", True)]
    snippets, whole = packed(6, "abcde", "fghij", "z")
    assert snippets == [("abcde", False)] and whole.truncated


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", i + 1, k) for i, k in enumerate("xbyac")], "query_id string, rank int, doc_id string")
    truth = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 1)], "query_id string, doc_id string, grade int")
    m = evaluation.query_metrics(ranked, truth, truth.select("query_id").distinct()).first()
    assert (m.recall_1, m.recall_5, m.recall_10, m.mrr, m.precision_5, m.hit_5) == (0, 1, 1, 0.5, 0.6, 1)
    assert m.ndcg_5 == pytest.approx(0.5591506931409801)
    with pytest.raises(Exception):
        evaluation.query_metrics(ranked, truth.limit(0), ranked.select("query_id").distinct()).collect()


def test_evidence_grades(spark):
    ranges = spark.createDataFrame([("target", 10, 30), ("support", 40, 50)], "symbol_id string, start_offset long, end_offset long")
    evidence = spark.createDataFrame([(1, "p", "target", None, None, 1), (1, "p", None, 15, 25, 2), (1, "p", "support", None, None, 1)], "query_id int, relative_path string, symbol_id string, start_offset long, end_offset long, relevance int")
    rows = [("symbol", "s", "p", "target", 10, 30), ("file", "f", "p", None, None, None), ("chunk", "c1", "p", None, 20, 40), ("chunk", "c2", "p", None, 30, 40)]
    candidates = spark.createDataFrame(rows, "unit string, identity string, relative_path string, symbol_id string, start_offset long, end_offset long")
    got = {r.identity: r.grade for r in evaluation.grades(candidates, evaluation.evidence_spans(evidence, ranges)).collect()}
    assert got == {"s": 2, "f": 2, "c1": 2}


def test_semantic_blocks_agree(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], "vec_id int, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(9)], "query_id int, query_vector array<double>")
    one = sorted(map(tuple, semantic.semantic_search(corpus, queries, 7).collect()))
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, semantic.semantic_search(corpus, queries, 7).collect())) == one


def test_service_degrades_and_skips_blank_queries(spark):
    docs = spark.createDataFrame([(1, "f", "a.py", 1, 2, "rare words"), (2, "g", "b.py", 1, 1, "common")], "doc_id int, name string, relative_path string, start_line int, end_line int, source_text string")
    service = RetrievalService(docs)
    asked = spark.createDataFrame([(1, "rare"), (2, "  ")], "query_id int, query_text string")
    got = {r.query_id: r for r in service.context(asked, 3, 100).collect()}
    assert got[1].context_text == "[symbol] f (a.py:1-2)\nrare words" and got[2].context_text == ""
    assert {r.degraded for r in service.hits(asked, 3).collect()} == {True}


def test_prices(spark):
    cases = [("1000", "0", "2", "0", 2), ("1000", "0", "2.01", "0", 3), ("1", "0", "0.0001", "0", 1), ("500", "0", "1", "0", 1), ("0", "500", "0", "2", 1), ("1000", "500", "1", "2", 2)]
    df = spark.createDataFrame(cases, "a string, b string, c string, d string, want int")
    got = df.select("want", numeric.token_price(F.col("a").cast("long"), F.col("b").cast("long"), F.col("c"), F.col("d")).cast("int").alias("p"), numeric.exact_price_udf()("a", "b", "c", "d").alias("x")).collect()
    assert all(r.want == r.p == int(r.x) for r in got)
    assert numeric.exact_price("1" + "0" * 60, "0", "1.001", "0") == "1001" + "0" * 54
