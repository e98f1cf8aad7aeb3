"""Searches that keep the best rows while blocks pass by, against plain scores of all pairs."""

import math
import random

import __spark_entry__ as entry
import numpy as np
import pytest
from codeloom.operators import evaluation, index, lexical, semantic
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().toString()


def texts(n):
    rnd = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    # copies, whose scores are equal, and texts without words
    return rows + [(n + i, rows[i % 7][1]) for i in range(30)] + [(n + 30, None), (n + 31, "")], words


def lexical_tables(spark):
    rows, words = texts(90)
    rnd = random.Random(6)
    asked = [(q, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for q in range(9)] + [(9, ""), (10, None), (11, "nowhere")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, query_text string")


@pytest.mark.parametrize("block, cells", [(2000, 1 << 21), (3, 64)])
def test_lexical_search_is_the_top_of_all_scores(spark, monkeypatch, block, cells):
    docs, asked = lexical_tables(spark)
    want = sorted(map(tuple, lexical.top_ranked(lexical.bm25_scores(docs, asked), "query_id", [F.desc("score"), F.col("doc_id")], 5).collect()))
    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    monkeypatch.setattr(lexical, "CELLS", cells)
    assert sorted(map(tuple, lexical.bm25_search(docs, asked, 5).collect())) == want and len(want) > 40


def test_lexical_search_shuffles_no_postings(spark, monkeypatch):
    docs, asked = lexical_tables(spark)
    kept, write = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, name: kept.append(df) or write(df, name))
    found = lexical.bm25_search(docs, asked, 5)
    # one row a document is written where its text is read, and only the best of each query move
    assert [df.count() for df in kept] == [docs.count()] and "hashpartitioning" not in plan(kept[0])
    assert plan(found).count("hashpartitioning") == plan(found).count("hashpartitioning(query_id") > 0


def test_rows_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "rare word"), (1, "rare"), (2, "word"), (3, "other")], "doc_id long, text string")
    got = lexical.bm25_search(docs, spark.createDataFrame([(7, "rare")], "query_id long, query_text string"), 5).collect()
    want = math.log1p((4 - 1 + 0.5) / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 4)))
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(7, 1, 1)] and got[0].score == pytest.approx(want)


def hashed(docs):
    return docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"), "text")


@pytest.fixture(params=[index.BROADCAST, 200])
def changed_ids(request, monkeypatch):
    """Ids of changed documents go to all tasks at once, or in blocks."""
    monkeypatch.setattr(index, "BROADCAST", request.param)


def test_stored_index_has_a_row_a_document(spark, tmp_path, monkeypatch, changed_ids):
    docs, asked = lexical_tables(spark)
    part = docs.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" wab new"))).otherwise(F.col("text")))
    cut, cut_into = [], lexical.document_tokens
    monkeypatch.setattr(lexical, "document_tokens", lambda df, *columns: cut.append(df) or cut_into(df, *columns))
    config = index.IndexConfig()
    new = index.update(index.build(hashed(part), f"file://{tmp_path}/1", config), hashed(docs), f"file://{tmp_path}/2", config)
    # no row a posting, and what didn't change isn't cut again
    assert new.table("postings").count() == docs.count() and sum(df.count() for df in cut[1:]) == docs.filter("doc_id % 5 = 0 or doc_id % 7 = 0 or text is null").count()
    anew = index.build(hashed(docs), f"file://{tmp_path}/3", config)
    assert evaluation.same_rows(new.table("postings"), anew.table("postings")) and new.table("statistics").collect() == anew.table("statistics").collect()
    want = sorted(map(tuple, lexical.bm25_search(docs, asked, 5).collect()))
    assert sorted(map(tuple, index.search(new, asked, 5).collect())) == want and len(want) > 40
    assert not any("hashpartitioning" in plan(lexical.forward(cut_into(df, "id", "text"), "id")) for df in cut if "id" in df.columns)


def test_updated_index_of_odd_rows(spark, tmp_path, changed_ids):
    table = lambda rows: spark.createDataFrame(rows, "id string, content_hash string, text string")
    old = [("same", "h", "rare word"), ("twice", "1", "rare"), ("twice", "2", "word word"), ("fewer", "1", "rare"), ("fewer", "1", "rare"), (None, "1", "was"), ("bare", None, "was"), ("gone", "1", "rare"), ("none", "1", "")]
    new = [("same", "h", "rare word"), ("twice", "1", "rare"), ("twice", "3", "rare rare"), ("fewer", "1", "rare"), (None, "1", "rare is"), ("bare", None, "rare is"), ("none", "1", ""), ("late", "1", None)]
    config = index.IndexConfig()
    got = index.update(index.build(table(old), f"file://{tmp_path}/1", config), table(new), f"file://{tmp_path}/2", config)
    anew = index.build(table(new), f"file://{tmp_path}/3", config)
    assert all(evaluation.same_rows(got.table(t), anew.table(t)) for t in ("documents", "postings", "statistics"))
    asked = spark.createDataFrame([(7, "rare word")], "query_id long, query_text string")
    want = lexical.bm25_search(table(new), asked, 9, key="id").collect()
    assert index.search(got, asked, 9).collect() == want and len(want) == 5
    empty = index.update(got, table([]), f"file://{tmp_path}/4", config)
    assert index.search(empty, asked, 9).collect() == [] and index.search(index.update(empty, table(new), f"file://{tmp_path}/5", config), asked, 9).collect() == want


def vector_tables(spark, odd):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(90)]
    if odd:
        nan, inf = math.nan, math.inf
        rows += [(500, None), (501, [1.0] * 3), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [nan] * 6), (504, [inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (505, [1e200, 1.0, 1.0, 1.0, 1.0, 1.0]), (506, []), (507, [2.0, 1.0, 0.5])]
    corpus = spark.createDataFrame([(i, v, i % 7 or None) for i, v in rows], "vec_id long, embedding array<double>, tie int").repartition(3)
    return corpus, corpus.filter("vec_id % 20 = 0 or vec_id >= 500").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@pytest.mark.parametrize("odd, tile, block, k", [(False, 2048, 2000, 5), (False, 16, 9, 30), (True, 16, 2000, 5), (True, 2048, 9, 200)])
@pytest.mark.parametrize("digits", [None, 1])
def test_vector_search_is_the_top_of_all_scores(spark, monkeypatch, odd, tile, block, k, digits):
    corpus, queries = vector_tables(spark, odd)
    scores = semantic.cosine_scores(corpus, queries, "vec_id", "embedding", "query_id", "query_vector").join(corpus.select("vec_id", "tie"), "vec_id")
    score, ties = F.col("score") if digits is None else F.round("score", digits), [*semantic.null_last(F.col("tie")), F.col("vec_id")]
    want = lexical.top_ranked(scores.withColumn("score", score), "query_id", [F.desc("score"), *ties], k).select("query_id", "vec_id", "tie", "score", "rank")
    monkeypatch.setattr(semantic, "TILE", tile)
    monkeypatch.setattr(semantic, "QUERY_BLOCK", block)
    got = semantic.semantic_search(corpus, queries, k, ties=ties, carry=("tie",), digits=digits)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["semantic_ranking", "semantic_null_ties"])
def test_vector_queries_make_no_row_a_pair(spark, tmp_path, name):
    rows = [(i, [math.sin(i * j + j) for j in range(1, 65)], i % 10) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    assert found.count() == {"semantic_ranking": 50, "semantic_null_ties": 300}[name]
    assert "NestedLoopJoin" not in plan(found) and "Cartesian" not in plan(found)


def test_rounding_is_sparks(spark):
    x = [0.05, 0.15, 0.25, -0.25, 0.35, 0.45000000000000001, 0.15000000000000002, 0.14999999999999999, -0.04, 1.0, 0.95, -1.0, 0.949999999999, math.inf, -math.inf]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x[:-2]], "x double").select(F.round("x", 1).alias("y")).collect()]
    assert semantic.rounded(np.array(x), 1).tolist() == want + x[-2:]
