"""Items that documents hold, against plain comparison, and without a row for each place of a text."""

import random

import pytest

import __spark_entry__ as entry
from codeloom.operators import holding


@pytest.mark.parametrize(("step", "block"), [(1 << 20, 2000), (5, 2000), (1 << 20, 7)])
def test_held_items_equal_plain_comparison(spark, monkeypatch, step, block):
    # a step far shorter than a text, so that items lie across its ends
    monkeypatch.setattr(holding, "_STEP", step)
    monkeypatch.setattr(holding, "ITEM_BLOCK", block)
    rnd = random.Random(2)
    some = lambda n: "".join(rnd.choice(["a", "b", " ", "\n", "é", "漢", "😀"]) for _ in range(n))
    texts = ["", None, "a" * 60, *[some(rnd.randrange(90)) for _ in range(40)]]
    items = ["", None, "a", "é", " " * 30, "a" * 24, "a" * 23, "a" * 61, *[t[i : i + n] for t in texts[3:] for i, n in [(rnd.randrange(50), rnd.randrange(1, 40))]]]
    items += [x + "~" for x in items[8:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(items)), "query_id long, query_text string")
    want = sorted((q, d) for q, x in enumerate(items) for d, t in enumerate(texts) if x is not None and t is not None and x in t)
    assert sorted(map(tuple, holding.holding(docs, asked).collect())) == want


def test_no_items_and_no_documents(spark):
    docs, asked = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "x")], "query_id long, query_text string")
    assert holding.holding(docs, asked.filter("false")).collect() == holding.holding(docs.filter("false"), asked).collect() == []


def test_relevance_makes_no_row_for_each_place(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 5000, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x" * 30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = entry.queries()["relevance"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 1, 2)]
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan
