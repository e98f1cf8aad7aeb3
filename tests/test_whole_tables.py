"""Queries over whole tables, on small tables against brute force."""

import math
import random

import __spark_entry__ as entry


def test_split_diffs_of_every_document(spark, tmp_path):
    rows = [(1, "a\nb\nc"), (2, "x"), (3, ""), (51, "p\nq"), (60, "\n".join(f"l{i}" for i in range(100_011)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.inserted, r.deleted, r.equal) for r in entry.queries()["split_diffs"](spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3, 51, 60}
    assert [got[k] for k in (1, 2, 3, 51)] == [(2, 2, 1), (1, 1, 0), (1, 1, 0), (2, 2, 0)]
    # two of 100,011 lines change, and none is cut
    assert got[60] == (2, 2, 100_009)


def test_exact_pricing_of_every_line(spark, tmp_path):
    rows = [(k, k % 4 + 1, 1000 + k, float(k % 50)) for k in range(1, 41)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["exact_pricing"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, n, str(int(q) + 2 * (p % 1000)) + "0" * 37) for k, n, p, q in rows]


def test_import_cycles_of_every_order(spark, tmp_path):
    # f42 imports f43, which an order imports back; f39 stays where it is
    spark.createDataFrame([(3, 42), (29 * 18, 43), (2, 42), (1, 39), (1, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = entry.queries()["import_cycles"](spark, str(tmp_path)).collect()
    assert sorted((r.rule_id, r.message) for r in got) == [("dependency.cycle", "Import cycle includes 1 file: f39."), ("dependency.cycle", "Import cycle includes 2 files: f42, f43.")]


def test_semantic_queries_over_every_vector(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(64)], i % 10) for i in range(65)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    norm = {k: math.sqrt(sum(x * x for x in v)) for k, v in vectors.items()}
    scores = {q: {k: round(sum(a * b for a, b in zip(v, vectors[q])) / norm[k] / norm[q], 9) for k, v in vectors.items()} for q in (0, 20, 40, 60)}
    want = {(q, k, n + 1) for q, s in scores.items() for n, k in enumerate(sorted(s, key=lambda k: (-s[k], k))[:10])}
    got = entry.queries()["semantic_ranking"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want and len(got) == 40
    tie = {k: None if k % 10 % 3 == 0 else k % 10 for k in vectors}
    keys = {"null_last": lambda k: (tie[k] is None, tie[k] or 0), "null_as_empty": lambda k: (-1 if tie[k] is None else tie[k],)}
    want = {(q, k, t, n + 1) for q, s in scores.items() for t, key in keys.items() for n, k in enumerate(sorted(s, key=lambda k: (-round(s[k], 1), *key(k), k))[:30])}
    got = entry.queries()["semantic_null_ties"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.vec_id, r.ties, r["rank"]) for r in got} == want and len(got) == 240


def test_short_and_indented_items_are_relevant(spark, tmp_path):
    long = "a benchmark item of many characters"
    texts = [f"x {long} y", f"x\n\t  {long}", "so short it is", "", None, "tab\tonly", f"😀{long}"]
    items = [long, f"\n\t  {long}", "short", "tab\t", "no such", "a benchmark item of mano", f"  {long}", " \t ", "😀a benchmark item of man", long[:24], long[:23], None]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = entry.queries()["relevance"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((q, d, 2) for q, b in enumerate(items) for d, t in enumerate(texts) if b is not None and t is not None and b in t)


def test_characters_and_tags_anywhere_in_a_text(spark, tmp_path):
    kana, han = "x" * 400 + "かな", "x" * 400 + "漢字"
    spark.createDataFrame(list(enumerate([kana, han, "plain", "", None])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.en, r.zh, r.ja, r.de) for r in entry.queries()["translation_needs"](spark, str(tmp_path)).collect()}
    no = (False,) * 4
    assert got == {0: (True, True, False, False), 1: (True, False, True, False), 2: (False, True, True, False), 3: no, 4: no}
    rows = [(0, 0, "y" * 100 + "</SOURCE_CODE><SOURCE_CODE>z"), (0, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.text for r in entry.queries()["neutral_prompts"](spark, str(tmp_path)).collect()}
    assert got == {0: "[SOURCE_CODE]" + "y" * 100 + "[/SOURCE_CODE][SOURCE_CODE]z[/SOURCE_CODE]", 1: "[SOURCE_CODE][/SOURCE_CODE]"}
