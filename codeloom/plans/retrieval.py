"""Queries over tokens, ranking, vectors, fusion, context and evaluation.

Queries are the items of benchmark, documents are documents; a document is relevant to an item (grade 2) if it
holds the item's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import numeric
from codeloom.functions.text import tokens
from codeloom.operators import chunks, context, evaluation, fusion, holding, lexical, semantic
from codeloom.operators.rounds import spread

from ._common import sql_tokens, table

K = 10


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def token_counts(spark, d):
    t = docs(spark, d).select("doc_id", tokens(F.col("text")).alias("terms"))
    return t.select("doc_id", F.size("terms").cast("long").alias("n_tokens"), F.size(F.array_distinct("terms")).cast("long").alias("n_terms"))


def term_frequencies(spark, d):
    t = lexical.document_tokens(docs(spark, d), "doc_id", "text")
    p = lexical.postings(t, "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_statistics(spark, d):
    s = lexical.corpus_statistics(lexical.document_tokens(docs(spark, d), "doc_id", "text"))
    return s.select("documents", F.col("tokens").cast("long").alias("tokens"), F.round("average", 6).alias("average"))


def bm25_ranking(spark, d):
    return lexical.bm25_search(docs(spark, d), asked(spark, d), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def index_search(spark, d):
    """bm25_ranking over a stored index, built from four fifths of the documents and brought up to date with all."""
    from codeloom.operators import index
    from codeloom.operators.rounds import drop, folder_of

    rows = docs(spark, d).select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"), "text")
    config, before, after = index.IndexConfig(), folder_of(spark, "index"), folder_of(spark, "index")
    old = index.build(rows.filter("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))).withColumn("content_hash", F.md5("text")), before, config)
    new = index.update(old, rows, after, config)
    drop(before)
    return index.search(new, asked(spark, d), K).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _files(spark, d):
    return docs(spark, d).withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))


def file_documents(spark, d):
    f = chunks.file_documents(_files(spark, d), "path", "text")
    return f.select("identity", F.length("document").cast("long").alias("n_chars"), F.sha2("document", 256).alias("sha"))


def chunk_documents(spark, d):
    c = chunks.chunk_documents(_files(spark, d), "path", "text")
    return c.select("identity", "start_offset", "end_offset", F.sha2("document", 256).alias("sha"))


def chunk_bm25_ranking(spark, d):
    c = chunks.chunk_documents(_files(spark, d), "path", "text")
    return lexical.bm25_search(c, asked(spark, d), K, key="identity", text="document").select("query_id", "identity", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    """Every vector as corpus; each twentieth asks, so the query set grows with the table."""
    e = table(spark, d, "embeddings")
    return e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def semantic_ranking(spark, d):
    return semantic.semantic_search(*_vectors(spark, d), K).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def semantic_null_ties(spark, d):
    """Ranks where the tie key is null for some rows: null last, and null as empty."""
    corpus, queries = _vectors(spark, d)
    corpus = corpus.select("vec_id", F.expr("case when label % 3 = 0 then null else label end").alias("tie"), "embedding")
    ties = {"null_last": semantic.null_last(F.col("tie")), "null_as_empty": semantic.null_as_empty(F.col("tie"), -1)}
    last, empty = (
        semantic.semantic_search(corpus, queries, 30, ties=[*by, F.col("vec_id")], carry=("tie",), digits=1).select("query_id", "vec_id", F.lit(name).alias("ties"), F.col("rank").cast("long").alias("rank"))
        for name, by in ties.items()
    )
    return last.unionByName(empty)


def unit_vectors(spark, d):
    n = semantic.normalised(table(spark, d, "embeddings"), "embedding")
    return n.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round("length", 6).alias("length"), numeric.vector_error(F.col("embedding"), 64).alias("error"))


def fake_vectors(spark, d):
    v = numeric.fake_embedding(F.col("text"), 6, "seed")
    return docs(spark, d).select("doc_id", F.posexplode(v).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x"))


def _branches(spark, d, k=50):
    """Lexical hits, and hits by fake vectors, which need no model."""
    lex = lexical.bm25_search(docs(spark, d), asked(spark, d), k)
    corpus = docs(spark, d).select("doc_id", numeric.fake_embedding(F.col("text"), 16).alias("v"))
    queries = asked(spark, d).select("query_id", numeric.fake_embedding(F.col("query_text"), 16).alias("q"))
    sem = semantic.semantic_search(corpus, queries, k, "doc_id", "v", "query_id", "q")
    return lex, sem


def _fused(spark, d, strategy):
    lex, sem = _branches(spark, d)
    f = fusion.fuse(lex, sem, K, config=fusion.HybridConfig(strategy=strategy))
    return f.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def weighted_fusion(spark, d):
    return _fused(spark, d, "weighted")


def rrf_fusion(spark, d):
    return _fused(spark, d, "rrf")


def graph_fusion(spark, d):
    """Weighted fusion with a graph signal: documents of the best hit's source count as imported by it."""
    lex, sem = _branches(spark, d)
    top = lex.filter("rank = 1").select("query_id", F.col("doc_id").alias("seed")).join(docs(spark, d).select(F.col("doc_id").alias("seed"), "source"), "seed")
    reached = top.join(docs(spark, d).select("doc_id", "source"), "source").filter("doc_id <> seed")
    graph = reached.select("query_id", "doc_id", F.expr("case when doc_id % 2 = 0 then 'imports' else 'contains' end").alias("relation"), F.expr("case when doc_id % 3 = 0 then 'forward' else 'reverse' end").alias("direction"), F.lit(1).alias("hop"))
    f = fusion.fuse(lex, sem, K, graph=graph)
    return f.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round("graph_score", 6).alias("graph_score"), F.col("rank").cast("long").alias("rank"))


def degraded_retrieval(spark, d):
    """The semantic branch fails: lexical hits only, marked."""
    def broken():
        raise RuntimeError("no model")

    r = fusion.retrieve(lambda: lexical.bm25_search(docs(spark, d), asked(spark, d), K), broken, K)
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "degraded", "degradation_reason")


def candidate_union(spark, d):
    lex, sem = _branches(spark, d)
    return lex.select("query_id", "doc_id").unionByName(sem.select("query_id", "doc_id")).distinct()


BUDGET = 4000


def _planned(spark, d):
    hits = lexical.bm25_search(docs(spark, d), asked(spark, d), K)
    s = docs(spark, d).select("doc_id", context.render(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("source"), F.lit(1), F.size(F.split("text", "\n")), F.col("text")).alias("rendered"))
    return hits.join(s, "doc_id").withColumn("position", F.col("rank"))


def context_packing(spark, d):
    p = context.pack(_planned(spark, d), BUDGET)
    return p.select("query_id", F.col("position").cast("long").alias("position"), "doc_id", F.col("offset").cast("long").alias("offset"), "truncated", F.sha2("snippet", 256).alias("sha"))


def context_packages(spark, d):
    planned = _planned(spark, d)
    p = context.packages(context.pack(planned, BUDGET), planned)
    return p.select("query_id", F.sha2("context_text", 256).alias("sha"), F.col("budget_used").cast("long").alias("budget_used"), F.col("n_snippets").cast("long").alias("n_snippets"), "truncated")


def context_diagnostics(spark, d):
    planned = _planned(spark, d)
    return context.diagnostics(context.packages(context.pack(planned, BUDGET), planned), BUDGET)


def context_plan(spark, d):
    """Order of hits and of what a graph adds to them: the next two documents by id, from each hit of the first three."""
    hits = lexical.bm25_search(docs(spark, d), asked(spark, d), 5)
    graph = hits.filter("rank <= 3").select("query_id", F.col("doc_id").alias("seed"), F.explode(F.array(F.lit(1), F.lit(2))).alias("hop")).withColumn("doc_id", F.col("seed") + F.col("hop"))
    # a document that several seeds reach keeps the first seed, as expansion does
    graph = evaluation.first_seen(graph, ["query_id"], "doc_id", "seed")
    p = context.plan_order(hits, graph)
    return p.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"))


def _relevance(spark, d):
    return holding.holding(spread(docs(spark, d)), asked(spark, d)).withColumn("grade", F.lit(2))


def relevance(spark, d):
    return _relevance(spark, d).select("query_id", "doc_id", F.col("grade").cast("long").alias("grade"))


def _metrics(spark, d):
    truth = _relevance(spark, d)
    hits = lexical.bm25_search(docs(spark, d), asked(spark, d), K)
    return evaluation.query_metrics(hits, truth, truth.select("query_id").distinct())


def query_metrics(spark, d):
    return _metrics(spark, d)


def metric_strata(spark, d):
    m = _metrics(spark, d).withColumns({"parity": F.col("query_id") % 2, "third": F.col("query_id") % 3, "latency": F.col("query_id") * 1000 + 7})
    return evaluation.summary(m, ("parity", "third"), "latency")


def evidence_grades(spark, d):
    """Grades of file, chunk and symbol candidates; documents' lines are the symbols, their third line the evidence."""
    f = _files(spark, d)
    lines = chunks.line_symbols(f, "path", "text")
    symbols = lines.select(F.lit("symbol").alias("unit"), "identity", F.col("path").alias("relative_path"), F.col("identity").alias("symbol_id"), "start_offset", "end_offset")
    none = F.lit(None).cast("long")
    files = f.select(F.lit("file").alias("unit"), F.concat(F.lit("file:"), "path").alias("identity"), F.col("path").alias("relative_path"), F.lit(None).cast("string").alias("symbol_id"), none.alias("start_offset"), none.alias("end_offset"))
    cut = chunks.chunk_documents(f, "path", "text").select(F.lit("chunk").alias("unit"), "identity", F.col("path").alias("relative_path"), F.lit(None).cast("string").alias("symbol_id"), "start_offset", "end_offset")
    evidence = lines.filter("line = 3").select(F.lit(1).alias("query_id"), F.col("path").alias("relative_path"), F.col("identity").alias("symbol_id"), none.alias("start_offset"), none.alias("end_offset"), F.lit(2).alias("relevance"))
    spans = evaluation.evidence_spans(evidence, symbols.select("symbol_id", "start_offset", "end_offset"))
    return evaluation.grades(symbols.unionByName(files).unionByName(cut), spans).select("identity", F.col("grade").cast("long").alias("grade"))


QUERIES = {f.__name__: f for f in (
    token_counts, term_frequencies, corpus_statistics, bm25_ranking, file_documents, chunk_documents, chunk_bm25_ranking, semantic_ranking, semantic_null_ties, index_search,
    unit_vectors, fake_vectors, weighted_fusion, rrf_fusion, graph_fusion, degraded_retrieval, candidate_union, context_packing, context_packages, context_diagnostics,
    context_plan, relevance, query_metrics, metric_strata, evidence_grades,
)}

_TOKENS = f"tok AS MATERIALIZED ({sql_tokens('documents', 'doc_id', 'text')}), qtok AS (SELECT DISTINCT query_id, token FROM ({sql_tokens('(SELECT item_id AS query_id, text AS query_text FROM benchmark)', 'query_id', 'query_text')}))"


def _bm25(tok="tok", key="doc_id", source="documents", k=K):
    return f"""
stat AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT count(*) FROM {tok})::DOUBLE / (SELECT count(*) FROM {source}) AS avgdl),
dl AS (SELECT {key}, count(*) AS dl FROM {tok} GROUP BY 1),
tf AS (SELECT {key}, token, count(*) AS tf FROM {tok} WHERE token IN (SELECT token FROM qtok) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
scored AS (
  SELECT query_id, {key}, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) ORDER BY token)) AS score
  FROM qtok JOIN tf USING (token) JOIN df USING (token) JOIN dl USING ({key}), stat GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def _vec(n, text, seed=""):
    # the same numbers from hexadecimal digits
    word = f"substr(sha256(encode('{seed}' || {text}) || unhex(lpad(hex(i // 4), 16, '0'))), ((i % 4) * 16 + 1)::INT, 16)"
    return f"list_transform(range({n}), lambda i: (('0x' || {word})::UBIGINT)::DOUBLE / 9223372036854775808.0 - 1)"


_SEM = f"""
dv AS (SELECT doc_id, {_vec(16, 'text')} AS v FROM documents),
qv AS (SELECT item_id AS query_id, {_vec(16, 'text')} AS q FROM benchmark),
cos AS (SELECT query_id, doc_id, list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)) AS score FROM dv, qv),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cos) WHERE rank <= 50)"""

_FUSED = """
norm AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS ln FROM lex),
pair AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.doc_id, s.doc_id) AS doc_id, l.ln, l.rank AS lr, s.score AS sc, s.rank AS sr
  FROM norm l FULL JOIN sem s ON l.query_id = s.query_id AND l.doc_id = s.doc_id)"""


def _fused_sql(score, before="", extra=""):
    return f"""WITH {_TOKENS}, {_bm25(k=50)}, {_SEM}, {_FUSED}{before},
done AS (SELECT *, {score} AS score FROM pair)
SELECT query_id, doc_id, round(score, 6) AS score{extra}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM done) WHERE rank <= {K}"""


_WEIGHTED = "coalesce(ln, 0) + CASE WHEN sc IS NULL THEN 0 ELSE (greatest(-1, least(1, sc)) + 1) / 2 END"
_PLANNED = f"""hits AS (SELECT query_id, doc_id, rank FROM lex),
planned AS (SELECT query_id, rank AS position, doc_id, '[symbol] doc' || doc_id || ' (' || source || ':1-' || len(string_split(text, chr(10))) || ')' || chr(10) || text AS rendered FROM hits JOIN documents USING (doc_id)),
sized AS (SELECT *, length(rendered) + CASE WHEN position > 1 THEN 2 ELSE 0 END AS size FROM planned),
placed AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING)::BIGINT - length(rendered) AS off FROM sized),
packed AS (SELECT *, length(rendered) > {BUDGET} - off AS truncated, substr(rendered, 1, ({BUDGET} - off)::BIGINT) AS snippet FROM placed WHERE off < {BUDGET}),
pkg AS (SELECT query_id, string_agg(snippet, chr(10) || chr(10) ORDER BY position) AS t, count(*) AS n, bool_or(truncated) OR count(*) < (SELECT count(*) FROM planned p WHERE p.query_id = packed.query_id) AS cut FROM packed GROUP BY 1)"""
_FILES = "files AS (SELECT *, source || '/' || doc_id || '.txt' AS path, regexp_replace(text, '\r\n?', chr(10), 'g') AS body FROM documents)".replace("\\r", "' || chr(13) || '").replace("\\n?", "' || chr(10) || '?")
_CHUNKS = "chunk AS (SELECT doc_id, lang, path, 'chunk:' || path || ':' || s || ':' || least(s + 1200, length(body)) AS identity, s AS start_offset, least(s + 1200, length(body)) AS end_offset, path || chr(10) || substr(body, s + 1, 1200) AS document FROM (SELECT *, unnest(range(0, length(body), 1000)) AS s FROM files))"
_REL = "rel AS (SELECT item_id AS query_id, doc_id, 2 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_MET = f"""{_REL}, qs AS (SELECT DISTINCT query_id FROM rel),
hit AS (SELECT l.query_id, l.rank, coalesce(grade, 0) AS grade FROM lex l JOIN qs USING (query_id) LEFT JOIN rel USING (query_id, doc_id)),
ideal AS (SELECT query_id, max(n) AS n, sum(CASE WHEN r <= 5 THEN 3 / log2(r + 1) ELSE 0 END) AS best FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM rel) GROUP BY 1),
got AS (SELECT query_id, count(*) FILTER (grade > 0 AND rank <= 1) AS i1, count(*) FILTER (grade > 0 AND rank <= 5) AS i5, count(*) FILTER (grade > 0) AS i10, min(rank) FILTER (grade > 0) AS f, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM hit GROUP BY 1),
met AS (SELECT query_id, round(coalesce(i1 / n::DOUBLE, 0), 9) AS recall_1, round(coalesce(i5 / n::DOUBLE, 0), 9) AS recall_5, round(coalesce(i10 / n::DOUBLE, 0), 9) AS recall_10, round(coalesce(1.0::DOUBLE / f, 0), 9) AS mrr, round(coalesce(dcg / best, 0), 9) AS ndcg_5, round(coalesce(i5 / 5.0::DOUBLE, 0), 9) AS precision_5, (CASE WHEN coalesce(i5, 0) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_5 FROM qs JOIN ideal USING (query_id) LEFT JOIN got USING (query_id))"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluation.METRICS)
_VECQ = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e)) / sqrt(list_dot_product(q.e, q.e)) AS score FROM v, v q WHERE q.vec_id % 20 = 0)"

ORACLE = {
    "token_counts": f"WITH {_TOKENS} SELECT doc_id, count(token) AS n_tokens, count(DISTINCT token) AS n_terms FROM documents LEFT JOIN tok USING (doc_id) GROUP BY 1",
    "term_frequencies": f"WITH {_TOKENS} SELECT token AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY 1",
    "corpus_statistics": f"WITH {_TOKENS} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS tokens, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS average FROM tok",
    "bm25_ranking": f"WITH {_TOKENS}, {_bm25()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lex",
    "index_search": f"WITH {_TOKENS}, {_bm25()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lex",
    "file_documents": f"WITH {_FILES} SELECT 'file:' || path AS identity, length(path) + 1 + length(body) AS n_chars, sha256(path || chr(10) || body) AS sha FROM files",
    "chunk_documents": f"WITH {_FILES}, {_CHUNKS} SELECT identity, start_offset, end_offset, sha256(document) AS sha FROM chunk",
    "chunk_bm25_ranking": f"WITH {_FILES}, {_CHUNKS}, {_TOKENS.replace('FROM documents', 'FROM chunk').replace('doc_id', 'identity').replace('(text,', '(document,').replace('benchmark', 'benchmark')}, {_bm25(key='identity', source='chunk')} SELECT query_id, identity, round(score, 6) AS score, rank FROM lex".replace("(SELECT item_id AS query_id, document AS query_text", "(SELECT item_id AS query_id, text AS query_text"),
    "semantic_ranking": f"WITH {_VECQ} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= {K}",
    "semantic_null_ties": f"""WITH {_VECQ}, t AS (SELECT query_id, vec_id, round(score, 1) AS score, CASE WHEN label % 3 = 0 THEN NULL ELSE label END AS tie FROM c)
SELECT query_id, vec_id, 'null_last' AS ties, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie NULLS LAST, vec_id) AS rank FROM t) WHERE rank <= 30
UNION ALL SELECT query_id, vec_id, 'null_as_empty', rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(tie, -1), vec_id) AS rank FROM t) WHERE rank <= 30""",
    "unit_vectors": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / l)), 6) AS total, 1.0::DOUBLE AS length, NULL::VARCHAR AS error FROM n",
    "fake_vectors": f"SELECT doc_id, i AS pos, round(v[i + 1], 9) AS x FROM (SELECT doc_id, unnest(range(6)) AS i, {_vec(6, 'text', 'seed')} AS v FROM documents)",
    "weighted_fusion": _fused_sql(_WEIGHTED),
    "rrf_fusion": _fused_sql("coalesce(1.0 / (60 + lr)::DOUBLE, 0) + coalesce(1.0 / (60 + sr)::DOUBLE, 0)"),
    "graph_fusion": _fused_sql(_WEIGHTED + " + 0.25 * coalesce(gs, 0)", """,
top AS (SELECT query_id, doc_id AS seed, source FROM lex JOIN documents USING (doc_id) WHERE rank = 1),
gr AS (SELECT query_id, d.doc_id, max(CASE WHEN d.doc_id % 2 = 0 THEN 1.0 ELSE 0.75 END * CASE WHEN d.doc_id % 3 = 0 THEN 1.0 ELSE 0.8 END)::DOUBLE AS gs FROM top JOIN documents d USING (source) WHERE d.doc_id <> seed GROUP BY 1, 2)""", ", round(coalesce(gs, 0), 6)::DOUBLE AS graph_score").replace("FROM pair)", "FROM pair LEFT JOIN gr USING (query_id, doc_id))"),
    "degraded_retrieval": f"WITH {_TOKENS}, {_bm25()} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, true AS degraded, 'RuntimeError' AS degradation_reason FROM lex",
    "candidate_union": f"WITH {_TOKENS}, {_bm25(k=50)}, {_SEM} SELECT query_id, doc_id FROM lex UNION SELECT query_id, doc_id FROM sem",
    "context_packing": f"WITH {_TOKENS}, {_bm25()}, {_PLANNED} SELECT query_id, position, doc_id, off AS \"offset\", truncated, sha256(snippet) AS sha FROM packed",
    "context_packages": f"WITH {_TOKENS}, {_bm25()}, {_PLANNED} SELECT query_id, sha256(t) AS sha, length(t) AS budget_used, n AS n_snippets, cut AS truncated FROM pkg",
    "context_diagnostics": f"WITH {_TOKENS}, {_bm25()}, {_PLANNED} SELECT count(*) AS queries, sum(length(t))::BIGINT AS budget_used, count(*) * {BUDGET} AS budget_total, sum(n)::BIGINT AS snippets, count(*) FILTER (cut) AS truncated_packages, round(count(*) FILTER (cut) / sum(n), 6)::DOUBLE AS snippet_truncation_rate FROM pkg",
    "context_plan": f"""WITH {_TOKENS}, {_bm25(k=5)},
reach AS (SELECT query_id, doc_id AS seed, h AS hop, doc_id + h AS doc_id FROM lex, (VALUES (1), (2)) t(h) WHERE rank <= 3),
one AS (SELECT * FROM reach QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY seed) = 1),
late AS (SELECT o.query_id, o.doc_id, l.rank AS major, o.hop FROM one o JOIN lex l ON l.query_id = o.query_id AND l.doc_id = o.seed WHERE NOT EXISTS (SELECT 1 FROM lex x WHERE x.query_id = o.query_id AND x.doc_id = o.doc_id)),
al AS (SELECT query_id, doc_id, rank, rank AS major, 0 AS minor, 0 AS hop FROM lex UNION ALL SELECT query_id, doc_id, NULL, major, 1, hop FROM late)
SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY major, minor, hop, doc_id) AS position FROM al""",
    "relevance": f"WITH {_REL} SELECT query_id, doc_id, grade::BIGINT AS grade FROM rel",
    "query_metrics": f"WITH {_TOKENS}, {_bm25()}, {_MET} SELECT * FROM met",
    "metric_strata": f"""WITH {_TOKENS}, {_bm25()}, {_MET}, m AS (SELECT *, query_id % 2 AS parity, query_id % 3 AS third, query_id * 1000 + 7 AS latency FROM met)
SELECT CASE WHEN grouping(parity) = 0 THEN 'parity' WHEN grouping(third) = 0 THEN 'third' ELSE 'overall' END AS stratum, count(*) AS queries, {_MEANS}, floor(quantile_cont(latency, 0.5))::BIGINT AS latency_median, quantile_disc(latency, 0.95)::BIGINT AS latency_p95, coalesce(parity, third)::VARCHAR AS value
FROM m GROUP BY GROUPING SETS ((parity), (third), ())""",
    "evidence_grades": f"""WITH {_FILES}, {_CHUNKS},
ln AS (SELECT path, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM files),
sym AS (SELECT path, line, 'symbol:' || path || ':' || line AS identity, (sum(length(t) + 1) OVER (PARTITION BY path ORDER BY line) - length(t) - 1)::BIGINT AS s, (sum(length(t) + 1) OVER (PARTITION BY path ORDER BY line) - 1)::BIGINT AS e FROM ln),
ev AS (SELECT * FROM sym WHERE line = 3)
SELECT 'file:' || path AS identity, 2::BIGINT AS grade FROM files JOIN ev USING (path)
UNION ALL SELECT DISTINCT sym.identity, 2 FROM sym JOIN ev USING (path) WHERE sym.identity = ev.identity OR (sym.s <= ev.s AND ev.e <= sym.e)
UNION ALL SELECT chunk.identity, 2 FROM chunk JOIN ev USING (path) WHERE greatest(start_offset, ev.s) < least(end_offset, ev.e)""",
}
