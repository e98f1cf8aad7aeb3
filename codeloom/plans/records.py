"""Queries over files that are written and read again, validated records, runs and folds. Files stand in the folder of written tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import benchmark, evaluation, ledger, provenance
from codeloom.operators.rounds import folder_of
from codeloom.sources import readers, scan, sinks

from . import ledgers, retrieval
from ._common import table

#: Of a nation's file, by its key: extension and text, as SQL of both engines.
EXTENSION = "case n_nationkey % 4 when 0 then 'py' when 1 then 'java' when 2 then 'md' else 'log' end"
BODY = "concat('# ', n_name, chr(13), chr(10), 'x = ', n_nationkey, chr(13), 'é', chr(10))"
PATH = f"concat('src/r', n_regionkey, '/', lower(n_name), '.', {EXTENSION})"


def _tree(spark, d) -> tuple[str, list]:
    """A folder with one small file for each of the 25 nations, written by the driver through Spark's file systems; and its rows."""
    folder = folder_of(spark, "tree")
    rows = table(spark, d, "nation").select(F.expr(PATH).alias("path"), F.expr(BODY).alias("body"), F.sha2(F.expr(BODY), 256).alias("hash")).collect()
    jvm = spark.sparkContext._jvm
    for r in rows:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.path}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(r.body.encode()))
        out.close()
    return folder, rows


def project_scan(spark, d):
    """Paths, languages, sizes and hashes of a tree, without ignored files, and their verified text with LF line ends."""
    folder, rows = _tree(spark, d)
    files = scan.scan(spark, folder, ["*.log", "src/r4/"])
    snapshot = spark.createDataFrame([(r.path, r.hash) for r in rows if not r.path.endswith(".log") and "/r4/" not in r.path], "relative_path string, content_hash string")
    text = scan.verified_sources(files, snapshot).select("relative_path", F.sha2("content", 256).alias("text_sha"))
    return files.select("relative_path", "language", "size_bytes", "content_hash").join(text, "relative_path")


def upload_files(spark, d):
    """Python and Java files of a tree."""
    folder, _ = _tree(spark, d)
    return scan.uploads(spark, folder).select("relative_path", "language")


def dataset_records(spark, d):
    """Documents as JSONL records, read back with just their fields, unique keys, in order."""
    folder = folder_of(spark, "records")
    rows = table(spark, d, "documents").select("doc_id", "lang", "text")
    rows.write.option("ignoreNullFields", False).json(folder)
    return readers.read_dataset(spark, folder, rows.schema, "doc_id").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))


def csv_export(spark, d):
    """Metrics by market segment in long form, exported and read back."""
    folder = folder_of(spark, "csv")
    wide = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("customers"), F.max("c_acctbal").cast("double").alias("most"))
    sinks.write_csv(sinks.metric_rows(wide, ["c_mktsegment"], ["customers", "most"]), folder)
    return spark.read.option("header", True).schema("c_mktsegment string, metric string, value double").csv(folder)


def run_artifacts(spark, d):
    """Orders written once as a run, its files checked against their hashes, and read back."""
    folder = folder_of(spark, "runs")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    path = sinks.write_run(rows, folder, "r1")
    return spark.read.parquet(path).withColumn("verified", F.lit(sinks.verify_run(spark, folder, "r1")))


def archive_members(spark, d):
    """An archive of the regions' texts, a log and documentation, unpacked again."""
    regions = {r.p: r.t for r in table(spark, d, "region").select(F.concat(F.lit("r/"), F.col("r_regionkey").cast("string"), F.lit(".py")).alias("p"), F.col("r_name").alias("t")).collect()}
    packed = spark.createDataFrame([("a.zip", bytearray(sinks.batch_zip(regions, "log", "docs"))), ("bad.zip", bytearray(b"x"))], "path string, content binary")
    return readers.read_zip(packed).select("archive", "relative_path", F.decode("content", "UTF-8").alias("text"), "error")


def frozen_sources(spark, d):
    """Documents as blobs that agree with their manifest and with the hashes beside them."""
    blobs = table(spark, d, "documents").select(F.lit("p").alias("project_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("relative_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    manifest = blobs.select("project_id", "relative_path", F.sha2("content", 256).alias("content_hash"))
    files = readers.frozen_blobs(blobs, manifest).select("relative_path", "content")
    side = files.select(F.concat("relative_path", F.lit(".sha256")).alias("relative_path"), F.encode(F.concat(F.sha2("content", 256), F.lit("  name")), "UTF-8").alias("content"))
    return readers.sidecar_verified(files.unionByName(side)).select("relative_path", F.sha2("content", 256).alias("sha"))


def canonical_records(spark, d):
    """Canonical JSON and its hash of each event's properties; a repeated key makes none."""
    raw = F.expr("case event_id % 3 when 0 then concat('{ \"b\" : ', props, ', \"a\": null }') when 1 then concat('{\"a\":1, \"a\":', event_id, '}') else props end")
    text = provenance.strict_json_udf()(raw)
    return table(spark, d, "events").select("event_id", text.alias("json"), F.sha2(text, 256).alias("sha"))


def private_records(spark, d):
    """Whether a nested record holds something private: keys and values at any depth, but for graded candidates."""
    raw = F.expr("""case event_id % 6
        when 0 then concat('{"a": [', props, ', {"api_key": 1}]}') when 1 then concat('{"metric_inputs": {"file:password.py": ', event_id % 3, '}}')
        when 2 then concat('{"metric_inputs": {"file:password.py": ', event_id, '.5}}') when 3 then concat('{"x": ["ok", ["password=hunter', event_id, '"]]}')
        when 4 then '{"metric_inputs": {"symbol:{\\\\"name\\\\": \\\\"secret\\\\", \\\\"secret\\\\": 1}": 1}}' else props end""")
    return table(spark, d, "events").select("event_id", provenance.private_record_udf()(raw).alias("private"))


def populations(spark, d):
    """The queries of a split, and the candidates of a project and unit."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.expr("case when item_id % 3 = 0 then 'test' else 'train' end").alias("split"))
    candidates = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("project_id"), F.expr("case when doc_id % 2 = 0 then 'file' else 'chunk' end").alias("unit"))
    return evaluation.population(queries, "test").select("id").unionByName(evaluation.candidates_for(candidates, "src0", "file").select("id"))


def linked_truth(spark, d):
    """Queries with the truth that belongs to them; evidence that names files, symbols and spans that are there; hits that are candidates."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("ground_truth_id"))
    truth = q.withColumns({"grade": F.expr("query_id % 3"), "truth_version": F.lit("v1"), "derivation_rule_version": F.lit("r1")})
    docs = table(spark, d, "documents").select(F.lit("p").alias("project_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("relative_path"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    none = F.lit(None).cast("long")
    candidates = docs.select("project_id", F.lit("file").alias("unit"), F.concat(F.lit("file:"), "relative_path").alias("identity"), "relative_path", none.alias("start_offset"), none.alias("end_offset"))
    evaluation.validate_registry(docs, candidates, docs.select("project_id", "relative_path", "content_hash"))
    evaluation.validate_retrieved(candidates.filter("relative_path like '%7'"), candidates)
    symbols = docs.select(F.concat(F.lit("s:"), "relative_path").alias("symbol_id"))
    evidence = docs.filter("length > 9").select("relative_path", F.concat(F.lit("s:"), "relative_path").alias("symbol_id"), F.lit(0).cast("long").alias("start_offset"), (F.col("length") - 1).alias("end_offset"))
    evaluation.validate_truth(evidence, docs, symbols)
    return evaluation.validate_links(q, truth, {"truth_version": "v1", "derivation_rule_version": "r1"}).select("query_id", "ground_truth_id", "grade")


def experiment_matrix(spark, d):
    return benchmark.matrix(spark)


def benchmark_run(spark, d):
    """Experiments over the benchmark: one that works, and one whose branch fails and counts as zeros."""
    def broken():
        raise RuntimeError("no model")

    truth = retrieval._relevance(spark, d)
    asked = truth.select("query_id").distinct()
    lex, _ = retrieval._branches(spark, d, retrieval.K)
    made = benchmark.run(["RQ2-BM25", "RQ2-E5"], benchmark.Branches(lambda unit: lex, broken, broken), asked, truth)
    return made.select("experiment", "query_id", "status", *[F.round(m, 9).alias(m) for m in evaluation.METRICS])


def appended_transactions(spark, d):
    """Two batches of transactions appended to a table: what each became."""
    path = folder_of(spark, "transactions")
    t = ledgers._transactions(spark, d).select("account_id", "type", "amount", "request_id", "note", "sequence")
    first = ledger.append_transactions(path, t.filter("sequence % 2 = 0"))
    return first.unionByName(ledger.append_transactions(path, t.filter("sequence % 2 = 1"))).select("sequence", "outcome")


QUERIES = {f.__name__: f for f in (
    project_scan, upload_files, dataset_records, csv_export, run_artifacts, archive_members, frozen_sources, canonical_records, private_records, populations, linked_truth,
    experiment_matrix, benchmark_run, appended_transactions,
)}

_TREE = f"tree AS (SELECT {PATH} AS relative_path, {EXTENSION} AS ext, {BODY} AS body, n_regionkey FROM nation)"
_LANGUAGE = "CASE ext WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' ELSE 'markdown' END"
_ZEROS = ", ".join(f"0.0::DOUBLE AS {m}" for m in evaluation.METRICS)
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else "'" + (x if isinstance(x, str) else ":".join(x)) + "'" for x in row) + ")" for row in benchmark.MATRIX)

ORACLE = {
    "project_scan": f"WITH {_TREE} SELECT relative_path, {_LANGUAGE} AS language, strlen(body) AS size_bytes, sha256(body) AS content_hash, sha256(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha FROM tree WHERE ext <> 'log' AND n_regionkey <> 4",
    "upload_files": f"WITH {_TREE} SELECT relative_path, {_LANGUAGE} AS language FROM tree WHERE ext IN ('py', 'java')",
    "dataset_records": "SELECT doc_id, lang, sha256(text) AS sha FROM documents",
    "csv_export": "WITH w AS (SELECT c_mktsegment, count(*)::DOUBLE AS customers, max(c_acctbal)::DOUBLE AS most FROM customer GROUP BY 1) SELECT c_mktsegment, 'customers' AS metric, customers AS value FROM w UNION ALL SELECT c_mktsegment, 'most', most FROM w",
    "run_artifacts": "SELECT o_orderkey, o_orderstatus, true AS verified FROM orders",
    "archive_members": "SELECT 'a.zip' AS archive, 'r/' || r_regionkey || '.py' AS relative_path, r_name AS text, NULL::VARCHAR AS error FROM region UNION ALL VALUES ('a.zip', 'processing.log', 'log', NULL), ('a.zip', 'API_DOCS_ALL.md', 'docs', NULL), ('bad.zip', NULL, NULL, 'NOT_AN_ARCHIVE')",
    "frozen_sources": "SELECT 'd' || doc_id AS relative_path, sha256(coalesce(text, '')) AS sha FROM documents",
    "canonical_records": """WITH c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"a":null,"b":{"k":' || (props::JSON->>'k') || '}}' WHEN 2 THEN '{"k":' || (props::JSON->>'k') || '}' END AS json FROM events) SELECT event_id, json, sha256(json) AS sha FROM c""",
    # graded candidates are numbers 0 to 2; others of these names are fields
    "private_records": "SELECT event_id, event_id % 6 IN (0, 2, 3, 4) AS private FROM events",
    "populations": "SELECT item_id::VARCHAR AS id FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 'd' || doc_id FROM documents WHERE source = 'src0' AND doc_id % 2 = 0",
    "linked_truth": "SELECT item_id AS query_id, 't' || item_id AS ground_truth_id, item_id % 3 AS grade FROM benchmark",
    "experiment_matrix": f"SELECT * FROM (VALUES {_ROWS}) t(experiment, unit, method, graph)",
    "benchmark_run": f"WITH {retrieval._TOKENS}, {retrieval._bm25()}, {retrieval._MET} SELECT 'RQ2-BM25' AS experiment, query_id, 'success' AS status, {', '.join(evaluation.METRICS)} FROM met UNION ALL SELECT 'RQ2-E5', query_id, 'failed', {_ZEROS} FROM met",
    "appended_transactions": f"""WITH {ledgers._TX}, o AS (SELECT *, first_value(amount) OVER k AS had, first_value(note) OVER k AS said, row_number() OVER k AS n FROM tx WINDOW k AS (PARTITION BY type, account_id, request_id ORDER BY sequence % 2, sequence))
SELECT sequence, CASE WHEN request_id IS NULL OR n = 1 THEN 'applied' WHEN amount = had AND note = said THEN 'replayed' ELSE 'conflict' END AS outcome FROM o""",
}
