"""Queries over snapshots, incremental indexes and graphs.

Documents stand for the files of two snapshots, pages and their links for a project graph, customers and nations
for methods and classes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.numeric import fake_embedding
from codeloom.operators import evaluation, graph, snapshots

from ._common import table

HASH = "md5(text)"


def _old(spark, d):
    return table(spark, d, "documents").filter("doc_id % 5 <> 0").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("relative_path"), F.col("lang").alias("language"), F.expr(HASH).alias("content_hash"))


def _new(spark, d):
    t = table(spark, d, "documents").filter("doc_id % 7 <> 0")
    return t.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("relative_path"), F.expr("case when doc_id % 13 = 0 then null else lang end").alias("language"), F.expr(f"case when doc_id % 11 = 0 then md5(concat(text, 'x')) else {HASH} end").alias("content_hash"))


def snapshot_diff(spark, d):
    return snapshots.compare_snapshots("p", "p", _old(spark, d), _new(spark, d), ["relative_path"], ["language", "content_hash"])


def index_plan(spark, d):
    return snapshots.index_plan(snapshot_diff(spark, d))


def set_changes(spark, d):
    sets = snapshots.set_changes(_old(spark, d).select("relative_path"), _new(spark, d).select("relative_path"))
    out = None
    for name, rows in sets.items():
        some = rows.select(F.lit(name).alias("kind"), "relative_path")
        out = some if out is None else out.unionByName(some)
    return out


def incremental_update(spark, d):
    """The index over the new snapshot, made from the old one's; vectors are told by a sum."""
    embed = lambda rows: rows.withColumn("vector", fake_embedding(F.col("content_hash"), 8))
    old, new = (rows(spark, d).select(F.col("relative_path").alias("id"), "content_hash") for rows in (_old, _new))
    index = snapshots.update_vectors(embed(old), new, embed)
    return index.select("id", "content_hash", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def snapshot_metadata(spark, d):
    files, symbols = table(spark, d, "documents"), table(spark, d, "customer")
    nodes, edges = _graph(spark, d)
    return snapshots.metadata(files, symbols, nodes, edges)


def snapshot_identity(spark, d):
    return snapshots.content_identity(_old(spark, d), ["relative_path", "language", "content_hash"])


def framed_identity(spark, d):
    return snapshots.framed_hash(table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("k")), ["n_name", "k"], "v1")


def _host(c):
    return F.regexp_extract(c, "^https?://([^/]+)", 1)


def _graph(spark, d):
    pages = table(spark, d, "pages")
    page = F.concat(F.lit("page:"), F.col("page_id").cast("string"))
    host = F.concat(F.lit("host:"), _host(F.col("url")))
    links = pages.select(page.alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    nodes = (
        pages.select(F.lit("file").alias("kind"), page.alias("identity"), F.col("url").alias("label"))
        .unionByName(pages.select(F.lit("project").alias("kind"), host.alias("identity"), host.alias("label")))
        .unionByName(links.select(F.lit("external").alias("kind"), F.col("target").alias("identity"), F.col("target").alias("label")))
        .distinct()
    )
    edges = pages.select(host.alias("source"), page.alias("target"), F.lit("contains").alias("relation")).unionByName(links.withColumn("relation", F.lit("imports"))).distinct()
    return nodes, edges


def graph_counts(spark, d):
    nodes, edges = _graph(spark, d)
    n = nodes.groupBy("kind").agg(F.count("*").alias("n"))
    return n.unionByName(graph.edges_of_kind(edges, "imports").agg(F.lit("edge:imports").alias("kind"), F.count("*").alias("n"))).unionByName(graph.edges_of_kind(edges, "contains").agg(F.lit("edge:contains").alias("kind"), F.count("*").alias("n")))


def graph_expansion(spark, d):
    """What the first pages reach in two hops: hosts and pages are shown, link targets only passed through."""
    nodes, edges = _graph(spark, d)
    seeds = spark.createDataFrame([(f"page:{i}",) for i in range(5)], "seed string")
    shown = nodes.filter("kind in ('file', 'project')").select(F.col("identity").alias("node"))
    return graph.expand(edges, seeds, shown, max_hops=2).withColumn("hop", F.col("hop").cast("long"))


def import_resolution(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    path = lambda i: f"concat('src', {i} % 20, '/d', {i}, '.py')"
    files = docs.select(F.expr(path("doc_id")).alias("relative_path")).unionByName(docs.filter("doc_id % 9 = 0").select(F.expr("concat('src', doc_id % 20, '/d', doc_id, '/__init__.py')").alias("relative_path")))
    imports = docs.select(F.expr(path("doc_id")).alias("importer"), F.explode(F.expr("array(concat('src', (doc_id + 1) % 20, '.d', doc_id + 1), concat('.d', doc_id + 20), '..src3.d3', 'os.path')")).alias("target"))
    return graph.resolve_imports(imports, files)


def java_imports(spark, d):
    """Imports between Java files: parts are classes in packages by brand, some inside another class, some names twice, every eleventh file without a class."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("replace(p_brand, 'Brand#', 'b')").alias("b"))
    path = F.expr("concat('src/', b, '/T', k, '.java')")
    files = parts.select(path.alias("relative_path"))
    packages = parts.select(path.alias("relative_path"), F.expr("case when k % 13 = 0 then '' else concat('org.', b) end").alias("package"))
    name = F.expr("case when k % 5 = 0 then concat('T', k, '.Inner') when k % 7 = 0 then 'Same' else concat('T', k) end")
    symbols = parts.filter("k % 11 <> 0").select(path.alias("relative_path"), name.alias("qualified_name"), F.lit("class").alias("kind"))
    wanted = F.expr("array(concat('org.', b, '.T', k), concat('org.', b, '.T', k, '.Inner'), concat('T', k), concat('org.', b, '.Same'), concat('org.', b, '.*'))")
    imports = parts.select(F.expr("concat('src/x/U', k % 50, '.java')").alias("importer"), F.explode(wanted).alias("target"))
    return graph.resolve_imports(imports, files, graph.java_types(files, symbols, packages))


def _symbols(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    classes = nation.select(F.expr("concat('N', n_nationkey)").alias("id"), F.expr("concat('r', n_regionkey)").alias("relative_path"), F.expr("concat('N', n_nationkey)").alias("qualified_name"), F.lit("class").alias("kind"), F.expr("n_nationkey * 100").alias("start_line"), F.expr("n_nationkey * 100 + 79").alias("end_line"))
    methods = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.expr("concat('C', c_custkey)").alias("id"), F.expr("concat('r', n_regionkey)").alias("relative_path"), F.expr("concat('N', n_nationkey, '.m', c_custkey)").alias("qualified_name"), F.lit("method").alias("kind"), F.expr("cast(n_nationkey * 100 + c_custkey % 100 as int)").alias("start_line"), F.expr("cast(n_nationkey * 100 + c_custkey % 100 as int)").alias("end_line"))
    return classes.unionByName(methods)


def class_containment(spark, d):
    return graph.class_parents(_symbols(spark, d))


def _findings(spark, d):
    symbols = _symbols(spark, d)
    contains = graph.class_parents(symbols).select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("contains").alias("relation"))
    _, edges = _graph(spark, d)
    files = symbols.select("relative_path").distinct()

    def broken():
        raise RuntimeError("tool")

    return graph.analyse({
        "complexity": lambda: graph.method_counts(contains, symbols, 4),
        "structure": lambda: graph.symbol_density(files, symbols, 30),
        "dependency": lambda: graph.import_fan_out(edges, 5),
        "broken": broken,
    }, spark)


def analysis_findings(spark, d):
    return graph.sort_findings(_findings(spark, d)).withColumn("line", F.col("line").cast("long"))


#: Customers are files in groups of 40; an order imports one a little further on, one in 29 any of the group.
STEP = "o_custkey div 40 * 40 + case when o_orderkey % 29 = 0 then o_orderkey % 40 else least(39, o_custkey % 40 + 1 + o_orderkey % 3) end"


def import_cycles(spark, d):
    edges = table(spark, d, "orders").select(F.expr("concat('f', o_custkey)").alias("source"), F.expr(f"concat('f', {STEP})").alias("target"))
    return graph.import_cycles(edges).withColumn("line", F.col("line").cast("long"))


def document_validation(spark, d):
    """Snapshot and documents agree: no row; the changed ones otherwise."""
    bad = snapshots.diff(_old(spark, d), _new(spark, d).filter("doc_id % 5 <> 0"), ["relative_path"], ["content_hash"]).filter("action <> 'unchanged'")
    return bad


def duplicate_keys(spark, d):
    """Links that a page has more than once."""
    pages = table(spark, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    return links.groupBy("page_id", "target").agg(F.count("*").alias("n")).filter("n > 1")


def first_seen_links(spark, d):
    """The first place of each link target of a page."""
    pages = table(spark, d, "pages")
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "target"))
    return evaluation.first_seen(links, ["page_id"], "target", "pos").withColumn("pos", F.col("pos").cast("long"))


QUERIES = {f.__name__: f for f in (
    snapshot_diff, index_plan, set_changes, incremental_update, snapshot_metadata, snapshot_identity, framed_identity, graph_counts, graph_expansion, import_resolution,
    class_containment, analysis_findings, import_cycles, java_imports, document_validation, duplicate_keys, first_seen_links,
)}

_OLD = "old AS (SELECT doc_id, 'd' || doc_id AS relative_path, lang AS language, md5(text) AS content_hash FROM documents WHERE doc_id % 5 <> 0)"
_NEW = "new AS (SELECT doc_id, 'd' || doc_id AS relative_path, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS language, CASE WHEN doc_id % 11 = 0 THEN md5(text || 'x') ELSE md5(text) END AS content_hash FROM documents WHERE doc_id % 7 <> 0)"
_DIFF = f"""{_OLD}, {_NEW}, df AS (SELECT coalesce(o.relative_path, n.relative_path) AS relative_path,
  CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.language IS NOT DISTINCT FROM n.language AND o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS action
  FROM old o FULL JOIN new n ON o.relative_path = n.relative_path)"""
_VEC8 = "list_sum(list_transform(range(8), lambda i: (('0x' || substr(sha256(encode(content_hash) || unhex(lpad(hex(i // 4), 16, '0'))), ((i % 4) * 16 + 1)::INT, 16))::UBIGINT)::DOUBLE / 9223372036854775808.0 - 1))"
_LINKS = """links AS (SELECT page_id, 'page:' || page_id AS source, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) - 1 AS pos FROM pages)"""
_GRAPH = f"""{_LINKS}, host AS (SELECT 'page:' || page_id AS page, url, 'host:' || regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
nodes AS (SELECT 'file' AS kind, page AS identity FROM host UNION SELECT 'project', host FROM host UNION SELECT 'external', target FROM links),
edges AS (SELECT host AS source, page AS target, 'contains' AS relation FROM host UNION SELECT source, target, 'imports' FROM links)"""
_SYM = """cls AS (SELECT 'N' || n_nationkey AS id, 'r' || n_regionkey AS relative_path, n_nationkey * 100 AS s FROM nation),
met AS (SELECT 'C' || c_custkey AS id, 'r' || n_regionkey AS relative_path, 'N' || n_nationkey AS cls, n_nationkey * 100 + c_custkey % 100 AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
par AS (SELECT met.id AS child, cls.id AS parent FROM met JOIN cls ON met.cls = cls.id AND cls.s <= met.s AND met.s <= cls.s + 79)"""

ORACLE = {
    "snapshot_diff": f"WITH {_DIFF} SELECT * FROM df",
    "index_plan": f"WITH {_DIFF} SELECT *, CASE action WHEN 'added' THEN 'add' WHEN 'removed' THEN 'delete' WHEN 'changed' THEN 'replace' ELSE 'reuse' END AS step FROM df",
    "set_changes": f"WITH {_OLD}, {_NEW} SELECT 'added' AS kind, relative_path FROM (SELECT relative_path FROM new EXCEPT SELECT relative_path FROM old) UNION ALL SELECT 'removed', relative_path FROM (SELECT relative_path FROM old EXCEPT SELECT relative_path FROM new) UNION ALL SELECT 'common', relative_path FROM (SELECT relative_path FROM old INTERSECT SELECT relative_path FROM new)",
    "incremental_update": f"WITH {_NEW} SELECT relative_path AS id, content_hash, round({_VEC8}, 6) AS total FROM new",
    "snapshot_metadata": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM customer) AS symbols, (SELECT count(*) FROM (SELECT DISTINCT kind, identity, CASE WHEN kind = 'file' THEN (SELECT url FROM host WHERE page = identity) END FROM nodes)) AS nodes, (SELECT count(*) FROM edges) AS edges",
    "snapshot_identity": f"""WITH {_OLD}, h AS (SELECT sha256(concat_ws(chr(31), '=' || relative_path, '=' || language, '=' || content_hash)) AS h FROM old),
s AS (SELECT count(*) AS n, {', '.join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT::HUGEINT) AS s{k}" for k in range(4))} FROM h)
SELECT n, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS hash FROM s""",
    "framed_identity": "SELECT sha256(string_agg(x, '' ORDER BY o)) AS hash FROM (SELECT '' AS o, 'v1' || chr(0) AS x UNION ALL SELECT n_name || chr(1) || n_nationkey, n_name || chr(0) || n_nationkey || chr(0) FROM nation)",
    "graph_counts": f"WITH {_GRAPH} SELECT kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'edge:' || relation, count(*) FROM edges GROUP BY 1",
    "graph_expansion": f"""WITH {_GRAPH}, adj AS (SELECT source AS a, target AS b, relation, 'forward' AS direction FROM edges UNION SELECT target, source, relation, 'reverse' FROM edges),
seeds AS (SELECT 'page:' || i AS seed FROM range(5) t(i)),
h1 AS (SELECT seed, b AS node, min((relation, direction)) AS r, 1 AS hop FROM seeds JOIN adj ON a = seed WHERE b <> seed GROUP BY 1, 2),
h2 AS (SELECT seed, b AS node, min((relation, direction)) AS r, 2 AS hop FROM (SELECT seed, b, relation, direction FROM (SELECT seed, node FROM h1) JOIN adj ON a = node) x WHERE b <> seed AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = x.seed AND h1.node = x.b) GROUP BY 1, 2),
al AS (SELECT h.* FROM (SELECT seed, node, hop, r[1] AS relation, r[2] AS direction FROM h1 UNION ALL SELECT seed, node, hop, r[1], r[2] FROM h2) h JOIN nodes ON identity = node AND kind <> 'external'),
five AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node, relation, direction) AS n FROM al QUALIFY n <= 5),
once AS (SELECT * FROM five QUALIFY row_number() OVER (PARTITION BY node ORDER BY seed, n) = 1)
SELECT seed, node, relation, direction, hop::BIGINT AS hop FROM once QUALIFY row_number() OVER (ORDER BY seed, n) <= 30""",
    "import_resolution": """WITH mods AS (SELECT name, min(path) AS path FROM (
  SELECT 'src' || doc_id % 20 || '.d' || doc_id AS name, 'src' || doc_id % 20 || '/d' || doc_id || '.py' AS path FROM documents
  UNION ALL SELECT 'src' || doc_id % 20 || '.d' || doc_id, 'src' || doc_id % 20 || '/d' || doc_id || '/__init__.py' FROM documents WHERE doc_id % 9 = 0) GROUP BY 1 HAVING count(*) = 1),
imp AS (SELECT 'src' || doc_id % 20 || '/d' || doc_id || '.py' AS importer, unnest(['src' || (doc_id + 1) % 20 || '.d' || (doc_id + 1), 'src' || doc_id % 20 || '.d' || (doc_id + 20), 'unresolved-relative:src' || doc_id % 20 || ':2:src3.d3', 'os.path']) AS target FROM documents)
SELECT DISTINCT importer, target, path AS resolved FROM imp LEFT JOIN mods ON name = target""",
    "java_imports": """WITH p AS (SELECT p_partkey AS k, replace(p_brand, 'Brand#', 'b') AS b FROM part),
t AS (SELECT DISTINCT CASE WHEN k % 13 = 0 THEN '' ELSE 'org.' || b || '.' END || CASE WHEN k % 11 = 0 THEN 'T' || k WHEN k % 5 = 0 THEN 'T' || k || '.Inner' WHEN k % 7 = 0 THEN 'Same' ELSE 'T' || k END AS target, 'src/' || b || '/T' || k || '.java' AS path FROM p),
u AS (SELECT target, min(path) AS resolved FROM t GROUP BY 1 HAVING count(*) = 1),
i AS (SELECT DISTINCT 'src/x/U' || k % 50 || '.java' AS importer, unnest(['org.' || b || '.T' || k, 'org.' || b || '.T' || k || '.Inner', 'T' || k, 'org.' || b || '.Same', 'org.' || b || '.*']) AS target FROM p)
SELECT importer, target, resolved FROM i LEFT JOIN u USING (target)""",
    "class_containment": f"WITH {_SYM} SELECT child, parent FROM par",
    "analysis_findings": f"""WITH {_SYM}, {_GRAPH}
SELECT 'complexity.class_method_count' AS rule_id, 'Class ''' || cls.id || ''' defines ' || count(*) || ' direct methods, exceeding the limit of 4.' AS message, 'warning' AS severity, cls.relative_path, 0::BIGINT AS line, NULL::VARCHAR AS symbol_id FROM par JOIN cls ON parent = cls.id GROUP BY cls.id, cls.relative_path HAVING count(*) > 4
UNION ALL SELECT 'structure.symbol_density', 'File defines ' || count(*) || ' symbols, exceeding the limit of 30.', 'warning', relative_path, 0, NULL FROM (SELECT relative_path FROM cls UNION ALL SELECT relative_path FROM met) GROUP BY relative_path HAVING count(*) > 30
UNION ALL SELECT 'dependency.concentration', 'File imports ' || count(DISTINCT target) || ' distinct targets, exceeding the limit of 5.', 'warning', source, 0, NULL FROM edges WHERE relation = 'imports' GROUP BY source HAVING count(DISTINCT target) > 5
UNION ALL SELECT 'analysis.tool_failure', 'Analysis tool ''broken'' failed: RuntimeError.', 'error', '', 0, NULL""",
    "import_cycles": f"""WITH RECURSIVE e AS (SELECT DISTINCT 'f' || o_custkey AS a, 'f' || ({STEP.replace('div', '//')}) AS b FROM orders),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT 'dependency.cycle' AS rule_id, 'Import cycle includes ' || count(*) || CASE WHEN count(*) = 1 THEN ' file: ' ELSE ' files: ' END || string_agg(node, ', ' ORDER BY node) || '.' AS message, 'warning' AS severity, component AS relative_path, 0::BIGINT AS line, NULL::VARCHAR AS symbol_id FROM c GROUP BY component""",
    "document_validation": f"WITH {_DIFF.replace('FROM old o FULL JOIN new n', 'FROM old o FULL JOIN (SELECT * FROM new WHERE doc_id % 5 <> 0) n').replace('o.language IS NOT DISTINCT FROM n.language AND ', '')} SELECT * FROM df WHERE action <> 'unchanged'",
    "duplicate_keys": f"WITH {_LINKS} SELECT page_id, target, count(*) AS n FROM links GROUP BY 1, 2 HAVING count(*) > 1",
    "first_seen_links": f"WITH {_LINKS} SELECT page_id, target, min(pos) AS pos FROM links GROUP BY 1, 2",
}
