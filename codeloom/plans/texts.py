"""Queries over lines, names, predicates, parsers and records. Documents and pages stand for sources; parsers read fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunks, parsing, provenance, quality
from codeloom.sources import scan

from ._common import table


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _odd_lines(spark, d):
    """Whole texts, with a no-break space at the end of some, and wide blanks in front of others."""
    return _lines(spark, d).withColumn("text", F.expr("case doc_id % 5 when 0 then concat(text, char(160)) when 1 then concat('\\u3000\\u3000\\n\\t\\u3000x\\u3000\\u3000y\\n', text) else text end"))


def python_lint(spark, d):
    return quality.lint_python(_odd_lines(spark, d), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


def java_lint(spark, d):
    return quality.lint_java(_odd_lines(spark, d), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


def lint_display(spark, d):
    shown = quality.shown_issues(quality.lint_python(_odd_lines(spark, d), "doc_id", "text"), "doc_id", 5)
    return shown.withColumn("line_no", F.col("line_no").cast("long"))


def translation_needs(spark, d):
    return table(spark, d, "documents").select("doc_id", *[T.needs_translation(F.col("text"), lang).alias(lang) for lang in ("en", "zh", "ja", "de")])


def credential_texts(spark, d):
    return table(spark, d, "documents").filter(T.has_credential(F.col("text"))).select("doc_id")


def private_entries(spark, d):
    e = F.create_map(F.col("event_type"), F.col("props"), F.expr("case when event_id % 7 = 0 then 'api_key' else 'k' end"), F.lit("x"))
    return table(spark, d, "events").select("event_id", T.private_entry(e).alias("private"))


def output_errors(spark, d):
    t = F.expr("case conv_id % 5 when 0 then '  ' when 1 then concat('Sure, ', text) when 2 then concat(text, ' see /home/x/y') else text end")
    return table(spark, d, "conversations").select("conv_id", "turn", T.output_error(t).alias("error"))


def fence_strip(spark, d):
    t = F.expr("case conv_id % 4 when 0 then concat('```py\\n', text, '\\n```') when 1 then concat('```', text) when 2 then concat('x ```a\\n', text, '\\n```') else text end")
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(T.strip_fence(t), 256).alias("sha"))


def neutral_prompts(spark, d):
    t = F.concat(F.lit("<SOURCE_CODE>"), F.coalesce("text", F.lit("")), F.lit("</SOURCE_CODE>"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.neutralise(t).alias("text"))


def output_names(spark, d):
    path = F.expr("concat(source, '/a.b/f', doc_id, case when doc_id % 3 = 0 then '' else '.py' end)")
    return table(spark, d, "documents").select("doc_id", *[T.output_name(path, s).alias(s) for s in ("same", "suffix", "subdir")])


def python_modules(spark, d):
    path = F.expr("concat(source, '/p', doc_id, case when doc_id % 4 = 0 then '/__init__.py' else '/m.py' end)")
    return table(spark, d, "documents").select("doc_id", T.python_module(path).alias("module"))


def path_checks(spark, d):
    path = F.expr("case page_id % 6 when 0 then concat('/', page_id) when 1 then concat('a\\\\b/', page_id) when 2 then '../x' when 3 then '~/x' when 4 then '' else concat('a/./b//', page_id) end")
    t = table(spark, d, "pages").select("page_id", path.alias("p"))
    error = T.strict_path_error(F.col("p"))
    return t.select("page_id", error.alias("error"), F.when(error.isNull(), T.strict_path(F.when(error.isNull(), F.col("p")).otherwise("x"))).alias("path"), T.is_host_path(F.col("p")).alias("host_path"))


def line_spans(spark, d):
    """Offsets and text of lines 2 to 3 of each document."""
    t = table(spark, d, "documents").select("doc_id", T.normalise_lf(F.col("text")).alias("text")).filter(F.size(F.split("text", "\n")) >= 3)
    start, end = chunks.line_span(F.col("text"), F.lit(2), F.lit(3))
    return t.select("doc_id", start.alias("start_offset"), end.alias("end_offset"), F.sha2(chunks.lines_between(F.col("text"), F.lit(2), F.lit(3)), 256).alias("sha"))


#: SQL of both engines.
NAMES = ("'Get  (Value)!'", "'get-value'", "'_get value_-2'", "'__!!'", "''", "cast(null as varchar(9))", "'get-value-2'", "concat('Fn ', c_custkey % 4)", "'item'")


def name_slugs(spark, d):
    """Names of functions by nation: runs of other signs, signs at the ends, names without letters, and names that are the numbered slug of another."""
    name = f"element_at(array({', '.join(NAMES)}), cast(c_custkey % {len(NAMES)} + 1 as int))"
    t = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.expr(name).alias("name"))
    return quality.slugs(t, ["c_nationkey"], "name", "c_custkey").select("c_custkey", "slug")


def symbol_names(spark, d):
    t = table(spark, d, "nation")
    return t.select("n_nationkey", T.symbol_text(F.lit("python"), F.lower("n_name"), F.col("n_name"), F.lit("class"), F.expr("case when n_nationkey % 2 = 0 then 'x()' end"), F.expr("case when n_nationkey % 3 = 0 then n_nationkey end")).alias("symbol"))


def file_languages(spark, d):
    path = F.expr("concat('a/f', doc_id, element_at(array('.py', '.java', '.TSX', '.xyz', ''), cast(doc_id % 5 + 1 as int)))")
    t = table(spark, d, "documents").select(path.alias("relative_path"), F.length("text").alias("size_bytes"))
    return scan.scan_summary(t.withColumn("language", scan.language_of(F.col("relative_path")))).select("language", "files", F.col("bytes").cast("long").alias("bytes"))


RULES = ["build/", "*.log", "!keep.log", " # comment", "/src1/*", "deep/x*"]


def ignore_rules(spark, d):
    path = F.expr("element_at(array(concat('build/', doc_id, '.py'), concat(source, '/a.log'), concat(source, '/keep.log'), concat(source, '/deep/x', doc_id), concat(source, '/f', doc_id, '.py'), concat('x/build/', doc_id, '/keep.log')), cast(doc_id % 6 + 1 as int))")
    return scan.without_ignored(table(spark, d, "documents").select("doc_id", path.alias("relative_path")), RULES)


def batch_outcomes(spark, d):
    o = quality.batch_outcome(F.col("value") > 20, F.expr("event_id % 3"), F.expr("event_type = 'error'"))
    return table(spark, d, "events").select("event_id", o.alias("outcome"))


def log_heads(spark, d):
    return _lines(spark, d).select("doc_id", F.sha2(quality.log_head(F.col("text"), 2), 256).alias("sha"))


def translations(spark, d):
    words = {"title": {"中文": "报告", "en": "Report", "de": "Bericht"}, "none": {"en": "None"}}
    t = table(spark, d, "documents")
    return t.select("doc_id", T.lookup(words, F.expr("case doc_id % 3 when 0 then 'title' when 1 then 'none' else 'other' end"), F.col("lang")).alias("said"))


def kept_fields(spark, d):
    m = F.create_map(F.lit("event"), F.col("event_type"), F.lit("secret"), F.lit("x"), F.lit("provider"), F.expr("case when event_id % 2 = 0 then 'p' end"))
    return table(spark, d, "events").select("event_id", F.to_json(provenance.allowed_fields(m, ("event", "provider"))).alias("fields"))


def references(spark, d):
    r = provenance.derive_references(table(spark, d, "benchmark").select("item_id", "text"), "v1", "r1")
    return r.select("item_id", "truth_version", "derivation_rule_version")


def run_eligibility(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    return provenance.eligible(t, {"status": "F", "priority": "1"}).groupBy("blocked_by").agg(F.count("*").alias("n"))


PYTHON_SOURCE = '''import os
from pkg.mod import fn as g
from . import local


def plain(a, /, b, *rest, c=1, **more):
    """Doc."""
    if a and b or c:
        for x in rest:
            with x:
                pass
    return a

class Outer(Base):
    class Inner:
        def deep(self, x: int): pass
    def twice(self): pass
    def twice(self): return 1

if True:
    def hidden(): pass
'''
JAVA_SOURCE = """package com.example.app;
import java.util.List;
import static com.example.Util.*;
/** Doc { of First. */
@Deprecated
public class First {
    String s = "class Fake {";
    int foo(final int a) { return a; }
    /** About. */
    int foo(String a, List<String> b) { if (a != null) { return 1; } return 2; }
    First() throws Exception { new Runnable() { public void run() { } }; }
}
interface Second { }
"""


def _sources(spark, d):
    rows = [("p", "pkg/a.py", "python", PYTHON_SOURCE), ("p", "com/First.java", "java", JAVA_SOURCE), ("p", "bad.py", "python", "def ("), ("p", "x.md", "markdown", "# x")]
    return spark.createDataFrame(rows, "project_id string, relative_path string, language string, content string")


def parsed_symbols(spark, d):
    s = parsing.symbols(_sources(spark, d))
    return s.select("relative_path", "qualified_name", "kind", "semantic_disambiguator", F.col("fallback_line").cast("long").alias("fallback_line"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "signature", "has_doc")


def parsed_imports(spark, d):
    return parsing.imports(_sources(spark, d)).unionByName(parsing.java_packages(_sources(spark, d)).select(F.col("relative_path").alias("importer"), F.concat(F.lit("package "), "package").alias("target")))


def code_measures(spark, d):
    m = quality.measures(_sources(spark, d).filter("language = 'python'"))
    return m.select("name", "kind", *[F.col(c).cast("long").alias(c) for c in ("line", "length", "complexity", "depth", "parameters")], "marks")


def unannotated(spark, d):
    return quality.missing_annotations(_sources(spark, d).filter("language = 'python'")).select("name", F.col("line").cast("long").alias("line"), "missing")


def input_errors(spark, d):
    s = _sources(spark, d).unionByName(spark.createDataFrame([("p", "empty", "python", " "), ("p", "open.java", "java", "class A {"), ("p", "long", "java", "x" * 200_001)], "project_id string, relative_path string, language string, content string"))
    return s.select("relative_path", quality.input_error(F.col("content"), F.col("language")).alias("error"))


def code_outline(spark, d):
    return quality.outline(parsing.symbols(_sources(spark, d)))


def split_diffs(spark, d):
    """Rows of a document against itself with its second line left out and its first changed."""
    t = table(spark, d, "documents").select("doc_id", "text", F.expr("array_join(concat(array('new'), filter(split(text, '\\n'), (x, i) -> i > 1)), '\\n')").alias("after"))
    c = quality.diff_counts(F.col("rows"))
    return t.select("doc_id", "text", quality.split_diff(F.col("text"), F.col("after")).alias("rows")).select("doc_id", *[v.cast("long").alias(k) for k, v in c.items()])


QUERIES = {f.__name__: f for f in (
    python_lint, java_lint, lint_display, translation_needs, credential_texts, private_entries, output_errors, fence_strip, neutral_prompts, output_names, python_modules,
    path_checks, line_spans, name_slugs, symbol_names, file_languages, ignore_rules, batch_outcomes, log_heads, translations, kept_fields, references, run_eligibility,
    parsed_symbols, parsed_imports, code_measures, unannotated, input_errors, code_outline, split_diffs,
)}

_LN = r"""documents AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(160) WHEN 1 THEN repeat(chr(12288), 2) || chr(10) || chr(9) || chr(12288) || 'x' || repeat(chr(12288), 2) || 'y' || chr(10) || text ELSE text END AS text FROM main.documents),
raw AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
ln AS (SELECT doc_id, text, ls, unnest(ls) AS x, generate_subscripts(ls, 1) AS n FROM raw),
lx AS (SELECT *, regexp_replace(x, '^\s+', '') AS body, n >= 3 AND regexp_matches(x, '^\s*$') AND regexp_matches(ls[n - 1], '^\s*$') AND regexp_matches(ls[n - 2], '^\s*$') AS third FROM ln)"""
_PYL = _LN + r""", iss AS (SELECT doc_id, n AS line_no, 'E501' AS rule FROM lx WHERE length(x) > 100
UNION ALL SELECT doc_id, n, 'W291' FROM lx WHERE regexp_matches(x, '\S\s+$') UNION ALL SELECT doc_id, n, 'W191' FROM lx WHERE regexp_matches(x, '^\s*\t\s*\S')
UNION ALL SELECT doc_id, n, 'E221' FROM lx WHERE regexp_matches(body, '[^:\s]\s{2,}[^#\s]') AND NOT regexp_matches(body, '^[#"]')
UNION ALL SELECT doc_id, n, 'E303' FROM lx WHERE third UNION ALL SELECT doc_id, len(ls), 'W292' FROM raw WHERE NOT ends_with(text, chr(10)))"""


def _values(columns, rows):
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(columns)})"


_CONV = "CASE conv_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'Sure, ' || text WHEN 2 THEN text || ' see /home/x/y' ELSE text END"
_UNSAFE = " OR ".join("regexp_matches(t, '(?i)" + p.replace("'", "''") + "')" for p in T.UNSAFE_OUTPUT)
ORACLE = {
    "python_lint": f"WITH {_PYL} SELECT * FROM iss",
    "java_lint": f"WITH {_LN}" + r""", lb AS (SELECT *, regexp_replace(body, '\s+$', '') AS b FROM lx)
SELECT doc_id, n AS line_no, 'GJL001' AS rule FROM lb WHERE length(x) > 100 UNION ALL SELECT doc_id, n, 'GJL002' FROM lb WHERE regexp_matches(x, '\S\s+$') UNION ALL SELECT doc_id, n, 'GJL003' FROM lb WHERE regexp_matches(x, '^\s*\t\s*\S')
UNION ALL SELECT doc_id, n, 'GJL004' FROM lb WHERE regexp_matches(b, '[;,]\S') AND NOT starts_with(b, '//') UNION ALL SELECT doc_id, n, 'GJL005' FROM lb WHERE regexp_matches(b, '[)\w]\{') AND NOT regexp_matches(b, '^(//|\*|["''])')
UNION ALL SELECT doc_id, n, 'GJL006' FROM lb WHERE third UNION ALL SELECT doc_id, len(ls), 'GJL007' FROM raw WHERE NOT ends_with(text, chr(10))""",
    "lint_display": f"WITH {_PYL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, rule) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM iss) SELECT doc_id, line_no, rule, 0::BIGINT AS more FROM r WHERE k <= 5 UNION ALL SELECT doc_id, NULL, 'more', total - 5 FROM r WHERE k = 1 AND total > 5",
    "translation_needs": "WITH f AS (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), '[一-鿿]') AS c, regexp_matches(coalesce(text, ''), '[぀-ヿ]') AS k FROM documents) SELECT doc_id, t <> '' AND (c OR k) AS en, t <> '' AND (k OR NOT c) AS zh, t <> '' AND NOT k AS ja, false AS de FROM f",
    "credential_texts": "SELECT doc_id FROM documents WHERE regexp_matches(text, '" + T.CREDENTIAL_VALUE.replace("'", "''") + "') OR regexp_matches(text, '" + T.CREDENTIAL_ASSIGNMENT.replace("'", "''") + "')",
    "private_entries": "SELECT event_id, event_id % 7 = 0 AS private FROM events",
    "output_errors": f"WITH x AS (SELECT conv_id, turn, {_CONV} AS t FROM conversations) SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'EMPTY_RESPONSE' WHEN {_UNSAFE} THEN 'UNSAFE_RESPONSE' WHEN regexp_matches(t, '(?i){T.EXTRA_PROSE}') THEN 'EXTRA_PROSE' END AS error FROM x",
    "fence_strip": "SELECT conv_id, turn, CASE WHEN contains(text, '```') THEN NULL WHEN conv_id % 4 IN (0, 3) THEN sha256(trim(text)) END AS sha FROM conversations",
    "neutral_prompts": "SELECT conv_id, turn, '[SOURCE_CODE]' || replace(replace(coalesce(text, ''), '<SOURCE_CODE>', '[SOURCE_CODE]'), '</SOURCE_CODE>', '[/SOURCE_CODE]') || '[/SOURCE_CODE]' AS text FROM conversations",
    "output_names": "SELECT doc_id, source || '/a.b/f' || doc_id || e AS same, source || '/a.b/f' || doc_id || '_annotated' || e AS suffix, 'annotated/' || source || '/a.b/f' || doc_id || e AS subdir FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.py' END AS e FROM documents)",
    "python_modules": "SELECT doc_id, source || '.p' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.m' END AS module FROM documents",
    "path_checks": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'absolute' WHEN 2 THEN 'traversal' WHEN 3 THEN 'absolute' WHEN 4 THEN 'empty' END AS error, CASE page_id % 6 WHEN 1 THEN 'a/b/' || page_id WHEN 5 THEN 'a/b/' || page_id END AS path, page_id % 6 = 0 AS host_path FROM pages",
    "line_spans": "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, length(l[1]) + 1 AS start_offset, length(l[1]) + length(l[2]) + length(l[3]) + 2 AS end_offset, sha256(l[2] || chr(10) || l[3]) AS sha FROM t WHERE len(l) >= 3",
    "name_slugs": f"""WITH RECURSIVE n AS (SELECT c_custkey, c_nationkey, [{', '.join(NAMES)}][c_custkey % {len(NAMES)} + 1] AS name FROM customer),
s AS (SELECT *, lower(regexp_replace(regexp_replace(CASE WHEN coalesce(name, '') = '' THEN 'item' ELSE name END, '[^A-Za-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')) AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM n),
b AS (SELECT c_custkey, c_nationkey, k, CASE WHEN t = '' THEN 'item-unknown' ELSE t END AS base FROM s),
r AS (SELECT c_custkey, c_nationkey, k, base AS slug, [base] AS used FROM b WHERE k = 1
  UNION ALL SELECT c_custkey, c_nationkey, k, slug, list_append(used, slug) FROM (
    SELECT b.*, r.used, CASE WHEN NOT list_contains(r.used, base) THEN base ELSE base || '-' || list_filter(range(2, len(r.used) + 3), lambda i: NOT list_contains(r.used, base || '-' || i))[1] END AS slug FROM r JOIN b ON b.c_nationkey = r.c_nationkey AND b.k = r.k + 1))
SELECT c_custkey, slug FROM r""",
    "symbol_names": "SELECT n_nationkey, concat_ws(':', 'python', lower(n_name), n_name, 'class', CASE WHEN n_nationkey % 2 = 0 THEN 'x()' END, CASE WHEN n_nationkey % 3 = 0 THEN 'line:' || n_nationkey END) AS symbol FROM nation",
    "file_languages": "SELECT ['python', 'java', 'typescript', 'other', 'other'][doc_id % 5 + 1] AS language, count(*) AS files, sum(length(text))::BIGINT AS bytes FROM documents GROUP BY 1",
    "ignore_rules": "SELECT doc_id, CASE WHEN doc_id % 6 = 2 THEN source || '/keep.log' ELSE source || '/f' || doc_id || '.py' END AS relative_path FROM documents WHERE doc_id % 6 IN (2, 4) AND source <> 'src1'",
    "batch_outcomes": "SELECT event_id, CASE WHEN NOT value > 20 THEN 'FAILED' WHEN event_type = 'error' THEN 'CANCELLED_WITH_RESULTS' WHEN event_id % 3 > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS outcome FROM events",
    "log_heads": "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[1:2], chr(10))) AS sha FROM documents",
    "translations": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE lang WHEN 'de' THEN 'Bericht' WHEN 'en' THEN 'Report' ELSE '报告' END WHEN 1 THEN CASE WHEN lang = 'en' THEN 'None' ELSE 'none' END ELSE 'other' END AS said FROM documents",
    "kept_fields": """SELECT event_id, '{"event":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"provider":"p"' ELSE '' END || '}' AS fields FROM events""",
    "references": "SELECT item_id, 'v1' AS truth_version, 'r1' AS derivation_rule_version FROM benchmark",
    "run_eligibility": "SELECT CASE WHEN o_orderstatus <> 'F' THEN 'status' WHEN substr(o_orderpriority, 1, 1) <> '1' THEN 'priority' END AS blocked_by, count(*) AS n FROM orders GROUP BY 1",
    # parsers read fixtures, so these are rows written by hand
    "parsed_symbols": _values(
        ["relative_path", "qualified_name", "kind", "semantic_disambiguator", "fallback_line", "start_line", "end_line", "signature", "has_doc"],
        [
            ("pkg/a.py", "plain", "function", None, None, 6, 12, "plain(a, b, *rest, c, **more)", True),
            ("pkg/a.py", "Outer", "class", None, None, 14, 18, None, False),
            ("pkg/a.py", "Outer.Inner", "class", None, None, 15, 16, None, False),
            ("pkg/a.py", "Outer.Inner.deep", "method", None, None, 16, 16, "deep(self, x)", False),
            ("pkg/a.py", "Outer.twice", "method", None, 17, 17, 17, "twice(self)", False),
            ("pkg/a.py", "Outer.twice", "method", None, 18, 18, 18, "twice(self)", False),
            ("com/First.java", "First", "class", None, None, 5, 12, None, True),
            ("com/First.java", "First.foo", "method", "foo(int)", None, 8, 8, "foo(int)", False),
            ("com/First.java", "First.foo", "method", "foo(String,List<String>)", None, 10, 10, "foo(String,List<String>)", True),
            ("com/First.java", "First.First", "method", "First()", None, 11, 11, "First()", False),
            ("com/First.java", "First.run", "method", "run()", None, 11, 11, "run()", False),
            ("com/First.java", "Second", "class", None, None, 13, 13, None, False),
        ],
    ),
    "parsed_imports": _values(["importer", "target"], [("pkg/a.py", "os"), ("pkg/a.py", "pkg.mod.fn"), ("pkg/a.py", ".local"), ("com/First.java", "java.util.List"), ("com/First.java", "com.example.Util.*"), ("com/First.java", "package com.example.app")]),
    "code_measures": _values(
        ["name", "kind", "line", "length", "complexity", "depth", "parameters", "marks"],
        [("plain", "function", 6, 7, 6, 3, 1, "raised"), ("Outer", "class", 14, 5, 1, 0, 0, "good"), ("Inner", "class", 15, 2, 1, 0, 0, "good"), ("deep", "function", 16, 1, 1, 0, 2, "good"), ("twice", "function", 17, 1, 1, 0, 1, "good"), ("twice", "function", 18, 1, 1, 0, 1, "good"), ("hidden", "function", 21, 1, 1, 0, 0, "good")],
    ),
    "unannotated": _values(["name", "line", "missing"], [("plain", 6, "b"), ("plain", 6, "return"), ("deep", 16, "return"), ("twice", 17, "return"), ("twice", 18, "return"), ("hidden", 21, "return")]),
    "input_errors": _values(["relative_path", "error"], [("pkg/a.py", None), ("com/First.java", None), ("bad.py", "INVALID_PYTHON"), ("x.md", "UNSUPPORTED_LANGUAGE"), ("empty", "EMPTY_INPUT"), ("open.java", "INVALID_JAVA"), ("long", "INPUT_TOO_LARGE")]),
    "code_outline": _values(["relative_path", "parent", "children"], [("pkg/a.py", None, "plain, Outer"), ("pkg/a.py", "Outer", "Inner, twice, twice"), ("pkg/a.py", "Outer.Inner", "deep"), ("com/First.java", None, "First, Second"), ("com/First.java", "First", "foo, foo, First, run")]),
}

#: What the second engine's patterns have to say for all white space and word characters of Unicode.
_BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
for _name in ("python_lint", "java_lint", "lint_display"):
    for _short, _long in ((r"[^:\s]", f"[^:{_BLANK}]"), (r"[^#\s]", f"[^#{_BLANK}]"), (r"[)\w]", r"[)\p{L}\p{N}_]"), (r"\S", f"[^{_BLANK}]"), (r"\s", f"[{_BLANK}]")):
        ORACLE[_name] = ORACLE[_name].replace(_short, _long)
