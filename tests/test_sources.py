import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators import parsing, provenance, quality
from codeloom.sources import readers, scan, sinks


def tree(tmp_path):
    files = {".gitignore": "x", "build/ignored.py": "a", "generated/ignored.java": "a", "__pycache__/ignored.pyc": "a", "debug.log": "a", "keep.log": "a", "main.py": "print(1)\r\n", "pkg/__init__.py": "", "sub/A.java": "class A {}"}
    for name, text in files.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return str(tmp_path / "tree")


def test_scan(spark, tmp_path):
    rules = ["build/", "*.log", "!keep.log", "generated/", "__pycache__/"]
    files = scan.scan(spark, tree(tmp_path), rules)
    assert sorted(r.relative_path for r in files.select("relative_path").collect()) == [".gitignore", "keep.log", "main.py", "pkg/__init__.py", "sub/A.java"]
    langs = {r.relative_path: (r.language, r.size_bytes) for r in files.collect()}
    assert langs["main.py"] == ("python", 10) and langs["sub/A.java"][0] == "java" and langs["keep.log"][0] == "other"
    assert sorted(r.relative_path for r in scan.directories(files).collect()) == ["pkg", "sub"]
    one = scan.scan_identity(files).first().hash
    assert len(one) == 64 and one == scan.scan_identity(files.repartition(3)).first().hash
    snapshot = files.select("relative_path", "content_hash")
    assert {r.content for r in scan.verified_sources(files, snapshot).filter("relative_path = 'main.py'").collect()} == {"print(1)\n"}
    with pytest.raises(Exception):
        scan.verified_sources(files, snapshot.withColumn("content_hash", F.lit("x"))).collect()
    assert [r.relative_path for r in scan.uploads(spark, tree(tmp_path)).collect()] == ["generated/ignored.java", "main.py", "pkg/__init__.py", "sub/A.java"]


@pytest.mark.parametrize("rule, path, folder, hit", [
    ("*.py", "a/b.py", False, True), ("/*.py", "a.py", False, True), ("a/*.py", "x/a/b.py", False, True), ("a/*.py", "xa/b.py", False, False), ("b", "a/b/c", False, True),
    ("b/", "a/b", True, True), ("b/", "a/b", False, False), ("[ab].py", "x/a.py", False, True), ("?.py", "ab.py", False, False), ("/", "a", True, False),
])
def test_rules(spark, rule, path, folder, hit):
    assert spark.range(1).select(scan.ignored(F.lit(path), F.lit(folder), [rule]).alias("x")).first().x is hit


def test_zip(spark):
    def packed(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in members.items():
                z.writestr(name, text)
        return bytearray(out.getvalue())

    rows = [("good", packed(**{"a/b.py": "x", "c.java": "y"})), ("up", packed(**{"../b.py": "x"})), ("bomb", packed(**{"b": "0" * 200_000})), ("bad", bytearray(b"nope"))]
    got = readers.read_zip(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted((r.archive, r.relative_path, r.error) for r in got) == sorted([("good", "a/b.py", None), ("good", "c.java", None), ("up", None, "UNSAFE_PATH"), ("bomb", None, "RATIO"), ("bad", None, "NOT_AN_ARCHIVE")], key=str) or {(r.archive, r.relative_path, r.error) for r in got} == {("good", "a/b.py", None), ("good", "c.java", None), ("up", None, "UNSAFE_PATH"), ("bomb", None, "RATIO"), ("bad", None, "NOT_AN_ARCHIVE")}
    with zipfile.ZipFile(io.BytesIO(sinks.batch_zip({"a.py": "1"}, "log", "docs"))) as z:
        assert sorted(z.namelist()) == ["API_DOCS_ALL.md", "a.py", "processing.log"]


def test_json(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    path = tmp_path / "x.jsonl"
    path.write_text('{"id":"b","n":1}\n{"id":"a","n":2}\n')
    assert [r.id for r in readers.read_dataset(spark, str(path), schema, "id").collect()] == ["a", "b"]
    for bad in ('{"id":"b","n":1}\n\n{"id":"a","n":2}\n', '{"id":"b"}\n', '{"id":"b","n":1}\n{"id":"b","n":1}\n', '{"id":"b","n":1,"m":2}\n'):
        path.write_text(bad)
        spark.catalog.refreshByPath(str(path))
        with pytest.raises(Exception):
            readers.read_dataset(spark, str(path), schema, "id").collect()


def test_workspace(spark, tmp_path):
    path = str(tmp_path / "w.json")
    sinks.save_workspace({"language": "python", "secret": "x"}, path, readers.WORKSPACE_FIELDS)
    assert readers.load_workspace(spark, path).first().data == {"language": "python"}
    (tmp_path / "v.json").write_text(json.dumps({"version": 2, "data": {}}))
    with pytest.raises(ValueError):
        readers.load_workspace(spark, str(tmp_path / "v.json"))


def test_run_artifacts(spark, tmp_path):
    df = spark.range(10)
    sinks.write_run(df, str(tmp_path), "r1")
    assert sinks.verify_run(spark, str(tmp_path), "r1")
    with pytest.raises(Exception):
        sinks.write_run(df, str(tmp_path), "r1")


def test_sidecars(spark):
    import hashlib

    good = hashlib.sha256(b"x").hexdigest().encode()
    rows = [("a", bytearray(b"x")), ("a.sha256", bytearray(good)), ("b", bytearray(b"y"))]
    df = spark.createDataFrame(rows, "relative_path string, content binary")
    assert [r.relative_path for r in readers.sidecar_verified(df).collect()] == ["a"]
    with pytest.raises(Exception):
        readers.sidecar_verified(df.withColumn("content", F.when(F.col("relative_path") == "a", F.encode(F.lit("z"), "UTF-8")).otherwise(F.col("content")))).collect()


def test_strict_json():
    assert provenance.strict_json('{"b":1,"a":"é"}') == '{"a":"é","b":1}'
    for bad in ('{"a":1,"a":2}', "NaN", "{", None):
        assert provenance.strict_json(bad) is None


def test_audit(spark):
    prepared = spark.createDataFrame([("q", "1"), ("q", "2")], "query_id string, item_id string")
    reply = json.dumps({"reviews": [{"item_id": "1", "verdict": "SUPPORTS"}, {"item_id": "2", "verdict": "QUESTIONS"}]})
    raw = spark.createDataFrame([("q", reply)], "query_id string, reply string")
    assert provenance.audit_replies(raw, prepared).first().verdict == "QUESTIONS"
    with pytest.raises(ValueError):
        provenance.audit_replies(raw, prepared.limit(1))


def test_docstrings():
    source = "class A:\n    def f(self):\n        return 1\n\ndef g(): return 2\n\ndef h():\n    '''old'''\n    pass\n"
    out = quality.insert_docstring(source, 7, 'new "quoted"')
    assert "old" not in out and "new" in out
    out = quality.insert_docstring(out, 5, "About g.\nMore.")
    out = quality.insert_docstring(out, 2, "About f.")
    import ast

    names = {n.name: ast.get_docstring(n) for n in ast.walk(ast.parse(out)) if isinstance(n, ast.FunctionDef)}
    assert names == {"f": "About f.", "g": "About g.\nMore.", "h": 'new "quoted"'}
    java = "class A {\n    /** old */\n    @X\n    int f() { return 1; }\n}\n"
    out = quality.insert_javadoc(java, 4, "New */ text")
    assert "old" not in out and out.count("/**") == 1 and parsing.java_items(out)[1].documented


def test_diff_rows():
    rows = quality.split_rows("a\nb\nc", "a\nx\nc\nd")
    assert rows == [("equal", 1, "a", 1, "a"), ("replace", 2, "b", 2, "x"), ("equal", 3, "c", 3, "c"), ("insert", None, None, 4, "d")]


def test_overloads():
    items = parsing.file_symbols("p", "A.java", "java", "class First {\n int foo(int a) { return 1; }\n int foo(final String[] b, int... c) { return 2; }\n}\n")
    assert [r[3:8:3] for r in items][1:] != [] and [r[6] for r in items] == [None, "foo(int)", "foo(String[],int...)"]
