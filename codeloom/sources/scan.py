"""Scanning source trees: files with language, size and hash; ignore rules; checks of what is read."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import decode_source
from codeloom.operators.snapshots import framed_hash

#: Fixed table of languages by file name extension.
LANGUAGES = {
    "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "css": "css", "go": "go", "h": "c", "hpp": "cpp", "html": "html", "java": "java", "js": "javascript",
    "json": "json", "jsx": "javascript", "kt": "kotlin", "md": "markdown", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "scala": "scala", "sh": "shell",
    "sql": "sql", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "typescript", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}
#: Folders that are never scanned.
DEFAULT_RULES = (".git/", "__pycache__/", ".venv/", "venv/", "node_modules/", ".pytest_cache/", "dist/", "build/")


def clean_rules(rules: list[str]) -> list[str]:
    """Trimmed rules with forward slashes, without blanks and comments."""
    out = [r.strip().replace("\\", "/") for r in rules]
    return [r for r in out if r and not r.startswith("#")]


def rule_pattern(rule: str) -> tuple[str, bool, bool] | None:
    """Regular expression over a path, whether it is for directories only, and whether it takes back; null for a rule that matches nothing."""
    back = rule.startswith("!")
    body = rule[back:]
    folders, body = body.endswith("/"), body.rstrip("/")
    anchored, body = body.startswith("/"), body.lstrip("/")
    if not body:
        return None
    glob = fnmatch.translate(body).removesuffix(r"\z").removesuffix(r"\Z")  # (?s:...)
    if anchored:
        pattern = f"^{glob}$"
    elif "/" in body:
        pattern = f"^(?:(?s:.*)/)?{glob}$"
    else:
        pattern = f"(?:^|/){fnmatch.translate(body).removesuffix(chr(92) + 'z').removesuffix(chr(92) + 'Z').replace('(?s:', '(?:').replace('.*', '[^/]*')}(?:$|/)"
    return pattern, folders, back


def ignored(path: Column, folder: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path, seen alone, leaves it out."""
    out = F.lit(False)
    for rule in clean_rules(rules):
        got = rule_pattern(rule)
        if got:
            pattern, folders, back = got
            hit = F.rlike(path, F.lit(pattern))
            out = F.when(hit & folder if folders else hit, F.lit(not back)).otherwise(out)
    return out


def without_ignored(files: DataFrame, rules: list[str], path: str = "relative_path") -> DataFrame:
    """Files that aren't left out themselves and stand under no folder that is: what stands in such a folder can't be taken back."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    return files.filter(~ignored(F.col(path), F.lit(False), rules) & ~F.exists(above, lambda p: ignored(p, F.lit(True), rules)))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("other"))


CONTENT = "relative_path string, size_bytes long, modified_ms long, content binary"


def listed(spark: SparkSession, root: str) -> list[tuple[str, str, int, int]]:
    """uri, relative path, size and time of every file under a folder, those with hidden names too: metadata only, on the driver."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    out, files = [], fs.listFiles(top, True)
    while files.hasNext():
        f = files.next()
        uri = f.getPath()
        out.append((uri.toString(), uri.toUri().getPath().removeprefix(base), f.getLen(), f.getModificationTime()))
    return out


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for frame in frames:
        for uri, rel, size, time in frame[["uri", "relative_path", "size_bytes", "modified_ms"]].itertuples(index=False, name=None):
            if uri.startswith("file:"):
                system, path = fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
            else:
                system, path = fs.FileSystem.from_uri(uri)
            try:
                with system.open_input_stream(path) as f:
                    yield pd.DataFrame([(rel, size, time, f.read())], columns=["relative_path", "size_bytes", "modified_ms", "content"])
            except OSError:  # a file that went or can't be read is skipped
                continue


def scan(spark: SparkSession, root: str, rules: list[str] = list(DEFAULT_RULES)) -> DataFrame:
    """relative_path, language, size_bytes, modified_ms, content_hash, content of the files under a folder.

    The built-in file readers leave out names that begin with `_` or `.`, such as __init__.py, so the listing is
    made first and the files that aren't ignored are read by the tasks.
    """
    paths = spark.createDataFrame(listed(spark, root), "uri string, relative_path string, size_bytes long, modified_ms long")
    read = without_ignored(paths, rules).mapInPandas(_read, CONTENT)
    return read.withColumns({"content_hash": F.sha2("content", 256), "language": language_of(F.col("relative_path"))})


def directories(files: DataFrame) -> DataFrame:
    """All folders that hold a file."""
    parts = F.split("relative_path", "/")
    return files.select(F.explode(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))).alias("relative_path")).distinct()


def scan_summary(files: DataFrame) -> DataFrame:
    """language, files, bytes."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def scan_identity(files: DataFrame) -> DataFrame:
    """One row: a digest over folders, then files with language and hash, in order."""
    rows = directories(files).select(F.lit("directory").alias("kind"), "relative_path", F.lit("").alias("language"), F.lit("").alias("content_hash"))
    return framed_hash(rows.unionByName(files.select(F.lit("file").alias("kind"), "relative_path", "language", "content_hash")), ["kind", "relative_path", "language", "content_hash"], "project-scan-v1")


def verified_sources(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """relative_path and text of the snapshot's files; raises where a file is missing or its hash differs."""
    joined = snapshot.select("relative_path", F.col("content_hash").alias("_want")).join(files.select("relative_path", "content_hash", "content"), "relative_path", "left")
    good = F.when(F.col("content_hash").eqNullSafe(F.col("_want")), decode_source(F.col("content"))).otherwise(F.raise_error(F.concat(F.lit("not as in the snapshot: "), "relative_path")).cast("string"))
    return joined.select("relative_path", good.alias("content"))


def uploads(spark: SparkSession, root: str, skip: tuple[str, ...] = DEFAULT_RULES) -> DataFrame:
    """Python and Java files under a folder, sorted by path."""
    return scan(spark, root, list(skip)).filter("language in ('python', 'java')").orderBy("relative_path")
