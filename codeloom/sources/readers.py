"""JSON, JSONL, workspace, frozen blobs and ZIP readers."""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.evaluation import assert_empty, assert_unique

#: Fixed limits of archives: members, bytes in all, how much larger than packed.
ZIP_MEMBERS, ZIP_BYTES, ZIP_RATIO = 1000, 100 << 20, 100


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = True) -> DataFrame:
    """JSON records of a fixed schema; raises on other ones, and on blank lines of JSONL."""
    if lines:
        assert_empty(spark.read.text(path).filter(F.trim("value") == ""), "blank line")
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def exact_fields(spark: SparkSession, path: str, fields: set[str]) -> None:
    """Raises unless every JSONL record has just these fields."""
    keys = spark.read.text(path).select(F.json_object_keys("value").alias("k"))
    want = F.array(*map(F.lit, sorted(fields)))
    assert_empty(keys.filter(F.col("k").isNull() | (F.array_sort("k") != want)), "fields differ")


def read_dataset(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Records with just the fields of a schema and unique keys, sorted by key."""
    exact_fields(spark, path, set(schema.fieldNames()))
    rows = read_json(spark, path, schema)
    assert_unique(rows, key)
    return rows.orderBy(key)


WORKSPACE_FIELDS = ("source_code", "language", "comment_lang", "annotated_code", "docs", "log", "naming", "saved_at")


def load_workspace(spark: SparkSession, path: str) -> DataFrame:
    """The known fields of a workspace of version 1; raises for other versions."""
    schema = "version int, data map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    assert_empty(rows.filter(~F.coalesce(F.col("version") == 1, F.lit(False))), "workspace version")
    return rows.select(F.map_filter("data", lambda k, v: k.isin(*WORKSPACE_FIELDS)).alias("data"))


def frozen_blobs(blobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Blobs (project_id, relative_path, content) if paths and hashes are just those of the manifest (project_id, relative_path, content_hash)."""
    key = ["project_id", "relative_path"]
    hashed = blobs.withColumn("_h", F.sha2("content", 256))
    both = hashed.join(manifest.select(*key, F.col("content_hash").alias("_m")), key, "full_outer")
    assert_empty(both.filter(~F.col("_h").eqNullSafe(F.col("_m"))).select(*key), "not as in the manifest")
    return blobs


def sidecar_verified(files: DataFrame) -> DataFrame:
    """Files (relative_path, content) that have a .sha256 file beside them which names their hash; raises where it differs."""
    side = files.filter(F.endswith("relative_path", F.lit(".sha256"))).select(F.regexp_replace("relative_path", r"\.sha256$", "").alias("relative_path"), F.regexp_extract(F.decode("content", "UTF-8"), "^([0-9a-f]{64})", 1).alias("_h"))
    good = F.when(F.sha2("content", 256) == F.col("_h"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("hash differs: "), "relative_path")).cast("binary"))
    return files.join(side, "relative_path").select("relative_path", good.alias("content"))


ENTRIES = "archive string, relative_path string, content binary, error string"


def zip_error(archive: zipfile.ZipFile) -> str | None:
    """Why an archive isn't unpacked."""
    members = archive.infolist()
    if len(members) > ZIP_MEMBERS:
        return "TOO_MANY_MEMBERS"
    if sum(m.file_size for m in members) > ZIP_BYTES:
        return "TOO_LARGE"
    for m in members:
        name = m.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/") or name[1:2] == ":":
            return "UNSAFE_PATH"
        if stat.S_ISLNK(m.external_attr >> 16):
            return "SYMLINK"
        if m.file_size > ZIP_RATIO * max(1, m.compress_size):
            return "RATIO"
    return None


def read_zip(archives: DataFrame) -> DataFrame:
    """Members of archives (path, content); an archive beyond the limits gives one row with an error and none of its members."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame[["path", "content"]].itertuples(index=False, name=None):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        error = zip_error(z)
                        out = [(path, None, None, error)] if error else [(path, m.filename, z.read(m), None) for m in z.infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    out = [(path, None, None, "NOT_AN_ARCHIVE")]
                yield pd.DataFrame(out, columns=["archive", "relative_path", "content", "error"])

    return archives.select("path", "content").mapInPandas(rows, ENTRIES)
