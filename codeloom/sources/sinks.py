"""Sinks: run artifacts, content-addressed records, CSV, workspaces, archives."""

from __future__ import annotations

import io
import json
import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run(df: DataFrame, root: str, run_id: str) -> str:
    """Writes a run's rows, once: raises if the run is there. Beside them, a table of file hashes."""
    path = f"{root.rstrip('/')}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256")).write.mode("errorifexists").json(f"{root.rstrip('/')}/checksums/run_id={run_id}")
    return path


def verify_run(spark, root: str, run_id: str) -> bool:
    """Whether a run's files are those whose hashes were written."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/run_id={run_id}").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    known = spark.read.schema("file string, sha256 string").json(f"{root}/checksums/run_id={run_id}")
    return files.exceptAll(known).isEmpty() and known.exceptAll(files).isEmpty()


def write_record(df: DataFrame, root: str, identity: str) -> str:
    """Writes under a folder named by the content's hash; raises if it is there."""
    path = f"{root.rstrip('/')}/{identity}"
    df.write.mode("errorifexists").json(path)
    return path


def metric_rows(summary: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric of a wide summary."""
    return summary.unpivot(keys, metrics, "metric", "value")


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_workspace(data: dict, path: str, fields: tuple[str, ...]) -> None:
    """The known fields as JSON, by a file that replaces the old one at once. A small file on the driver."""
    part = path + ".part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump({"version": 1, "data": {k: v for k, v in data.items() if k in fields}}, f, ensure_ascii=False)
    os.replace(part, path)


def batch_zip(results: dict[str, str], log: str, docs: str) -> bytes:
    """An archive of annotated sources, the log and all documentation; for the results of one upload, held on the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(results):
            z.writestr(path, results[path])
        z.writestr("processing.log", log)
        z.writestr("API_DOCS_ALL.md", docs)
    return out.getvalue()
