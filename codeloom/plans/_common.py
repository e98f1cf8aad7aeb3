"""What the query modules share: tables, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def sql_tokens(source: str, key: str, text: str) -> str:
    """SELECT of key and token, one row per token."""
    word = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
    op = r"==|!=|<=|>=|->|//|\*\*|&&|\|\||<<|>>|[+\-*/%=<>!&|^~]"
    cut = "w"
    for a, b in (("([a-z0-9])([A-Z])", "g"), ("([A-Z])([A-Z][a-z])", "g"), ("([A-Za-z])([0-9])", "g"), ("([0-9])([A-Za-z])", "g")):
        cut = rf"regexp_replace({cut}, '{a}', '\1_\2', '{b}')"
    return f"""
SELECT {key}, {sql_fold("w")} AS token FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{word}')) AS w FROM {source})
UNION ALL
SELECT {key}, {sql_fold("p")} AS token FROM (
  SELECT {key}, w, unnest(string_split({cut}, '_')) AS p FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{word}')) AS w FROM {source})
) WHERE p <> '' AND {sql_fold("p")} <> {sql_fold("w")}
UNION ALL
SELECT {key}, unnest(regexp_extract_all({text}, '{op}')) AS token FROM {source}"""
