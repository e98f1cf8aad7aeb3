"""Evidence, audits and records: exact fields, times, verdicts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import CREDENTIAL_ASSIGNMENT, CREDENTIAL_NAME, CREDENTIAL_VALUE
from codeloom.operators.evaluation import assert_empty, assert_unique

REVIEW_DELAY_SECONDS = 48 * 3600
AUDIT_SIZE = 12


def offset_timestamp(text: Column) -> Column:
    """An ISO 8601 time that names its offset; null for others."""
    return F.when(F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")), F.try_to_timestamp(text))


def reviewed_late_enough(created: Column, reviewed: Column) -> Column:
    return F.timestamp_diff("SECOND", created, reviewed) >= REVIEW_DELAY_SECONDS


def derive_references(drafts: DataFrame, version: str, rule: str) -> DataFrame:
    """Drafted truth as reference records with the hash of their source."""
    body = F.to_json(F.struct(*sorted(drafts.columns)), {"ignoreNullFields": "false"})
    return drafts.withColumns({"truth_version": F.lit(version), "derivation_rule_version": F.lit(rule), "source_hash": F.sha2(body, 256)})


def verdict(verdicts: Column) -> Column:
    """QUESTIONS before CANNOT_ASSESS before SUPPORTS."""
    return F.when(F.array_contains(verdicts, "QUESTIONS"), "QUESTIONS").when(F.array_contains(verdicts, "CANNOT_ASSESS"), "CANNOT_ASSESS").otherwise("SUPPORTS")


def strict_json(text: str | None) -> str | None:
    """Canonical JSON of a text; null if it isn't JSON, repeats a key, or has a number that JSON hasn't."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key repeats")
        return dict(items)

    def constant(name):
        raise ValueError(name)

    try:
        return canonical_json(json.loads(text, object_pairs_hook=pairs, parse_constant=constant))
    except (TypeError, ValueError, RecursionError):
        return None


def canonical_json(value) -> str:
    """Sorted keys, no blanks, letters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def strict_json_udf():
    @F.pandas_udf("string")
    def canonical(text: pd.Series) -> pd.Series:
        return text.map(strict_json)

    return canonical


def is_private(value, inside: str = "") -> bool:
    """Whether a JSON value has a key or text, at any depth, that looks like a credential.

    Names of graded candidates (under `metric_inputs`, of a file, chunk or symbol, with grade 0, 1 or 2) are data and not
    fields; what a symbol's name holds as JSON is looked through in turn, and one that isn't a JSON object counts as private.
    """
    if isinstance(value, list):
        return any(is_private(x) for x in value)
    if isinstance(value, str):
        return bool(_SAID.search(value))
    if not isinstance(value, dict):
        return False
    for name, item in value.items():
        graded = inside == "metric_inputs" and name.startswith(("file:", "chunk:", "symbol:")) and type(item) is int and 0 <= item <= 2
        if _SAID.search(name) or (not graded and _NAMED.search(name)):
            return True
        if graded and name.startswith("symbol:"):
            try:
                record = json.loads(name.removeprefix("symbol:"))
            except ValueError:
                return True
            if not isinstance(record, dict) or is_private(record):
                return True
        if is_private(item, name):
            return True
    return False


_NAMED = re.compile(CREDENTIAL_NAME, re.I)
_SAID = re.compile(f"{CREDENTIAL_VALUE}|(?:{CREDENTIAL_ASSIGNMENT.removeprefix('(?i)')})")


def private_record_udf():
    """is_private of JSON texts; null for what isn't JSON."""

    @F.pandas_udf("boolean")
    def private(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return is_private(json.loads(t))
            except (TypeError, ValueError, RecursionError):
                return None

        return text.map(one).astype(object)

    return private


def audit_replies(raw: DataFrame, prepared: DataFrame) -> DataFrame:
    """query_id, verdict, reviews of replies (query_id, reply) that are strict JSON and name just the prepared items (query_id, item_id); others raise."""
    parsed = raw.select("query_id", strict_json_udf()(F.col("reply")).alias("j"))
    assert_empty(parsed.filter("j is null").select("query_id"), "not strict JSON")
    each = parsed.select("query_id", F.explode(F.from_json("j", "struct<reviews:array<struct<item_id:string,verdict:string>>>", {"mode": "FAILFAST"})["reviews"]).alias("r")).select("query_id", "r.item_id", "r.verdict")
    assert_unique(each, "query_id", "item_id")
    ids = prepared.select("query_id", F.col("item_id").cast("string").alias("item_id"))
    got = each.select("query_id", "item_id")
    assert_empty(got.exceptAll(ids).unionByName(ids.exceptAll(got)), "other items than prepared")
    assert_empty(each.filter("verdict not in ('SUPPORTS', 'CANNOT_ASSESS', 'QUESTIONS')"), "unknown verdict")
    return each.groupBy("query_id").agg(verdict(F.collect_set("verdict")).alias("verdict"), F.count("*").alias("reviews"))


def validate_audit_set(queries: DataFrame, accepted: DataFrame, complete: bool = False) -> None:
    """Raises unless there are just AUDIT_SIZE different queries, accepted ones are among them, once each, and all are if complete."""
    assert_unique(queries, "query_id")
    assert_unique(accepted, "query_id")
    if queries.count() != AUDIT_SIZE:
        raise ValueError(f"an audit has {AUDIT_SIZE} queries")
    assert_empty(accepted.join(queries, "query_id", "left_anti"), "accepted but not asked")
    if complete and accepted.count() != AUDIT_SIZE:
        raise ValueError("not all are accepted")


def run_revisions(record: Column) -> Column:
    """struct(code, manifest) of a run record (map): the two names of version 2, or the one name that came before."""
    at = lambda k: F.try_element_at(record, F.lit(k))
    return F.when(at("schema_version") == "2", F.struct(at("execution_commit").alias("code"), at("manifest_commit").alias("manifest"))).otherwise(F.struct(at("commit").alias("code"), F.lit(None).cast("string").alias("manifest")))


def eligible(run: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Adds `blocked_by`: the first expected value that a run (a row of strings) doesn't have; null if it may be counted."""
    first = F.lit(None).cast("string")
    for name, value in reversed(list(expected.items())):
        first = F.when(~F.col(name).eqNullSafe(F.lit(value)), F.lit(name)).otherwise(first)
    return run.withColumn("blocked_by", first)


def allowed_fields(fields: Column, names: tuple[str, ...]) -> Column:
    """A diagnostic record (map) reduced to known fields that have a value."""
    return F.map_filter(fields, lambda k, v: k.isin(*names) & v.isNotNull())
