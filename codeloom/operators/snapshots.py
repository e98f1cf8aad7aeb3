"""Snapshots of files and symbols, their differences, and incremental index maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.evaluation import assert_empty, assert_unique


def file_states(files: DataFrame) -> DataFrame:
    """What a snapshot keeps of a file."""
    return files.select("relative_path", "language", "content_hash")


def diff(old: DataFrame, new: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """keys and action (added, removed, changed, unchanged); keys and states compare null-safely."""
    o, n = old.select(*keys, F.struct(*state).alias("s")).alias("o"), new.select(*keys, F.struct(*state).alias("s")).alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    action = F.when(F.col("o.s").isNull(), "added").when(F.col("n.s").isNull(), "removed").when(F.col("o.s").eqNullSafe(F.col("n.s")), "unchanged").otherwise("changed")
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], action.alias("action"))


def compare_snapshots(old_project: str, new_project: str, old: DataFrame, new: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    if old_project != new_project:
        raise ValueError("the snapshots are of different projects")
    return diff(old, new, keys, state)


def index_plan(changes: DataFrame) -> DataFrame:
    """What to do with each document of an index."""
    step = F.when(F.col("action") == "added", "add").when(F.col("action") == "removed", "delete").when(F.col("action") == "changed", "replace").otherwise("reuse")
    return changes.withColumn("step", step)


def validate_documents(snapshot: DataFrame, documents: DataFrame, key: str, state: str) -> None:
    """Raises unless both hold the same ids with the same hashes."""
    assert_unique(documents, key)
    assert_empty(diff(snapshot, documents, [key], [state]).filter("action <> 'unchanged'"), "documents don't fit the snapshot")


def validate_files(snapshot: DataFrame, current: DataFrame) -> None:
    """Raises unless each file of the snapshot is there with its language and hash; more files may be."""
    changes = diff(file_states(snapshot), file_states(current), ["relative_path"], ["language", "content_hash"])
    assert_empty(changes.filter("action in ('removed', 'changed')"), "a file isn't as in the snapshot")


def update_vectors(index: DataFrame, documents: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "id", state: str = "content_hash") -> DataFrame:
    """The index over new documents: vectors of unchanged ones are taken over, only the others are embedded. index: key, state, vector; embed: documents to the same columns."""
    same = index.join(documents.select(key, state), [key, state], "left_semi")
    fresh = documents.join(index.select(key, state), [key, state], "left_anti")
    return same.unionByName(embed(fresh).select(*index.columns))


def guarded(read: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], snapshot: DataFrame) -> DataFrame:
    """What `build` makes of the current files, if they are as in the snapshot before and after reading."""
    current = read()
    validate_files(snapshot, current)
    built = build(current)
    validate_files(snapshot, read())
    return built


def framed_hash(rows: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """One row: SHA-256 over a prefix and all rows in order, each value followed by a zero byte. For the identity of one project: its list of paths and hashes must fit in a row."""
    zero = F.unhex(F.lit("00"))
    framed = F.concat(*[x for c in columns for x in (F.encode(F.col(c), "UTF-8"), zero)])
    order = F.struct(*columns)
    ordered = F.sort_array(F.collect_list(F.struct(order.alias("o"), framed.alias("b"))))
    whole = F.aggregate(ordered, F.concat(F.encode(F.lit(prefix), "UTF-8"), zero), lambda s, x: F.concat(s, x["b"]))
    return rows.agg(F.sha2(whole, 256).alias("hash"))


def content_identity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count, and a digest of the rows that doesn't depend on their order; for tables of any size."""
    text = F.concat_ws("\x1f", *[F.concat(F.lit("="), F.col(c).cast("string")) for c in columns])
    h = F.sha2(text, 256)
    part = lambda k: F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)]).select("n", F.sha2(F.concat_ws(":", "n", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("hash"))


def metadata(files: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(files, "files").crossJoin(one(symbols, "symbols")).crossJoin(one(nodes, "nodes")).crossJoin(one(edges, "edges"))


def set_changes(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """added, removed and common rows of two sets."""
    return {"added": new.exceptAll(old).distinct(), "removed": old.exceptAll(new).distinct(), "common": new.intersect(old)}


def symbol_order(*columns: str, nulls: str = "last") -> list[Column]:
    """The two canonical orders of symbol keys: nulls after all values, or nulls as empty."""
    return [x for c in columns for x in ([F.col(c).isNull(), F.col(c)] if nulls == "last" else [F.coalesce(F.col(c).cast("string"), F.lit(""))])]
