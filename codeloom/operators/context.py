"""Context packing under a character budget, and its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n"


def render(name: Column, path: Column, start: Column, end: Column, source: Column) -> Column:
    """A snippet: a head line with name, path and lines, then the source."""
    return F.concat(F.lit("[symbol] "), name, F.lit(" ("), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")\n"), source)


def plan_order(hits: DataFrame, graph: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """query, key, rank, position: each hit followed by the documents that the graph reached from it, then those reached from elsewhere; a document appears once, where it comes first. graph: query, seed, key, hop."""
    own = hits.select(query, key, "rank", F.col("rank").alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("hop"))
    reached = graph.join(hits.select(query, F.col(key)), [query, key], "left_anti")
    seeds = hits.select(query, F.col(key).alias("seed"), F.col("rank").alias("major"))
    late = reached.join(seeds, [query, "seed"], "left").select(query, key, F.lit(None).cast("int").alias("rank"), F.coalesce("major", F.lit(2**31 - 1)).alias("major"), F.lit(1).alias("minor"), "hop")
    order = ["major", "minor", "hop", key]
    first = own.unionByName(late).withColumn("n", F.row_number().over(Window.partitionBy(query, key).orderBy(*order))).filter("n = 1")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(*order))).select(query, key, "rank", "position")


def pack(planned: DataFrame, budget: int, query: str = "query_id", text: str = "rendered") -> DataFrame:
    """The snippets that fit, with `snippet`, `truncated` and `offset`: the first that doesn't fit is cut, and nothing follows it. Lengths are code points; a separator stands between snippets."""
    if budget < 1:
        raise ValueError("the budget is at least 1")
    order = Window.partitionBy(query).orderBy("position")
    gap = F.when(F.col("position") > F.first("position").over(order), len(SEPARATOR)).otherwise(0)
    with_size = planned.withColumn("_gap", gap).withColumn("_size", F.length(text) + F.col("_gap"))
    placed = with_size.withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("offset", F.col("_end") - F.length(text))
    kept = placed.filter(F.col("offset") < budget)
    room = F.lit(budget) - F.col("offset")
    return kept.withColumns({"truncated": F.length(text) > room, "snippet": F.col(text).substr(F.lit(1), room.cast("int"))}).drop("_gap", "_size", "_end")


def packages(packed: DataFrame, planned: DataFrame, query: str = "query_id") -> DataFrame:
    """One row per query: text, its length, snippets, and whether anything was cut or left out."""
    joined = packed.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "snippet"))), lambda x: x["snippet"]).alias("snippets"), F.bool_or("truncated").alias("cut"))
    wanted = planned.groupBy(query).agg(F.count("*").alias("planned"))
    text = F.array_join("snippets", SEPARATOR)
    return wanted.join(joined, query, "left").select(query, F.coalesce(text, F.lit("")).alias("context_text"), F.coalesce(F.length(text), F.lit(0)).alias("budget_used"), F.coalesce(F.size("snippets"), F.lit(0)).alias("n_snippets"), (F.coalesce("cut", F.lit(False)) | (F.coalesce(F.size("snippets"), F.lit(0)) < F.col("planned"))).alias("truncated"))


def diagnostics(package: DataFrame, budget: int) -> DataFrame:
    """Totals over queries: budget used, snippets, packages that were cut."""
    return package.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.sum("budget_used"), F.lit(0)).cast("long").alias("budget_used"),
        (F.count("*") * budget).alias("budget_total"),
        F.coalesce(F.sum("n_snippets"), F.lit(0)).cast("long").alias("snippets"),
        F.count_if("truncated").alias("truncated_packages"),
        F.round(F.coalesce(F.try_divide(F.count_if("truncated"), F.sum("n_snippets")), F.lit(0.0)), 6).alias("snippet_truncation_rate"),
    )


def evidence_overlap(rendered: Column, relevant: Column) -> dict[str, Column]:
    """Sizes of what was and wasn't rendered of the relevant ids (arrays)."""
    return {
        "rendered_relevant": F.size(F.array_intersect(rendered, relevant)),
        "missing_relevant": F.size(F.array_except(relevant, rendered)),
        "rendered_irrelevant": F.size(F.array_except(rendered, relevant)),
    }
