"""The experiment matrix, strategies over it, and runs with their records."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import evaluation, fusion

#: Fixed table of experiments: id, unit, method, graph signals.
MATRIX = (
    ("RQ1-FILE", "file", "bm25", None),
    ("RQ1-CHUNK", "chunk", "bm25", None),
    ("RQ1-SYMBOL", "symbol", "bm25", None),
    ("RQ2-BM25", "symbol", "bm25", None),
    ("RQ2-E5", "symbol", "semantic", None),
    ("RQ3-GRAPH-OFF", "symbol", "weighted", None),
    ("RQ3-GRAPH-ON", "symbol", "weighted", "all"),
    ("RQ3-CONTAINS-FORWARD", "symbol", "weighted", ("contains", "forward")),
    ("RQ3-CONTAINS-REVERSE", "symbol", "weighted", ("contains", "reverse")),
    ("RQ3-IMPORTS-FORWARD", "symbol", "weighted", ("imports", "forward")),
    ("RQ3-IMPORTS-REVERSE", "symbol", "weighted", ("imports", "reverse")),
    ("RQ4-LEXICAL", "symbol", "bm25", None),
    ("RQ4-EMBEDDING", "symbol", "semantic", None),
    ("RQ4-HYBRID-NO-GRAPH", "symbol", "weighted", None),
    ("RQ4-HYBRID-GRAPH", "symbol", "weighted", "all"),
    ("RRF-HYBRID-NO-GRAPH", "symbol", "rrf", None),
    ("RRF-HYBRID-GRAPH", "symbol", "rrf", "all"),
)


def matrix(spark) -> DataFrame:
    """experiment, unit, method, graph."""
    return spark.createDataFrame([(a, b, c, d if d is None or isinstance(d, str) else ":".join(d)) for a, b, c, d in MATRIX], "experiment string, unit string, method string, graph string")


@dataclass
class Branches:
    """Functions that give hits (query_id, doc_id, score, rank) by unit, semantic hits, and graph steps for allowed signals (null: all)."""

    lexical: Callable[[str], DataFrame]
    semantic: Callable[[], DataFrame]
    graph: Callable[[list | None], DataFrame]


def strategy(experiment: str, branches: Branches, k: int) -> DataFrame:
    """The hits of an experiment."""
    _, unit, method, graph = next(row for row in MATRIX if row[0] == experiment)
    if method == "bm25":
        return branches.lexical(unit).filter(F.col("rank") <= k)
    if method == "semantic":
        return branches.semantic().filter(F.col("rank") <= k)
    steps = None if graph is None else branches.graph(None if graph == "all" else [graph])
    config = fusion.HybridConfig(strategy=method, graph_weight=0.25 if steps is not None else 0.0, graph_enabled=steps is not None)
    return fusion.fuse(branches.lexical(unit), branches.semantic(), k, graph=steps, config=config)


def run(experiments: list[str], branches: Branches, queries: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """experiment, query_id, status, latency_ns and the metrics. An experiment that fails counts as zeros for all its queries. The driver goes over experiments, never over queries; the latency is a run's time shared among its queries."""
    out = None
    n = max(1, queries.count())
    for name in experiments:
        began = time.perf_counter_ns()
        try:
            measured, _ = _kept(evaluation.query_metrics(strategy(name, branches, k), truth, queries), name)
            status = "success"
        except Exception:  # kept in the denominator
            measured, status = queries.select("query_id", *[F.lit(0.0).alias(m) for m in evaluation.METRICS]), "failed"
        took = (time.perf_counter_ns() - began) // n
        rows = measured.select(F.lit(name).alias("experiment"), "query_id", F.lit(status).alias("status"), F.lit(took).alias("latency_ns"), *evaluation.METRICS)
        out = rows if out is None else out.unionByName(rows)
    return out


def _kept(df: DataFrame, name: str):
    from codeloom.operators.rounds import written

    return written(df, f"run-{name.lower()}")


def context_counters(rendered: DataFrame, relevant: DataFrame, graph_only: DataFrame, packages: DataFrame) -> DataFrame:
    """Per query: budget used, snippets, truncation, relevant ids rendered and missed, and snippets that only the graph gave. rendered, relevant, graph_only: query_id, doc_id."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.collect_set("doc_id").alias(name))
    joined = packages.select("query_id", "budget_used", "n_snippets", "truncated").join(ids(rendered, "_r"), "query_id", "left").join(ids(relevant, "_t"), "query_id", "left").join(ids(graph_only, "_g"), "query_id", "left")
    none = F.array().cast(rendered.select(F.array("doc_id")).dtypes[0][1])
    r, t, g = (F.coalesce(c, none) for c in ("_r", "_t", "_g"))
    from codeloom.operators.context import evidence_overlap

    return joined.select("query_id", "budget_used", "n_snippets", "truncated", *[v.alias(k) for k, v in evidence_overlap(r, t).items()], F.size(F.array_intersect(r, g)).alias("graph_only"), F.size(F.array_intersect(F.array_intersect(r, g), t)).alias("graph_only_relevant"))
