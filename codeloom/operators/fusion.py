"""Fusion of lexical, semantic and graph signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.numeric import semantic_norm
from codeloom.operators.lexical import top_ranked


@dataclass(frozen=True)
class HybridConfig:
    lexical_weight: float = 1.0
    semantic_weight: float = 1.0
    graph_weight: float = 0.25
    strategy: str = "weighted"
    rrf_k: int = 60
    graph_enabled: bool = True

    def __post_init__(self):
        if min(self.lexical_weight, self.semantic_weight, self.graph_weight) < 0:
            raise ValueError("weights are at least 0")
        if not self.lexical_weight + self.semantic_weight > 0:
            raise ValueError("one branch needs a weight")
        if not self.graph_enabled and self.graph_weight:
            raise ValueError("without the graph its weight is 0")
        if self.strategy not in ("weighted", "rrf"):
            raise ValueError("strategy is weighted or rrf")


def lexical_norm(hits: DataFrame, query: str) -> DataFrame:
    """Adds score over the best score among a query's returned hits."""
    return hits.withColumn("normalised", F.col("score") / F.max("score").over(Window.partitionBy(query)))


def graph_signal(relation: Column, direction: Column, hop: Column) -> Column:
    """How much a graph step counts: containment less than import, backwards less than forwards, far less than near."""
    kind = F.when(relation == "contains", 0.75).when(relation == "imports", 1.0).otherwise(0.0)
    way = F.when(direction == "forward", 1.0).otherwise(0.8)
    return kind * way / hop


def fuse(lexical: DataFrame, semantic: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", graph: DataFrame | None = None, config: HybridConfig = HybridConfig()) -> DataFrame:
    """query, key, score, rank, and what each branch gave. graph: query, key, relation, direction, hop; it raises hits and never adds any."""
    lex = lexical_norm(lexical, query).select(query, key, F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"), F.col("normalised").alias("lexical_norm"))
    sem = semantic.select(query, key, F.col("score").alias("semantic_score"), F.col("rank").alias("semantic_rank"), semantic_norm(F.col("score")).alias("semantic_norm"))
    both = lex.join(sem, [query, key], "full_outer")
    if graph is None or not config.graph_enabled:
        both = both.withColumns({"graph_score": F.lit(0.0), "hop": F.lit(None).cast("int")})
    else:
        best = graph.groupBy(query, key).agg(F.max(graph_signal(F.col("relation"), F.col("direction"), F.col("hop"))).alias("graph_score"), F.min("hop").cast("int").alias("hop"))
        both = both.join(best, [query, key], "left").withColumn("graph_score", F.coalesce("graph_score", F.lit(0.0)))
    if config.strategy == "weighted":
        score = config.lexical_weight * F.coalesce("lexical_norm", F.lit(0.0)) + config.semantic_weight * F.coalesce("semantic_norm", F.lit(0.0)) + config.graph_weight * F.col("graph_score")
    else:
        part = lambda w, rank: F.coalesce(F.lit(w) / (config.rrf_k + rank), F.lit(0.0))
        score = part(config.lexical_weight, F.col("lexical_rank")) + part(config.semantic_weight, F.col("semantic_rank")) + F.coalesce(config.graph_weight * F.col("graph_score") / (config.rrf_k + F.col("hop")), F.lit(0.0))
    return top_ranked(both.withColumn("score", score), query, [F.desc("score"), F.col(key)], k)


def retrieve(lexical, semantic, k: int, config: HybridConfig = HybridConfig(), query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Fusion of two branches given as functions without arguments. A semantic branch that fails leaves the lexical one, marked as degraded; if only that branch has a weight, the failure is raised."""
    lex = lexical()
    try:
        sem, reason = semantic(), None
    except Exception as error:
        if not config.lexical_weight:
            raise
        sem, reason = lex.limit(0), type(error).__name__
    fused = fuse(lex, sem, k, query, key, config=config)
    return fused.withColumns({"degraded": F.lit(reason is not None), "degradation_reason": F.lit(reason).cast("string")})
