"""The engine's facade: an index over documents, retrieval, and context packages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import context, fusion, lexical, semantic


@dataclass
class RetrievalService:
    """documents: key, name, relative_path, start_line, end_line, source_text; vectors: key, vector; embed: query text to vector column."""

    documents: DataFrame
    vectors: DataFrame | None = None
    embed: Callable | None = None
    key: str = "doc_id"
    config: fusion.HybridConfig = field(default_factory=fusion.HybridConfig)

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, key, score, rank for queries (query_id, query_text)."""
        docs = self.documents.select(self.key, F.concat_ws("\n", "name", "source_text").alias("text"))

        def lex():
            return lexical.bm25_search(docs, queries, k, key=self.key)

        def sem():
            if self.vectors is None or self.embed is None:
                raise RuntimeError("no embedding provider")
            asked = queries.select("query_id", self.embed(F.col("query_text")).alias("query_vector"))
            return semantic.semantic_search(self.vectors, asked, k, self.key, "vector")

        return fusion.retrieve(lex, sem, k, self.config, key=self.key)

    def context(self, queries: DataFrame, k: int, budget: int) -> DataFrame:
        """One package per query; an empty one for a blank query."""
        hits = self.hits(queries.filter(F.trim("query_text") != ""), k)
        rendered = self.documents.select(self.key, context.render(F.col("name"), F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("source_text")).alias("rendered"))
        planned = hits.join(rendered, self.key).withColumn("position", F.col("rank"))
        made = context.packages(context.pack(planned, budget), planned)
        return queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("context_text", F.lit("")).alias("context_text"), F.coalesce("budget_used", F.lit(0)).alias("budget_used"), F.coalesce("n_snippets", F.lit(0)).alias("n_snippets"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
