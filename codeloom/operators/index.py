"""Retrieval indexes kept as tables, with identities, built anew or brought up to date."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import lexical, semantic, snapshots
from codeloom.operators.provenance import canonical_json
from codeloom.operators.rounds import written

#: Ids of changed documents go to all tasks in blocks of about so many bytes.
BROADCAST = 32 << 20


@dataclass(frozen=True)
class IndexConfig:
    bm25: lexical.BM25Config = field(default_factory=lexical.BM25Config)
    tokenizer: str = "code-lexical-v1"
    embedding: semantic.EmbeddingFingerprint | None = None

    def __post_init__(self):
        if self.tokenizer != "code-lexical-v1":
            raise ValueError("unknown tokenizer")

    def identity(self) -> str:
        return hashlib.sha256(canonical_json(asdict(self)).encode()).hexdigest()


def index_identity(config: IndexConfig, snapshot: DataFrame) -> str:
    """A digest of the settings and of what is indexed (id, content_hash)."""
    content = snapshots.content_identity(snapshot, ["id", "content_hash"]).first().hash
    return hashlib.sha256(json.dumps([config.identity(), content]).encode()).hexdigest()


@dataclass
class Index:
    """Tables under a folder: documents (id, content_hash, text), postings (id, length, terms, tf: a row for each document, its terms in order), statistics, vectors (id, content_hash, vector)."""

    spark: SparkSession
    folder: str
    config: IndexConfig

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def _store(rows: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/{name}")


def _changed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """The ids whose documents (id, content_hash) aren't the same, as often each, in both tables, and the blocks they make. What has no hash counts as changed."""
    both = new.select("id", "content_hash", F.lit(1).alias("n")).unionByName(old.select("id", "content_hash", F.lit(-1).alias("n")))
    differ = both.groupBy("id", "content_hash").agg(F.sum("n").alias("n")).filter("n <> 0 or content_hash is null")
    ids, _ = written(differ.filter("id is not null").select("id").distinct(), "changed")
    size = ids.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 16)).first()[0] or 0
    return ids, max(1, -(-size // BROADCAST))


def _write(documents: DataFrame, vectors: DataFrame | None, folder: str, config: IndexConfig, old: Index | None = None) -> Index:
    """Writes the tables; of an old index the postings of unchanged documents are taken over, so only new and changed texts are cut into tokens.

    Postings stay in the row of their document: nothing is shuffled by term. Nor are texts or postings shuffled to find what changed; they are read once for each block of changed ids.
    """
    _store(documents.select("id", "content_hash", "text"), folder, "documents")
    made = Index(documents.sparkSession, folder, config)
    texts = made.table("documents")
    cut = lambda fresh: lexical.forward(lexical.document_tokens(fresh, "id", "text"), "id")
    if old is None:
        _store(cut(texts), folder, "postings")
    else:
        changed, blocks = _changed(old.table("documents"), texts)
        for b in range(blocks):
            ids, new, known = (df if blocks == 1 else df.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) for df in (changed, texts, old.table("postings")))
            # a document without id equals no other
            fresh = new.join(F.broadcast(ids), "id", "left_semi").unionByName(new.filter("id is null"))
            kept = known.filter("id is not null").join(F.broadcast(ids), "id", "left_anti")
            _store(cut(fresh).unionByName(kept), folder, "postings", "append" if b else "errorifexists")
    _store(lexical.corpus_statistics(made.table("postings")), folder, "statistics")
    if vectors is not None:
        _store(vectors, folder, "vectors")
    return made


def build(documents: DataFrame, folder: str, config: IndexConfig, embed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """A new index in an empty folder. embed: documents to id, content_hash, vector."""
    return _write(documents, embed(documents) if embed else None, folder, config)


def update(old: Index, documents: DataFrame, folder: str, config: IndexConfig, embed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """An index over new documents in another folder; the old one stays. Only new and changed documents are cut into tokens and embedded. Other settings raise."""
    if config.identity() != old.config.identity():
        raise ValueError("the settings changed: build a new index")
    vectors = snapshots.update_vectors(old.table("vectors"), documents, embed) if embed else None
    return _write(documents, vectors, folder, config, old)


def search(index: Index, queries: DataFrame, k: int, query: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """query, id, score, rank by BM25 over the stored postings, as `lexical.bm25_search` over the texts: asked terms are looked up where a document's postings are, and nothing but the best rows moves."""
    if k < 1:
        raise ValueError("k is at least 1")
    terms, asked = lexical.asked_terms(queries, query, query_text)
    found, _ = written(lexical.looked_up(index.table("postings"), "id", asked), "counts")
    return lexical.search_counted(found, index.table("statistics"), terms, asked, k, "id", query, index.config.bm25)
