"""The best rows of each query, kept while blocks of scores pass by, and query sets in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Scores that are no number: NaN stands before all others, null behind them, as Spark orders them descending.
NOT_A_NUMBER, NO_SCORE = np.inf, -np.inf


def in_blocks(queries: DataFrame, query: str, most: int) -> list[DataFrame]:
    """The query set in blocks of about `most` at most."""
    n = queries.count()
    # hashing deals unevenly: twice as many blocks as the number asks for
    blocks = 1 if n <= most else -(-2 * n // most)
    return [queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) for b in range(blocks)]


class Best:
    """The k best rows of each of n queries by score, then by place. Rows come in order of their places."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: The k-th score of queries that have so many; a later row enters only above it.
        self.least = np.full(n, -np.inf)
        self.full = np.zeros(n, dtype=bool)

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        query, place, score = np.concatenate([self.query, query]), np.concatenate([self.place, place]), np.concatenate([self.score, score])
        order = np.lexsort((place, -score, query))
        q = query[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = order[rank == self.k - 1]
        self.least[query[last]], self.full[query[last]] = score[last], True
        order = order[rank < self.k]
        self.query, self.place, self.score = query[order], place[order], score[order]

    def rows(self, queries: pa.Array, columns: list[list[pa.Array]], schema: StructType) -> pa.RecordBatch:
        """query, columns and score of the rows kept; each of the columns holds the values of all places, batch by batch."""
        score = np.where(np.isposinf(self.score), np.nan, self.score)
        found = [pa.chunked_array(c).take(pa.array(self.place)).combine_chunks() for c in columns]
        return pa.RecordBatch.from_arrays([queries.take(pa.array(self.query)), *found, pa.array(score, mask=np.isneginf(self.score))], names=schema.names)
