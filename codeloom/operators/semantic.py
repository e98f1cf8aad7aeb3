"""Exact vector search, and identities of embedding settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from codeloom.functions.numeric import dot, norm, unit
from codeloom.operators.best import NO_SCORE, NOT_A_NUMBER, Best, in_blocks
from codeloom.operators.lexical import top_ranked
from codeloom.operators.rounds import spread, written

#: A query set up to this many vectors is sent to all tasks; a larger one is searched in blocks of so many.
QUERY_BLOCK = 2000
#: So many vectors of the corpus meet a block at a time.
TILE = 2048


@dataclass(frozen=True)
class EmbeddingFingerprint:
    provider: str
    model: str
    dimension: int
    query_instruction: str = ""
    document_instruction: str = ""
    normalisation: str = "l2"
    similarity: str = "cosine"

    def identity(self) -> str:
        return hashlib.sha256(json.dumps(list(asdict(self).values()), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def null_last(c: Column) -> list[Column]:
    """Sort keys that put null after every value."""
    return [c.isNull(), c]


def null_as_empty(c: Column, empty) -> list[Column]:
    """Sort keys that put null where the empty value stands."""
    return [F.coalesce(c, F.lit(empty))]


def _block_scores(corpus: DataFrame, block: DataFrame, key: str, vector: str, query: str) -> DataFrame:
    return corpus.select(key, unit(F.col(vector)).alias("_v")).crossJoin(F.broadcast(block)).select(query, key, dot(F.col("_v"), F.col("_q")).alias("score"))


def cosine_scores(corpus: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str) -> DataFrame:
    """query, key, score of all pairs; negative scores stay. The query set meets the corpus block by block."""
    out = None
    for block in in_blocks(queries.select(query, unit(F.col(query_vector)).alias("_q")), query, QUERY_BLOCK):
        some = _block_scores(corpus, block, key, vector, query)
        out = some if out is None else out.unionByName(some)
    return out


class _Vectors:
    """The vectors of a column at length 1, by their dimension. Null ones, and those with a null in them, have none."""

    def __init__(self, column: pa.Array):
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten()
        missing = values.is_null().to_numpy(zero_copy_only=False)
        numbers = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        none = column.is_null().to_numpy(zero_copy_only=False)
        none[np.repeat(np.arange(len(size)), size)[missing]] = True
        self.dimension = np.where(none, -1, size)
        #: Place of each vector among those of its dimension.
        self.within = np.zeros(len(size), np.int64)
        #: rows, units (a row a coordinate), the same in short numbers (a row a vector), which are not numbers.
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in np.unique(self.dimension[~none]).tolist():
            rows = np.flatnonzero(self.dimension == d)
            self.within[rows] = np.arange(len(rows))
            given = numbers[start[rows] + np.arange(d)[:, None]]
            squares = np.zeros(len(rows))
            for x in given:
                squares += x * x
            if d and not squares.all():
                raise ValueError("a vector of zeros has no direction")
            with np.errstate(invalid="ignore"):
                units = given / np.sqrt(squares)
            odd = np.isnan(units).any(axis=0)
            self.of[d] = rows, units, np.where(odd, 0, units).T.astype(np.float32), odd


def _near(asked: _Vectors, corpus: _Vectors, n: int, m: int) -> np.ndarray:
    """Scores of all pairs to within `_error`; 4 for what is no number, -4 where there is none."""
    out = None
    for d, (q, _, short, odd) in asked.of.items():
        if d in corpus.of:
            c, _, others, also = corpus.of[d]
            some = short @ others.T
            some[odd], some[:, also] = 4, 4
            if some.shape == (n, m):
                return some
            out = np.full((n, m), -4, np.float32) if out is None else out
            out[np.ix_(q, c)] = some
    return np.full((n, m), -4, np.float32) if out is None else out


def _error(vectors: _Vectors) -> float:
    """Bound of the error of a sum of products of unit vectors in numbers of 24 bits."""
    return (max(vectors.of, default=0) + 8) * 2.0**-24 * 1.01


def _exact(asked: _Vectors, corpus: _Vectors, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of pairs, the products summed in order, as `dot` does."""
    out = np.full(len(q), NO_SCORE)
    for d in asked.of.keys() & corpus.of.keys():
        pair = np.flatnonzero((asked.dimension[q] == d) & (corpus.dimension[c] == d))
        a, b = asked.within[q[pair]], corpus.within[c[pair]]
        total = np.zeros(len(pair))
        for x, y in zip(asked.of[d][1], corpus.of[d][1]):
            total += x[a] * y[b]
        out[pair] = np.where(np.isnan(total), NOT_A_NUMBER, total)
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: half up, of the decimal numbers that stand for the values."""
    out, real = x.copy(), np.isfinite(x)
    y = np.abs(x[real]) * 10.0**digits
    out[real] = np.copysign(np.floor(y + 0.5) / 10.0**digits, x[real]) + 0.0
    for k in np.flatnonzero(real)[np.abs(y - np.floor(y) - 0.5) < 1e-6]:
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _nearest(ids: pa.Array, vectors: pa.Array, k: int, digits: int | None, schema: StructType):
    """Function of batches of the corpus, in order of ties, the vectors last: the k most similar of each query in them.

    Products in short numbers leave out what can't be among them; the rest is scored in full.
    """
    asked, n = _Vectors(vectors), len(ids)
    error, half = _error(asked), 0.0 if digits is None else 0.5 * 10.0**-digits

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kept, before = Best(n, k), [[] for _ in schema.names[1:-1]], 0
        for batch in batches:
            for column, values in zip(kept, batch.columns):
                column.append(values)
            for lo in range(0, batch.num_rows, TILE):
                corpus = _Vectors(batch.column(batch.num_columns - 1).slice(lo, TILE))
                m = len(corpus.dimension)
                near = _near(asked, corpus, n, m)
                # any score is more than none
                bound = np.where(np.isneginf(best.least) & best.full, -3, best.least + half - error)
                new = np.flatnonzero(~best.full)
                if len(new) and m >= k:
                    bound[new] = np.partition(near[new], m - k, axis=1)[:, m - k] - 2 * error - 2 * half
                q, c = np.nonzero(near >= bound.astype(np.float32)[:, None] - np.float32(1e-6))
                if len(q):
                    score = _exact(asked, corpus, q, c)
                    best.add(q, before + lo + c, score if digits is None else rounded(score, digits))
            before += batch.num_rows
        if len(best.query):
            yield best.rows(ids, kept, schema)

    return search


def semantic_search(
    corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "query_vector",
    ties: list[Column] | None = None, carry: tuple[str, ...] = (), digits: int | None = None,
) -> DataFrame:
    """query, key, columns to carry along, score, rank: the k most similar, ties by key or by the columns given.

    ties: over key and the columns carried. digits: scores are rounded to so many places before they are ranked. Of several blocks
    of queries each is searched in a job of its own, so one is in memory at a time; tasks keep k rows of a query before they shuffle.
    """
    ties = ties or [F.col(key)]
    schema = StructType([StructField(query, queries.schema[query].dataType), *[corpus.schema[c] for c in (key, *carry)], StructField("score", DoubleType())])
    ordered, out = spread(corpus.select(key, *carry, vector)).sortWithinPartitions(*ties), None
    blocks = in_blocks(queries.select(query, query_vector), query, QUERY_BLOCK)
    for block in blocks:
        asked = block.toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        ids, vectors = (asked.column(c).chunk(0) for c in (query, query_vector))
        best = top_ranked(ordered.mapInArrow(_nearest(ids, vectors, k, digits, schema), schema), query, [F.desc("score"), *ties], k)
        if len(blocks) > 1:
            best, _ = written(best, "nearest")
        out = best if out is None else out.unionByName(best)
    return corpus.sparkSession.createDataFrame([], StructType([*schema.fields, StructField("rank", IntegerType())])) if out is None else out


def normalised(corpus: DataFrame, vector: str) -> DataFrame:
    return corpus.withColumn(vector, unit(F.col(vector))).withColumn("length", norm(F.col(vector)))
