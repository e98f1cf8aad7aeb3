"""Embedding providers and token diagnostics as Arrow functions with a model per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed prefixes of asymmetric models.
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


@dataclass(frozen=True)
class Provider:
    """load: makes, in the worker, a function from a list of texts to a list of vectors; called once per task."""

    load: Callable[[], Callable[[list[str]], list[list[float]]]]
    dimension: int
    batch: int = 64

    def _udf(self, prefix: str):
        load, size, dimension = self.load, self.batch, self.dimension

        @F.pandas_udf("array<double>")
        def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for part in texts:
                given = [t if t.startswith(prefix) else prefix + t for t in part.fillna("")]
                vectors = [v for k in range(0, len(given), size) for v in model(given[k : k + size])]
                if any(len(v) != dimension for v in vectors):
                    raise ValueError(f"vectors must have {dimension} numbers")
                yield pd.Series(vectors)

        return embed

    def query(self, text: Column) -> Column:
        return self._udf(QUERY_PREFIX)(text)

    def document(self, text: Column) -> Column:
        return self._udf(PASSAGE_PREFIX)(text)


def token_diagnostics(text: Column, load: Callable[[], Callable[[str], list]], special: int = 2, limit: int = 512) -> Column:
    """struct(raw, special, total, truncated): tokens of a text by a tokenizer loaded once per task, and whether they exceed a model's limit."""

    @F.pandas_udf("struct<raw:int,special:int,total:int,truncated:boolean>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenize = load()
        for part in texts:
            raw = [len(tokenize(t)) for t in part.fillna("")]
            yield pd.DataFrame({"raw": raw, "special": special, "total": [n + special for n in raw], "truncated": [n + special > limit for n in raw]})

    return counted(text)
