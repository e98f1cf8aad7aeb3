"""Vectors, prices, percentiles and other arithmetic."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def vector_error(v: Column, dimension: int) -> Column:
    """DIMENSION, NOT_FINITE, ZERO or null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNull() | (F.size(v) != dimension), "DIMENSION").when(~finite, "NOT_FINITE").when(F.forall(v, lambda x: x == 0), "ZERO")


def fake_embedding(text: Column, dimension: int, seed: str = "") -> Column:
    """A deterministic vector: 8-byte integers of SHA-256 over text and counter, as numbers from -1 to 1."""
    def value(i: Column) -> Column:
        counter = F.unhex(F.lpad(F.hex(F.floor(i / 4).cast("long")), 16, "0"))
        digest = F.sha2(F.concat(F.encode(F.concat(F.lit(seed), text), "UTF-8"), counter), 256)
        return F.conv(F.substring(digest, (i % 4).cast("int") * 16 + 1, F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**63 - 1

    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value)


def semantic_norm(cosine: Column) -> Column:
    """Cosine from -1..1 to 0..1."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)) + 1) / 2


def nearest_rank(values: Column, share: float) -> Column:
    """Nearest-rank percentile of a sorted array; 0 if it is empty."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.least(n, F.ceil(n * share).cast("int")))
    return F.when(n > 0, F.element_at(values, at)).otherwise(F.lit(0))


def token_price(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Credits for tokens at rates per 1000, exact and rounded up; for products of up to 38 digits."""
    total = tokens_in.cast("decimal(18,0)") * rate_in.cast("decimal(18,9)") + tokens_out.cast("decimal(18,0)") * rate_out.cast("decimal(18,9)")
    return F.ceil(total / F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")


def exact_price(tokens_in: str, tokens_out: str, rate_in: str, rate_out: str) -> str:
    """The same for numbers of any length."""
    with localcontext() as c:
        c.prec = 10 + 2 * sum(len(x) for x in (tokens_in, tokens_out, rate_in, rate_out))
        total = Decimal(tokens_in) * Decimal(rate_in) + Decimal(tokens_out) * Decimal(rate_out)
        return str((total / 1000).to_integral_value(rounding=ROUND_CEILING))


def exact_price_udf():
    @F.pandas_udf("string")
    def price(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([exact_price(*map(str, x)) for x in zip(a, b, c, d)])

    return price


def canonical_decimal(text: Column) -> Column:
    """Plain decimal text without needless zeros."""
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), r"^(-?)0+(?=[0-9])", "$1")
    return F.when(whole == "-0", "0").otherwise(whole)


def estimate_cost(items: Column, tokens_each: int, price_in: float, price_out: float):
    """tokens in all, in, out, and cost for a number of items; 43 % of the tokens count as input."""
    total = items * tokens_each
    tokens_in, tokens_out = F.floor(total * 0.43).cast("long"), F.floor(total * 0.57).cast("long")
    return total.cast("long"), tokens_in, tokens_out, F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 4)
