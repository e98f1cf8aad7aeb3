"""Matches of a pattern with their places, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces_and_matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The text between the leftmost matches that don't overlap, one more than there are matches; and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


#: Matches that are summed at a time.
_BLOCK = 256


def running_sums(values: Column) -> Column:
    """array<long>: before each value, the sum of those before it. Blocks of values are summed first, then the blocks."""
    n = F.size(values)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    scan = lambda xs: F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).cast("long").alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda k: scan(F.slice(values, k * _BLOCK + 1, F.lit(_BLOCK))))
    # scanned once: the lambda's variable keeps the blocks
    whole = F.transform(F.array(blocks), lambda b: F.flatten(F.zip_with(b, scan(F.transform(b, lambda x: x["sum"]))["out"], lambda x, base: F.transform(x["out"], lambda v: v + base))))
    return F.when(n > 0, whole[0]).otherwise(F.array().cast("array<bigint>"))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> in code points, end exclusive. The pattern never matches the empty text."""
    pieces, matches = pieces_and_matches(text, pattern)
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    # texts without a match, nearly all, are not split
    between = F.slice(pieces, 1, F.size(matches))
    both = F.zip_with(between, matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("match")))
    placed = lambda b: F.zip_with(b, running_sums(F.transform(b, lambda x: x["gap"] + x["size"])), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["match"].alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(F.array(both), placed)[0]).otherwise(F.array().cast(kind))
