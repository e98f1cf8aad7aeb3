"""Documents for baselines: whole files, chunks of fixed stride, symbols by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import chunk_identity, file_identity, normalise_lf
from codeloom.operators.rounds import spread

SIZE, STRIDE = 1200, 1000


def file_documents(files: DataFrame, path: str, text: str) -> DataFrame:
    """The input with `identity` and `document`: path, line break, text with LF line ends. Empty files stay."""
    return files.select("*", file_identity(F.col(path)).alias("identity"), F.concat_ws("\n", F.col(path), normalise_lf(F.coalesce(F.col(text), F.lit("")))).alias("document"))


def chunk_documents(files: DataFrame, path: str, text: str, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """One row per chunk of `size` code points every `stride`, to the end of the text, without the whole text; empty files have none."""
    body = normalise_lf(F.col(text))
    starts = spread(files).withColumn("_body", body).filter(F.length("_body") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.length("_body").cast("long") - 1, F.lit(stride).cast("long"))).alias("start_offset"))
    end = F.least(F.col("start_offset") + size, F.length("_body").cast("long"))
    return starts.withColumn("end_offset", end).select(
        *[c for c in files.columns if c != text],
        "start_offset",
        "end_offset",
        chunk_identity(F.col(path), F.col("start_offset"), F.col("end_offset")).alias("identity"),
        F.concat(F.col(path), F.lit("\n"), F.col("_body").substr((F.col("start_offset") + 1).cast("int"), F.lit(size))).alias("document"),
    )


def line_span(text: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Code point offsets [start, end) of lines first to last (from 1) of a text."""
    lines = F.split(text, "\n", -1)
    length = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + F.length(x) + 1)
    start = length(F.slice(lines, 1, F.greatest(first - 1, F.lit(0))))
    return start, start + length(F.slice(lines, first, last - first + 1)) - 1


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1) of a text with LF line ends."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n")


def line_symbols(files: DataFrame, path: str, text: str) -> DataFrame:
    """Every line as a symbol: path, line, identity, offsets."""
    lines = F.split(normalise_lf(F.col(text)), "\n", -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))
    spans = F.aggregate(lines, start, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), (a["at"] + F.length(x)).alias("e")))).alias("out")), lambda a: a["out"])
    each = files.select(F.col(path).alias("path"), F.posexplode(spans).alias("pos", "span"))
    return each.select("path", (F.col("pos") + 1).alias("line"), F.concat_ws(":", F.lit("symbol"), "path", (F.col("pos") + 1).cast("string")).alias("identity"), F.col("span.s").alias("start_offset"), F.col("span.e").alias("end_offset"))


def symbol_documents(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Symbols with the text of their lines; raises where the text isn't what the symbol's hash says, or the file is missing. symbols: project_id, relative_path, qualified_name, start_line, end_line, content_hash; sources: project_id, relative_path, content."""
    joined = symbols.join(sources.select("project_id", "relative_path", "content"), ["project_id", "relative_path"], "left")
    text = lines_between(normalise_lf(F.col("content")), F.col("start_line"), F.col("end_line"))
    checked = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no source for "), "qualified_name")).cast("string")).when(F.sha2(text, 256) != F.col("content_hash"), F.raise_error(F.concat(F.lit("changed source of "), "qualified_name")).cast("string")).otherwise(text)
    return joined.withColumns({"source_text": checked, "documentation_text": F.lit(None).cast("string")}).drop("content")
