"""Graded relevance: evidence mapping, metrics, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("recall_1", "recall_5", "recall_10", "mrr", "ndcg_5", "precision_5", "hit_5")


def first_seen(rows: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """One row of each key within a group: the first by an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group, key).orderBy(order))).filter("_n = 1").drop("_n")


def ranked_hits(hits: DataFrame, relevance: DataFrame, k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Hits without repeats, ranked anew from 1 to k, with their grade (0 if none)."""
    once = first_seen(hits, [query], key, "rank")
    rank = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    return once.select(query, key, rank.alias("rank")).filter(F.col("rank") <= k).join(relevance.select(query, key, "grade"), [query, key], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def query_metrics(hits: DataFrame, relevance: DataFrame, queries: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The seven metrics of each query. Queries without hits count as zeros; queries without relevant keys raise."""
    ranked = ranked_hits(hits, relevance, 10, query, key)
    gain = lambda grade, rank: (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)
    positive = F.col("grade") > 0
    within = lambda k: F.sum(F.when(positive & (F.col("rank") <= k), 1).otherwise(0))
    got = ranked.groupBy(query).agg(
        *[within(k).alias(f"_in{k}") for k in (1, 5, 10)],
        F.min(F.when(positive, F.col("rank"))).alias("_first"),
        F.sum(F.when(F.col("rank") <= 5, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("_dcg"),
    )
    best = Window.partitionBy(query).orderBy(F.desc("grade"))
    ideal = relevance.filter("grade > 0").withColumn("r", F.row_number().over(best)).groupBy(query).agg(F.count("*").alias("_relevant"), F.sum(F.when(F.col("r") <= 5, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("_ideal"))
    rows = queries.select(query).join(ideal, query, "left").join(got, query, "left")
    relevant = F.when(F.col("_relevant").isNull(), F.raise_error(F.lit("a query has nothing relevant")).cast("long")).otherwise(F.col("_relevant"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return rows.select(
        query,
        *[zero(F.col(f"_in{k}") / relevant).alias(f"recall_{k}") for k in (1, 5, 10)],
        zero(1.0 / F.col("_first")).alias("mrr"),
        zero(F.col("_dcg") / F.col("_ideal")).alias("ndcg_5"),
        zero(F.col("_in5") / 5.0).alias("precision_5"),
        zero(F.when(F.col("_in5") > 0, 1.0)).alias("hit_5"),
    )


def summary(metrics: DataFrame, strata: tuple[str, ...] = (), latency: str | None = None) -> DataFrame:
    """Means over all queries and over each value of each stratum, by grouping sets."""
    aggregates = [F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS]]
    if latency:
        aggregates += [F.floor(F.percentile(latency, 0.5)).cast("long").alias("latency_median"), F.expr(f"percentile_disc(0.95) within group (order by {latency})").cast("long").alias("latency_p95")]
    if not strata:
        return metrics.agg(*aggregates)
    sets = [[F.col(s)] for s in strata] + [[]]
    kind = F.lit("overall")
    for s in strata:
        kind = F.when(F.grouping(s) == 0, s).otherwise(kind)
    return metrics.groupingSets(sets, *[F.col(s) for s in strata]).agg(kind.alias("stratum"), *aggregates).withColumn("value", F.coalesce(*[F.col(s).cast("string") for s in strata])).drop(*strata)


def run_status(status: Column) -> Column:
    """Of many: invalid before failed before success."""
    return F.element_at(F.array(F.lit("success"), F.lit("failed"), F.lit("invalid")), F.max(F.when(status == "invalid", 3).when(status == "failed", 2).otherwise(1)))


def evidence_spans(evidence: DataFrame, ranges: DataFrame) -> DataFrame:
    """Evidence with its span: given offsets, else those of its symbol, else null."""
    known = ranges.select("symbol_id", F.col("start_offset").alias("_s"), F.col("end_offset").alias("_e"))
    return evidence.join(known, "symbol_id", "left").withColumns({"start_offset": F.coalesce("start_offset", "_s"), "end_offset": F.coalesce("end_offset", "_e")}).drop("_s", "_e")


def grades(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, identity, grade of every candidate that evidence touches: files by path, symbols by id or by containing the span, chunks by overlapping it. candidates: unit, identity, relative_path, symbol_id, start_offset, end_offset."""
    c, e = candidates.alias("c"), evidence.alias("e")
    spans = F.col("e.start_offset").isNotNull() & F.col("e.end_offset").isNotNull()
    touches = (
        F.when(F.col("c.unit") == "file", F.lit(True))
        .when(F.col("c.unit") == "symbol", (F.col("c.symbol_id").eqNullSafe(F.col("e.symbol_id")) & F.col("e.symbol_id").isNotNull()) | (spans & (F.col("c.start_offset") <= F.col("e.start_offset")) & (F.col("e.end_offset") <= F.col("c.end_offset"))))
        .otherwise(spans & (F.greatest("c.start_offset", "e.start_offset") < F.least("c.end_offset", "e.end_offset")))
    )
    on = (F.col("c.relative_path") == F.col("e.relative_path")) & touches
    return c.join(e, on).groupBy("e.query_id", "c.identity").agg(F.max("e.relevance").alias("grade"))


def assert_empty(rows: DataFrame, message: str) -> None:
    """Raises if there is a row."""
    some = rows.limit(1).collect()
    if some:
        raise ValueError(f"{message}: {some[0]}")


def assert_unique(rows: DataFrame, *keys: str) -> None:
    assert_empty(rows.groupBy(*keys).count().filter("count > 1"), f"{', '.join(keys)} repeats")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, as often each."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def validate_run(metrics: DataFrame, claimed: DataFrame, strata: tuple[str, ...] = ()) -> None:
    """Raises unless the claimed summary is what the metrics give."""
    if not same_rows(summary(metrics, strata).select(*claimed.columns), claimed):
        raise ValueError("the summary isn't that of the records")


def population(queries: DataFrame, split: str) -> DataFrame:
    """The queries of a split; raises if there are none."""
    some = queries.filter(F.col("split") == split)
    if some.isEmpty():
        raise ValueError(f"no query in {split}")
    return some


def candidates_for(candidates: DataFrame, project: str, unit: str) -> DataFrame:
    """The candidates of a project and unit; raises if there are none."""
    some = candidates.filter((F.col("project_id") == project) & (F.col("unit") == unit))
    if some.isEmpty():
        raise ValueError(f"no {unit} in {project}")
    return some


def relevance_map(candidates: DataFrame, graded: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, identity, grade: zeros are left out, as every absent pair has grade 0; raises if a query has nothing above 0 among the candidates."""
    positive = graded.filter("grade > 0").join(candidates.select("identity"), "identity", "left_semi")
    assert_empty(queries.select("query_id").join(positive, "query_id", "left_anti"), "nothing relevant")
    return positive.select("query_id", "identity", "grade")


def validate_links(queries: DataFrame, truth: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Queries with their truth (by ground_truth_id and query_id); raises if one has none, or if a column isn't what the configuration names."""
    keys = ["ground_truth_id", "query_id"]
    assert_unique(truth, *keys)
    assert_empty(queries.select(*keys).join(truth, keys, "left_anti"), "query without truth")
    for column, value in versions.items():
        assert_empty(truth.filter(~F.col(column).eqNullSafe(F.lit(value))).select(*keys), column)
    return queries.join(truth, keys)


def validate_registry(files: DataFrame, candidates: DataFrame, manifest: DataFrame) -> None:
    """Raises unless paths and hashes are those of the manifest (project_id, relative_path, content_hash), each project's candidates are unique, and each lies in a file."""
    key = ["project_id", "relative_path"]
    assert_unique(manifest, *key)
    assert_unique(candidates, "project_id", "identity")
    both = files.select(*key, "content_hash")
    if not same_rows(both, manifest.select(*key, "content_hash")):
        raise ValueError("files aren't those of the manifest")
    assert_empty(candidates.join(manifest, key, "left_anti"), "candidate outside the files")


def validate_retrieved(hits: DataFrame, candidates: DataFrame) -> None:
    """Raises if a hit isn't a candidate with the same path and span."""
    keys = ["project_id", "unit", "identity", "relative_path", "start_offset", "end_offset"]
    on = [hits[k].eqNullSafe(candidates[k]) for k in keys]
    assert_empty(hits.join(candidates, on, "left_anti"), "hit isn't a candidate")


def validate_truth(evidence: DataFrame, files: DataFrame, symbols: DataFrame) -> None:
    """Raises if evidence names a file or symbol that isn't there, or a span outside its file (files: relative_path, length)."""
    assert_empty(evidence.join(files, "relative_path", "left_anti"), "no such file")
    assert_empty(evidence.filter("symbol_id is not null").join(symbols.select("symbol_id"), "symbol_id", "left_anti"), "no such symbol")
    spans = evidence.filter("start_offset is not null").join(files.select("relative_path", "length"), "relative_path")
    assert_empty(spans.filter("start_offset < 0 or end_offset <= start_offset or end_offset > length"), "span outside its file")
