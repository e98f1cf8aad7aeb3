"""Documentation of sources with a given text generator: which symbols need one, what is made, and where it goes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import needs_translation, output_error, output_name, strip_fence
from codeloom.operators import parsing, quality

Generator = Callable[[], Callable[[str, str], str]]


def action(has_doc: Column, doc: Column, target: str, incremental: bool, rewrite: bool) -> Column:
    """generate, translate or skip: documented symbols are skipped if only missing ones are wanted, translated if their text is in another language, and rewritten on demand."""
    return F.when(~has_doc, "generate").when(F.lit(rewrite), "generate").when(F.lit(incremental), "skip").when(needs_translation(F.coalesce(doc, F.lit("")), target), "translate").otherwise("skip")


def generated(items: DataFrame, load: Generator) -> DataFrame:
    """Items (action, code, doc and any keys) with `text`, by a generator loaded once per task, checked, and null with `error` where it can't be used."""

    @F.pandas_udf("string")
    def call(kind: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        make = load()
        for what, code in kind:
            yield pd.Series([None if w == "skip" else make(w, c) for w, c in zip(what, code)])

    raw = items.withColumn("_raw", call("action", "code"))
    error = F.when(F.col("action") != "skip", F.coalesce(output_error(F.col("_raw")), F.when(strip_fence(F.col("_raw")).isNull(), "INVALID_FENCE")))
    return raw.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull() & (F.col("action") != "skip"), strip_fence(F.col("_raw")))).drop("_raw")


ANNOTATED = "relative_path string, annotated string, inserted int, failed int"


def annotated(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Files (relative_path, language, content) with texts (relative_path, start_line, text) put in from the last line up, so that line numbers hold; a text that can't be put in is counted and left out."""
    listed = texts.filter("text is not null").groupBy("relative_path").agg(F.sort_array(F.collect_list(F.struct(F.col("start_line").alias("line"), "text")), asc=False).alias("texts"))
    joined = files.select("relative_path", "language", "content").join(listed, "relative_path", "left")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, language, source, wanted in frame[["relative_path", "language", "content", "texts"]].itertuples(index=False, name=None):
                done = failed = 0
                insert = quality.insert_docstring if language == "python" else quality.insert_javadoc
                for item in wanted if wanted is not None else ():
                    try:
                        source, done = insert(source, item["line"], item["text"]), done + 1
                    except (SyntaxError, ValueError, StopIteration, IndexError):
                        failed += 1
                out.append((path, source, done, failed))
            yield pd.DataFrame(out, columns=["relative_path", "annotated", "inserted", "failed"])

    return joined.mapInPandas(put, ANNOTATED)


def document_files(files: DataFrame, load: Generator, target: str = "en", incremental: bool = True, rewrite: bool = False, naming: str = "suffix") -> DataFrame:
    """Output path, annotated source and outcome of every file (project_id, relative_path, language, content)."""
    symbols = parsing.symbols(files)
    code = F.array_join(F.slice(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    items = symbols.join(files.select("project_id", "relative_path", "content"), ["project_id", "relative_path"]).withColumn("code", code)
    items = items.withColumn("action", action(F.col("has_doc"), F.lit(None).cast("string"), target, incremental, rewrite)).drop("content")
    made = generated(items, load)
    out = annotated(files, made)
    errors = made.groupBy("relative_path").agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    joined = out.join(errors, "relative_path", "left")
    outcome = quality.batch_outcome(F.col("annotated").isNotNull(), F.coalesce("errors", F.lit(0)) + F.col("failed"), F.lit(False))
    return joined.select("relative_path", output_name(F.col("relative_path"), naming).alias("output_path"), "annotated", "inserted", outcome.alias("outcome"))


class GeneratorRegistry:
    """Text generators by name, with the limits each one's provider sets; an unknown or repeated name raises."""

    def __init__(self):
        self._known: dict[str, tuple[Generator, int]] = {}

    def register(self, name: str, load: Generator, max_chars: int = 100_000) -> None:
        if not name or name in self._known or max_chars < 1:
            raise ValueError("a generator has a name of its own and a limit above 0")
        self._known[name] = load, max_chars

    def names(self) -> list[str]:
        return sorted(self._known)

    def load(self, name: str) -> Generator:
        if name not in self._known:
            raise ValueError(f"no generator {name}: there are {', '.join(self.names())}")
        return self._known[name][0]

    def limit(self, name: str) -> int:
        self.load(name)
        return self._known[name][1]


def batch(files: DataFrame, registry: GeneratorRegistry, name: str, **options) -> dict[str, DataFrame]:
    """A batch over many files: `results` of those whose source is sound and within the generator's limit, `log` (relative_path, step, message) of all in order of their paths, and `counts` of outcomes."""
    error = quality.input_error(F.col("content"), F.col("language"), registry.limit(name))
    checked = files.withColumn("_error", error)
    results = document_files(checked.filter("_error is null").drop("_error"), registry.load(name), **options)
    rejected = checked.filter("_error is not null").select("relative_path", F.lit("input").alias("step"), F.col("_error").alias("message"))
    done = results.select("relative_path", F.lit("document").alias("step"), F.concat_ws(" ", "outcome", F.col("inserted").cast("string")).alias("message"))
    counts = results.select("outcome").unionByName(rejected.select(F.lit("REJECTED").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("files"))
    return {"results": results, "log": rejected.unionByName(done).orderBy("relative_path", "step"), "counts": counts}


def progress(spark, group: str) -> dict[str, int]:
    """Tasks of the running stages of a job group: all, done, failed."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(group) for s in getattr(tracker.getJobInfo(job), "stageIds", ())]
    some = [s for s in stages if s is not None]
    return {"tasks": sum(s.numTasks for s in some), "done": sum(s.numCompletedTasks for s in some), "failed": sum(s.numFailedTasks for s in some)}


def cancellable(spark, group: str) -> Callable[[], None]:
    """Marks this thread's jobs as a group; the returned function cancels them."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    return lambda: spark.sparkContext.cancelJobGroup(group)
