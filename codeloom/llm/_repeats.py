"""What substring removal by words and by bytes have in common.

1. Every text is cut into stretches (see `_anchors`): one row of hashes for each, no text. Written once.
2. Anchors that occur twice or more stay; equal stretches are summed (how often, and in which least document).
3. One copy of each different stretch is fetched from its text. Stretches of an anchor go to the same shard; an
   anchor with more than `SHARD_STRETCHES` different ones is split over several. Shards are sorted, so a task
   holds a few megabytes at a time, whatever the size of its partition.
4. The operator's own shard function, given the different stretches of a shard, finds which of their windows are
   equal: runs of repeated windows, each with the least document it starts in. For anchors in one shard that settles
   it. For split anchors each shard hands on one row for each different window; these are merged by window over all
   shards, and the totals go back first to the shards, then to their windows.
5. The runs are joined to all stretches: whether a document loses a window is decided by the least document of that
   window's class. They are gathered by document, once for each different stretch, and applied to the whole text.

The text is shuffled once: both joins with it need the same partitioning. Documents are known by id and text
hash, so repeated rows share one verdict and give one row each; a null id sorts after every other id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _anchors as N
from . import _arrays as A
from ._tables import drop, written

SHARD_STRETCHES = 2000
SHARD_BYTES = 1 << 20
NO_ID = (1 << 63) - 1


@dataclass
class Shard:
    """Different stretches with their bytes; group: number of the (anchor, part); times, least and most: occurrences, least and greatest document."""

    chunk: A.Chunk
    group: np.ndarray
    windows: np.ndarray
    times: np.ndarray
    least: np.ndarray
    most: np.ndarray


#: Of the windows of a shard (stretches one after the other): the class of each, equal for equal windows of a group; and a 128-bit hash of each class as two numbers.
Classes = tuple[np.ndarray, np.ndarray, np.ndarray]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the key (id with nulls last, text hash) and text; none of the key's columns is ever null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("place"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def cut(docs: DataFrame, tokens: Callable[[A.Chunk], tuple[np.ndarray, np.ndarray]], length: int, gram: int) -> DataFrame:
    """place, text_hash, first, count, anchor, content: one row for each stretch. tokens: hash sums and first token of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(batch.column("text")):
                prefix, bounds = tokens(chunk)
                s = N.stretches(prefix, bounds, length, gram)
                if len(s.row):
                    part = batch.slice(chunk.first, chunk.last - chunk.first)
                    place, text_hash = (part.column(c).to_numpy(zero_copy_only=False)[s.row] for c in ("place", "text_hash"))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place, text_hash, s.first.astype(np.int32), s.count.astype(np.int32), s.anchor, s.content)], names=["place", "text_hash", "first", "count", "anchor", "content"])

    return docs.select("place", "text_hash", "text").mapInArrow(A.released(rows), "place long, text_hash long, first int, count int, anchor long, content long")


def _lists(starts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(starts) if starts else np.zeros(0), kind))


def _fetch(reps: DataFrame, texts: DataFrame, span: Callable[[A.Chunk], tuple[np.ndarray, np.ndarray]], length: int) -> DataFrame:
    """The bytes of each stretch. span: byte places where tokens start and end, and the first token of each text."""
    wanted = reps.groupBy("place", "text_hash").agg(*[F.collect_list(c).alias(c) for c in ("first", "count", "anchor", "content")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            # repeated rows stand next to each other after the join: their stretches are fetched once
            place, text_hash = (batch.column(c).to_numpy() for c in ("place", "text_hash"))
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (text_hash[1:] != text_hash[:-1])
            if not batch.num_rows:
                continue
            new[0] = (place[0], text_hash[0]) != before
            before = place[-1], text_hash[-1]
            batch = batch.filter(pa.array(new))
            for chunk in A.chunks(batch.column("text")):
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                start, end, bounds = span(chunk)
                lists = [part.column(c) for c in ("first", "count", "anchor", "content")]
                sizes = np.diff(lists[0].offsets.to_numpy())
                first, count, anchor, content = (x.flatten().to_numpy() for x in lists)
                at = bounds[np.repeat(np.arange(part.num_rows), sizes)] + first
                lo, hi = start[at], end[at + count + length - 2]
                data = chunk.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(content), pa.array(count.astype(np.int32)), pa.array([data[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())],
                    names=["anchor", "content", "count", "bytes"],
                )

    joined = texts.join(wanted, ["place", "text_hash"]).select("place", "text_hash", "text", "first", "count", "anchor", "content")
    return joined.mapInArrow(A.released(rows), "anchor long, content long, count int, bytes binary")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Shard]]:
    """Whole (anchor, part) groups, a few megabytes at a time, of a sorted partition; a stretch fetched twice counts once."""

    def whole(table: pa.Table) -> tuple[pa.Table, Shard]:
        key = [table[c].to_numpy() for c in ("anchor", "part", "content")]
        same = np.ones(len(table) - 1, dtype=bool)
        for k in key:
            same &= k[1:] == k[:-1]
        table = table.filter(pa.array(np.append(True, ~same)))
        anchor, part = table["anchor"].to_numpy(), table["part"].to_numpy()
        new = np.append(0, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))
        chunk = next(A.chunks(table["bytes"].combine_chunks(), limit=1 << 62))
        return table, Shard(chunk, np.cumsum(new), table["count"].to_numpy().astype(np.int64), table["times"].to_numpy(), table["least"].to_numpy(), table["most"].to_numpy())

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            held.append(some)
            size += some.column("bytes").nbytes
            if size < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor, part = table["anchor"].to_numpy(), table["part"].to_numpy()
            last = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
            if len(last):
                yield whole(table.slice(0, last[-1] + 1))
                held = table.slice(last[-1] + 1).combine_chunks().to_batches()
                size = sum(x.column("bytes").nbytes for x in held)
    if held:
        yield whole(pa.Table.from_batches(held))


def removed_windows(
    docs: DataFrame,
    tokens: Callable,
    span: Callable,
    classes: Callable[[Shard], Classes],
    length: int,
    gram: int,
    by_document: bool,
    apply: Callable[[A.Chunk, list[np.ndarray], list[np.ndarray], list[np.ndarray]], dict[str, pa.Array]],
    schema: str,
    merge: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """One row per document, as `apply` makes it of the whole text, the spans of windows to remove, and which of them start in a lesser document too.

    by_document: a window goes if an equal one starts in a lesser document; otherwise if one starts anywhere else.
    merge: totals (times, least, most) of the windows of split anchors, from one row for each shard and window.
    """
    spark = docs.sparkSession
    texts = keyed(docs)
    everything, everything_path = written(cut(texts, tokens, length, gram), "stretches")
    # counts are written before they are joined: a join splits hot keys only if both its sides come straight from a shuffle
    repeated, repeated_path = written(everything.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    cells, _ = written(everything.join(repeated, "anchor", "left_semi"), "repeated")
    drop(spark, everything_path, repeated_path)

    sums, sums_path = written(cells.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min("place").alias("least"), F.max("place").alias("most")), "sums")
    parts, parts_path = written(sums.groupBy("anchor").agg(F.ceil(F.count("*") / SHARD_STRETCHES).cast("int").alias("parts")), "parts")
    distinct, distinct_path = written(sums.join(parts, "anchor").withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts").cast("long")).cast("int")), "distinct")
    drop(spark, sums_path, parts_path)
    reps = cells.join(distinct.select("anchor", "content", F.col("least").alias("place")), ["anchor", "content", "place"], "left_semi")
    # any one occurrence in the least document will do
    reps = reps.groupBy("anchor", "content").agg(F.min("place").alias("place"), F.min(F.struct("text_hash", "first")).alias("at"), F.min("count").alias("count"))
    fetched = _fetch(reps.select("place", "at.text_hash", "at.first", "count", "anchor", "content"), texts, span, length)
    shards = fetched.join(distinct, ["anchor", "content"]).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "content")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, shard in _shards(batches):
            cls, high, low = classes(shard)
            n_cls = len(high)
            owner = np.repeat(np.arange(len(shard.windows)), shard.windows)
            times = np.bincount(cls, weights=shard.times[owner], minlength=n_cls).astype(np.int64)
            least, most = np.full(n_cls, NO_ID, dtype=np.int64), np.full(n_cls, -NO_ID, dtype=np.int64)
            np.minimum.at(least, cls, shard.least[owner])
            np.maximum.at(most, cls, shard.most[owner])
            split = table["parts"].to_numpy() > 1
            base = np.cumsum(shard.windows) - shard.windows
            # settled: runs of repeated windows with the same least document, of anchors in one shard; open: every window with its class's hash
            goes = (least < most)[cls] if by_document else (times > 1)[cls]
            lo, hi = _runs(goes & ~split[owner], shard.windows, least[cls])
            none = np.zeros(0, np.int64)
            pick = [np.arange(base[k], base[k] + shard.windows[k]) if split[k] else none for k in range(len(base))]
            open_ = {name: _lists([of[cls[p]] if len(p) else none for p in pick], pa.int64()) for name, of in (("high", high), ("low", low), ("times", times), ("smallest", least), ("greatest", most))}
            settled = {"lo": _lists(lo, pa.int32()), "hi": _lists(hi, pa.int32()), "least": _lists([least[cls[base[k] + x]] for k, x in enumerate(lo)], pa.int64())}
            columns = {c: table[c].combine_chunks() for c in ("anchor", "content", "part")} | settled | open_
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    form = "anchor long, content long, part int, lo array<int>, hi array<int>, least array<long>, high array<long>, low array<long>, times array<long>, smallest array<long>, greatest array<long>"
    verdicts, _ = written(shards.mapInArrow(A.released(judged), form), "verdicts")
    drop(spark, distinct_path)
    # windows of split anchors: one row for each shard and different window, merged over the shards
    opened = verdicts.filter(F.size("high") > 0).select("anchor", "content", "part", F.posexplode(F.arrays_zip("high", "low", "times", "smallest", "greatest")).alias("at", "w"))
    opened = opened.select("anchor", "content", "part", "at", "w.high", "w.low", "w.times", F.col("w.smallest").alias("least"), F.col("w.greatest").alias("most"))
    key = ["anchor", "part", "high", "low"]
    local, _ = written(opened.groupBy(*key).agg(F.max("times").alias("times"), F.min("least").alias("least"), F.max("most").alias("most")), "local")
    merged = merge(local).filter("least < most" if by_document else "times > 1").select("high", "low", F.col("least").alias("all_least"))
    handed = local.join(merged, ["high", "low"]).select(*key, "all_least")
    back = opened.select("content", "at", *key).join(handed, key)
    late = back.groupBy("anchor", "content").agg(F.sort_array(F.collect_set(F.struct("at", "all_least"))).alias("w"))
    late = late.select("anchor", "content", F.col("w.at").alias("lo"), F.transform("w.at", lambda x: x + 1).alias("hi"), F.col("w.all_least").alias("least"))
    spans = verdicts.filter(F.size("lo") > 0).select("anchor", "content", "lo", "hi", "least").unionByName(late)

    here = lambda x: F.struct((x["lo"] + F.col("first")).alias("lo"), (x["hi"] + F.col("first")).alias("hi"), (x["least"] < F.col("place")).alias("later"))
    found = cells.join(spans, ["anchor", "content"]).select("place", "text_hash", F.transform(F.arrays_zip("lo", "hi", "least"), here).alias("runs"))
    if by_document:
        found = found.withColumn("runs", F.filter("runs", lambda x: x["later"])).filter(F.size("runs") > 0)
    # a set: repeated rows have the same runs many times
    gone = found.groupBy("place", "text_hash").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    gone = gone.select("place", "text_hash", *[F.col(f"runs.{c}").alias(c) for c in ("lo", "hi", "later")])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(batch.column("text")):
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                bounds = [_values(part.column(c)) for c in ("lo", "hi", "later")]
                out = {"doc_id": part.column("doc_id")} | apply(chunk, *bounds)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return texts.join(gone, ["place", "text_hash"], "left").select("doc_id", "text", "lo", "hi", "later").mapInArrow(A.released(applied), schema)


def _values(lists: pa.Array) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]


def _runs(flags: np.ndarray, sizes: np.ndarray, value: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each piece of `sizes` flags, where runs of set flags with one value start and end."""
    ends = np.cumsum(sizes)
    base = ends - sizes
    same = value[1:] == value[:-1]
    before, after = np.append(False, flags[:-1] & same), np.append(flags[1:] & same, False)
    edge = np.zeros(len(flags) + 1, dtype=bool)
    edge[base] = True
    lo = np.flatnonzero(flags & (~before | edge[:-1]))
    hi = np.flatnonzero(flags & (~after | edge[1:])) + 1
    cuts = np.searchsorted(lo, base)
    cuts = np.append(cuts, len(lo))
    lo_in = lo - base[np.searchsorted(base, lo, side="right") - 1] if len(lo) else lo
    hi_in = hi - base[np.searchsorted(base, hi - 1, side="right") - 1] if len(hi) else hi
    return [lo_in[a:b] for a, b in zip(cuts[:-1], cuts[1:])], [hi_in[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def runs_of(flags: np.ndarray) -> list[dict[str, int]]:
    """The maximal runs of set flags as start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def cover(lo: np.ndarray, hi: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which tokens windows [lo, hi) of `length` tokens cover."""
    flags = np.zeros(total + 1, dtype=np.int64)
    np.add.at(flags, lo, 1)
    np.subtract.at(flags, np.minimum(hi + length - 1, total), 1)
    return np.cumsum(flags)[:total] > 0
