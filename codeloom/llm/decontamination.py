"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents (a chunk of an Arrow batch) gets a word-level suffix array, ordered as far as a
window is long. Every benchmark suffix that starts a window is searched in it by bisection, all of them at
once; the places between its lower and upper bound are its verbatim occurrences, and what follows them is
compared further for the longest match. Documents never meet each other, so nothing is shuffled.

The benchmark is taken in blocks of at most `BLOCK_BYTES` of text (its size is summed first). A benchmark of one block
is searched in one pass. Of a larger one each block has a pass of its own, one after the other: the block is sent to the
executors, what it finds is written, and the block is dropped again, so one block is in memory at a time; the findings,
for the documents that have any, are then joined to the documents.

Null and empty texts have no words, hits or items, and aren't contaminated. Items without words are never
found. An item without an id counts as the id "null". Repeated items count once for each id. Repeated
documents give repeated rows; an empty table gives none. Only doc_id, text, item_id and text are read, whatever else the tables have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._tables import written

#: Fixed values of the contract: words of a window, and the share 1 / SHARE of hit words from which a document is contaminated.
WINDOW = 13
SHARE = 20
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 1 << 20

#: What separates words: ASCII but digits and small letters. Capitals are made small first.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[:128] = True
_BLANK[0x30:0x3A] = False
_BLANK[0x61:0x7B] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

MATCH = pa.struct([("item", pa.string()), ("start", pa.int32()), ("words", pa.int32())])


def _tokens(chunk: A.Chunk) -> tuple[np.ndarray, A.Words]:
    w = A.words(chunk, _BLANK, _LOWER[chunk.data])
    return (w.hash >> np.uint64(1)).astype(np.int64), w


class Tests:
    """The windows of a block of benchmark items: word numbers, where each window starts, its length and its item."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW):
        self.ids, self.window = ids, window
        tokens, starts, ends, items = [], [], [], []
        base = 0
        for chunk in A.chunks(texts):
            values, w = _tokens(chunk)
            for k in range(chunk.last - chunk.first):
                a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                if b > a:
                    own = np.arange(a, max(a + 1, b - window + 1))
                    starts.append(own + base)
                    ends.append(np.full(len(own), b + base))
                    items.append(np.full(len(own), chunk.first + k))
            tokens.append(values)
            base += len(values)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.tokens, self.start, self.end, self.item = join(tokens), join(starts), join(ends), join(items)
        self.size = np.minimum(self.end - self.start, window)
        # the words of each window as a row; -1 beyond a short one
        columns = self.start[:, None] + np.arange(window)
        self.words = np.where(np.arange(window) < self.size[:, None], self.tokens[np.minimum(columns, max(len(self.tokens) - 1, 0))] if len(self.tokens) else -1, -1)


def _bounds(tests: Tests, order: np.ndarray, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, the first place and the place after the last in the suffix array whose suffix starts with it."""
    found = []
    for upper in (False, True):
        lo, hi = np.zeros(len(tests.size), np.int64), np.full(len(tests.size), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) // 2
            at = order[middle]
            less = np.zeros(len(open_), dtype=bool)  # the suffix sorts before the window
            whole = np.zeros(len(open_), dtype=bool)  # the suffix starts with the window
            equal = np.arange(len(open_))
            for k in range(tests.window):
                ended = k >= tests.size[open_[equal]]
                whole[equal[ended]] = True
                equal = equal[~ended]
                if not len(equal):
                    break
                place = at[equal] + k
                inside = place < ends[at[equal]]
                mine = np.where(inside, tokens[np.minimum(place, len(tokens) - 1)], -1)
                theirs = tests.words[open_[equal], k]
                less[equal] = mine < theirs
                equal = equal[mine == theirs]
            whole[equal] = True
            if upper:
                less |= whole
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        found.append(lo)
    return found[0], found[1]


def search(tests: Tests, chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, A.Words]:
    """All occurrences of windows in a shard: window, word number, length in words, longest match; and the shard's words."""
    tokens, w = _tokens(chunk)
    none = np.zeros(0, np.int64)
    if not len(tokens) or not len(tests.size):
        return none, none, none, none, w
    ends = w.bounds[w.row + 1]
    order, _ = A.suffix_ranks(tokens, w.row, ends, limit=tests.window)
    lo, hi = _bounds(tests, order, tokens, ends)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    place = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(which))]
    length = tests.size[which].copy()
    going = np.arange(len(which))
    while len(going):
        a, b = tests.start[which[going]] + length[going], place[going] + length[going]
        going, a, b = (x[(a < tests.end[which[going]]) & (b < ends[place[going]])] for x in (going, a, b))
        going = going[tests.tokens[a] == tokens[b]]
        length[going] += 1
    return which, place, tests.size[which], length, w


def maximal(tests: Tests, which: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which occurrences don't go on from one of the window before, one word earlier."""
    at = place * (len(tests.tokens) + 1) + tests.start[which]
    by = np.argsort(at)
    before = np.minimum(np.searchsorted(at[by], at - (len(tests.tokens) + 2)), max(len(at) - 1, 0))
    found = by[before] if len(at) else before
    return ~((at[found] == at - (len(tests.tokens) + 2)) & (tests.item[which[found]] == tests.item[which]) & (tests.start[which] > 0))


def _sizes(benchmark: DataFrame) -> Iterator[DataFrame]:
    """The benchmark in blocks of bounded size; the size is summed on the cluster first."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    # hashing deals unevenly: twice as many blocks as the size asks for
    blocks = 1 if size <= BLOCK_BYTES else -(-2 * size // BLOCK_BYTES)
    for k in range(blocks):
        yield items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)


def _block(items: DataFrame) -> tuple[list[str], pa.Array]:
    got = items.toArrow()
    return got["item_id"].to_pylist(), got["text"].combine_chunks()


def _found(tests: Tests, chunk: A.Chunk) -> tuple[list, list, list, np.ndarray]:
    """Of each text: its hit words, the items found, the maximal matches; and its number of words."""
    which, place, size, length, w = search(tests, chunk)
    n = chunk.last - chunk.first
    hits, items, matches = ([[] for _ in range(n)] for _ in range(3))
    row, whole = w.row[place], maximal(tests, which, place)
    for k in np.unique(row):
        mine = np.flatnonzero(row == k)
        cover = np.zeros(w.bounds[k + 1] - w.bounds[k] + 1, dtype=np.int64)
        at = place[mine] - w.bounds[k]
        np.add.at(cover, at, 1)
        np.subtract.at(cover, at + size[mine], 1)
        hits[k] = np.flatnonzero(np.cumsum(cover)[:-1] > 0).astype(np.int32)
        items[k] = sorted({tests.ids[i] for i in np.unique(tests.item[which[mine]])})
        own = mine[whole[mine]]
        matches[k] = sorted({(tests.ids[i], int(p), int(x)) for i, p, x in zip(tests.item[which[own]], place[own] - w.bounds[k], length[own])})
        matches[k] = [{"item": i, "start": p, "words": x} for i, p, x in matches[k]]
    return hits, items, matches, np.diff(w.bounds)[:n]


FOUND = "hits array<int>, items array<string>, matches array<struct<item string, start int, words int>>"


def _columns(tests: Tests, chunk: A.Chunk) -> dict[str, pa.Array]:
    hits, items, matches, n_words = _found(tests, chunk)
    return {"hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())), "matches": pa.array(matches, pa.list_(MATCH)), "n_words": pa.array(n_words, pa.int64())}


def _searched(docs: DataFrame, sent, kept: str, only_found: bool = False) -> DataFrame:
    """docs with what is found in each text. kept: the schema of the columns that stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(batch.column("text"), SHARD_BYTES):
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                out = {c: part.column(c) for c in part.schema.names if c != "text"} | _columns(sent.value, chunk)
                full = pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                yield full.filter(pa.array([len(x) > 0 for x in out["hits"]], pa.bool_())) if only_found else full

    return docs.mapInArrow(A.released(rows), f"{kept}, {FOUND}, n_words long")


def _gathered(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """row, doc_id, hits, items, matches and n_words of each document."""
    spark = docs.sparkSession
    kept = f"row {docs.schema['row'].dataType.simpleString()}, doc_id long"
    blocks = list(_sizes(benchmark))
    if len(blocks) == 1:
        return _searched(docs, spark.sparkContext.broadcast(Tests(*_block(blocks[0]), window)), kept)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    partial = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(Tests(*_block(block), window))
        found, _ = written(_searched(keyed, sent, "doc_id long, text_hash long", only_found=True).drop("n_words").distinct(), "found")
        sent.destroy()
        partial = found if partial is None else partial.unionByName(found)
    # a row for each document and block that has hits; repeated documents have one
    all_ = partial.groupBy("doc_id", "text_hash").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "matches")])
    all_ = all_.select("doc_id", "text_hash", *[F.array_sort(F.array_distinct(c)).alias(c) for c in ("hits", "items", "matches")])
    empty = spark.sparkContext.broadcast(Tests([], pa.array([], pa.string()), window))
    named = docs.withColumn("text_hash", F.xxhash64("text"))
    counted = _searched(named, empty, kept + ", text_hash long").select("row", "doc_id", "text_hash", "n_words")
    left, right = counted.alias("l"), all_.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
    none = lambda c: F.coalesce(F.col(f"r.{c}"), F.array().cast(all_.schema[c].dataType)).alias(c)
    return left.join(right, same, "left").select("l.row", "l.doc_id", *[none(c) for c in ("hits", "items", "matches")], "l.n_words")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, keep_columns: bool = False) -> DataFrame:
    """One row per document with its hit words and items, the longest match in words, and the maximal matches (item, first word in the document, words).

    keep_columns: the input's rows that aren't contaminated instead.
    """
    carried = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row") if keep_columns else F.lit(0).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _gathered(carried, benchmark, window)
    n_hit = F.size("hits").cast("long")
    contaminated = (n_hit > 0) & (share * n_hit >= F.col("n_words"))
    if keep_columns:
        return found.filter(~contaminated).select("row.*")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated.alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).cast("long").alias("longest_match"),
        "matches",
    )


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW, share: int = SHARE) -> list[tuple]:
    """The same by plain comparison, for tests."""
    import re

    def split(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    windows: dict[tuple, set] = {}
    for item, text in items:
        own = split(text)
        for k in range(max(1, len(own) - window + 1)) if own else ():
            windows.setdefault(tuple(own[k : k + window]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        own, hit, found = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(own) - size + 1):
                if names := windows.get(tuple(own[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(own)))
    return out
