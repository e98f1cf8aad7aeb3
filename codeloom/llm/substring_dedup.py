"""Removal of repeated word windows by prefix-partitioned suffix trees.

A word goes if a window of `WINDOW` consecutive words covers it whose words also start in a document with a
lesser id. The suffixes that matter start at windows, and are sampled by their anchor (see `_repeats`), so
the suffixes of one anchor are a partition of their own: the corpus is split by runs of `GRAM` words, and an anchor with
too many different stretches over several shards. In a shard, suffixes are split by prefixes of variable
length: a group that is larger than `GROUP` suffixes is split by one more word, again and again. Each group's
subtree is built by sorting its suffixes and taking the common prefixes of neighbours; internal nodes at depth
`WINDOW` or more are the repeats, and the least document under a node says which of its leaves go. Every removal comes
from such a node: equal stretches are only counted together before they enter a tree, and each gets its windows' nodes back.

Null and empty texts have no words; texts of fewer than `WINDOW` words lose nothing. A null id sorts after
all others. Documents with the same id don't remove each other's windows; repeated rows give repeated rows.
Only doc_id and text are read, whatever else the table has. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._repeats import Classes, Shard, cover, removed_windows, runs_of

WINDOW = 50
GRAM = 25
GROUP = 8192
SCHEMA = "doc_id long, n_words long, kept string, spans array<struct<start int, end int>>"


def _tokens(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
    w = A.words(chunk)
    return A.prefix_hash(w.hash), w.bounds


def _span(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = A.words(chunk)
    return w.start, w.end, w.bounds


def prefix_groups(owner: np.ndarray, start: np.ndarray, tokens: np.ndarray, length: int, most: int = GROUP) -> np.ndarray:
    """Group of each suffix: the same owner and the same prefix, as long as is needed for groups of at most `most`; suffixes equal over `length` words stay together."""
    group = np.unique(owner, return_inverse=True)[1]
    for depth in range(length):
        size = np.bincount(group)
        large = np.flatnonzero(size[group] > most)
        if not len(large):
            break
        # hashes mix the group with the next word: equal ones belong together
        key = A.mix(tokens[start[large] + depth].astype(np.uint64) + A.mix(group[large].astype(np.uint64)))
        group[large] = len(size) + np.unique(key, return_inverse=True)[1]
        group = np.unique(group, return_inverse=True)[1]
    return group


def subtree_nodes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (rows of word numbers) in order, and the depth of the node over each and the one before it (the first: 0)."""
    order = np.lexsort(words.T[::-1])
    rows = words[order]
    depth = np.zeros(len(rows), dtype=np.int64)
    depth[1:] = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    return order, depth


def window_classes(shard: Shard, length: int = WINDOW, most: int = GROUP) -> Classes:
    """Windows under the same internal node of depth `length`, subtree by subtree."""
    w = A.words(shard.chunk)
    tokens = np.unique(w.hash, return_inverse=True)[1].astype(np.int32)
    base = np.cumsum(shard.windows) - shard.windows
    owner = np.repeat(np.arange(len(shard.windows)), shard.windows)
    start = w.bounds[:-1][owner] + np.arange(len(owner)) - base[owner]
    group = prefix_groups(shard.group[owner], start, tokens, length, most)
    by = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))
    cls = np.zeros(len(start), dtype=np.int64)
    n, lo = 0, 0
    while lo < len(by):  # subtrees of neighbouring groups are built together, up to `most` suffixes
        at = np.searchsorted(cuts, lo + most, side="right") - 1
        hi = int(cuts[at]) if cuts[at] > lo else (int(cuts[at + 1]) if at + 1 < len(cuts) else len(by))
        if at + 1 == len(cuts) and len(by) - lo <= most:
            hi = len(by)
        own = by[lo:hi]
        matrix = np.empty((len(own), length + 1), dtype=np.int32)
        matrix[:, 0] = group[own]
        for k in range(length):
            matrix[:, k + 1] = tokens[start[own] + k]
        order, depth = subtree_nodes(matrix)
        node = np.cumsum(depth <= length) - 1  # a deep node continues only over length words and the group
        cls[own[order]] = n + node
        n += int(node[-1]) + 1
        lo = hi
    first = np.zeros(n, dtype=np.int64)
    first[cls] = start
    sums, more = A.prefix_hash(w.hash), A.prefix_hash(A.mix(w.hash ^ np.uint64(0x5851F42D4C957F2D)))
    return cls, A.span_hash(sums, first, first + length).view(np.int64), A.span_hash(more, first, first + length).view(np.int64)


def merge_nodes(local: DataFrame) -> DataFrame:
    """Nodes of the shards of split anchors, put together over equal windows."""
    return local.groupBy("high", "low").agg(F.sum("times").alias("times"), F.min("least").alias("least"), F.max("most").alias("most"))


def _apply(chunk: A.Chunk, lo: list[np.ndarray], hi: list[np.ndarray], later: list[np.ndarray]) -> dict[str, pa.Array]:
    sizes, spans, kept = [], [], []
    for k in range(len(lo)):
        raw = chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]].tobytes().split()
        sizes.append(len(raw))
        spans.append([])
        if len(lo[k]):
            gone = cover(lo[k], hi[k], WINDOW, len(raw))
            spans[-1] = runs_of(gone)
            raw = [x for x, g in zip(raw, gone.tolist()) if not g]
        kept.append(b" ".join(raw))
    return {"n_words": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the kept words joined by blanks, and the runs of removed words (from, to the one after the last) of each document."""
    return removed_windows(docs, _tokens, _span, window_classes, WINDOW, GRAM, True, _apply, SCHEMA, merge_nodes)


def brute_force(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """Number of words and of removed words, and digest of the kept ones, by plain comparison, for tests."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    none = float("inf")
    least: dict[tuple, float] = {}
    for d, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            least[key] = min(least.get(key, none), none if d is None else d)
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < (none if d is None else d):
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
