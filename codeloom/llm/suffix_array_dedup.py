"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of `LENGTH` bytes covers it that also starts anywhere else. Shards are made so that equal
strings meet in one (see `_repeats`): each gets a suffix array by Larsson and Sadakane's refinement and common
prefixes by Kasai's rule, run for all pieces of the shard in step. An anchor with too many different stretches lies in
several shards; each hands on its different strings in order of their hash, and one shard after the other is looked up
by binary search in what the shards before it have, a bounded range of hashes at a time.

Every copy goes, the first one too. For users who want to keep the first, `n_later` counts the bytes covered by strings
that also start in a document with a lesser id.

Null and empty texts have no bytes; texts shorter than `LENGTH` lose nothing. Repeated rows, with or without an
id, are documents of their own and remove each other's strings. Only doc_id and text are read, whatever else the
table has. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._repeats import Classes, Shard, cover, removed_windows, runs_of

LENGTH = 400
GRAM = 200
#: Strings of a range of hashes, about, that shards are merged over.
RANGE = 1 << 16
SCHEMA = "doc_id long, n_bytes long, kept binary, spans array<struct<start int, end int>>, n_later long"


def _tokens(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
    return A.prefix_hash(chunk.data), chunk.offsets


def _span(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.arange(len(chunk.data))
    return place, place + 1, chunk.offsets


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, the first the highest."""
    padded = np.zeros(len(data) + 8, dtype=np.uint64)
    padded[: len(data)] = data
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def kasai(eights: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to `most`, of each suffix of `order` and the one before it.

    The suffixes are those of pieces: counts[k] from starts[k] on. All pieces go on together, one suffix each at a
    time; from a suffix to the next of its piece the common prefix loses at most one if both neighbours move on.
    """
    n = len(eights)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    known = np.zeros(n, dtype=np.int64)
    place = np.full(n + 1, n, dtype=np.int64)  # beyond all for what isn't in the order
    place[order] = np.arange(len(order))
    lanes = np.argsort(-counts, kind="stable")
    for t in range(int(counts.max()) if len(counts) else 0):
        lanes = lanes[: np.searchsorted(-counts[lanes], -t, side="left")]
        a = starts[lanes] + t
        b = before[a]
        have = np.zeros(len(a), dtype=np.int64)
        if t:
            last = before[a - 1]
            # suffixes that agree beyond the order's limit may stand in either order: the rule needs the neighbour's next before this one
            moved = (last >= 0) & (place[last + 1] < place[a])
            # and of the same piece as the neighbour
            moved &= ends[np.minimum(last + 1, n - 1)] == ends[np.maximum(last, 0)]
            have[moved] = np.maximum(known[a[moved] - 1] - 1, 0)
        live = np.flatnonzero(b >= 0)
        room = np.minimum(np.minimum(ends[a] - a, ends[np.maximum(b, 0)] - b), most)
        live = live[have[live] < room[live]]
        while len(live):
            x = eights[a[live] + have[live]] ^ eights[b[live] + have[live]]
            equal = sum(((x >> np.uint64(8 * k)) == 0).astype(np.int64) for k in range(8))  # leading bytes that agree
            have[live] += equal
            live = live[(equal == 8) & (have[live] < room[live])]
        known[a] = np.where(b >= 0, np.minimum(have, room), 0)
    return known[order]


def string_classes(shard: Shard, length: int = LENGTH) -> Classes:
    """Equal strings of a shard are neighbours in its suffix array with a common prefix of `length` at least."""
    data, bounds = shard.chunk.data, shard.chunk.offsets
    ends = np.repeat(bounds[1:], np.diff(bounds))
    eights = _eights(data)
    order, _ = A.suffix_ranks(eights, ends, ends, limit=length, width=8)
    base = np.cumsum(shard.windows) - shard.windows
    owner = np.repeat(np.arange(len(shard.windows)), shard.windows)
    start = bounds[:-1][owner] + np.arange(len(owner)) - base[owner]
    window = np.full(len(data), -1, dtype=np.int64)
    window[start] = np.arange(len(start))
    order = order[window[order] >= 0]
    common = kasai(eights, order, bounds[:-1], shard.windows, ends, length)
    new = common < length
    new[:1] = True
    cls = np.zeros(len(start), dtype=np.int64)
    cls[window[order]] = np.cumsum(new) - 1
    first = order[new]
    sums, more = A.prefix_hash(data), A.prefix_hash(A.mix(data.astype(np.uint64) + np.uint64(0x5851F42D)))
    return cls, A.span_hash(sums, first, first + length).view(np.int64), A.span_hash(more, first, first + length).view(np.int64)


def place_of(highs: np.ndarray, lows: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where each pair is in the sorted pairs, or would stand."""
    at = np.searchsorted(highs, high)
    while True:  # past pairs with the same first half and a lesser second one
        short = at < len(highs)
        short[short] = (highs[at[short]] == high[short]) & (lows[at[short]] < low[short])
        if not short.any():
            return at
        at[short] += 1


def merge_shards(local: DataFrame) -> DataFrame:
    """Totals of each string over the shards it is in. A task holds the strings of one range of hashes."""
    n = local.count()
    bits = max(0, (n // RANGE).bit_length())
    ranged = local.withColumn("range", F.shiftrightunsigned("high", 64 - bits) if bits else F.lit(0).cast("long"))
    names = ("high", "low", "times", "least", "most")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        current, have = None, dict.fromkeys(names, none)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in have.values()], names=list(have))

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("range", "anchor", "part")]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if keys[0][lo] != current:
                    if len(have["high"]):
                        yield out()
                    current, have = keys[0][lo], dict.fromkeys(names, none)
                own = {c: batch.column(c).to_numpy()[lo:hi] for c in names}
                at = place_of(have["high"], have["low"], own["high"], own["low"])
                known = at < len(have["high"])
                known[known] = (have["high"][at[known]] == own["high"][known]) & (have["low"][at[known]] == own["low"][known])
                spot = at[known]  # a shard has a string once
                have = {c: x.copy() for c, x in have.items()}
                have["times"][spot] += own["times"][known]
                have["least"][spot] = np.minimum(have["least"][spot], own["least"][known])
                have["most"][spot] = np.maximum(have["most"][spot], own["most"][known])
                have = {c: np.insert(have[c], at[~known], own[c][~known]) for c in names}
        if len(have["high"]):
            yield out()

    dealt = ranged.repartition("range").sortWithinPartitions("range", "anchor", "part", "high", "low").select("range", "anchor", "part", *names)
    return dealt.mapInArrow(A.released(merged), ", ".join(f"{c} long" for c in names))


def _apply(chunk: A.Chunk, lo: list[np.ndarray], hi: list[np.ndarray], later: list[np.ndarray]) -> dict[str, pa.Array]:
    spans, kept, n_later = [], [], np.zeros(len(lo), np.int64)
    for k in range(len(lo)):
        own = chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]]
        spans.append([])
        if len(lo[k]):
            gone = cover(lo[k], hi[k], LENGTH, len(own))
            some = later[k] > 0
            n_later[k] = cover(lo[k][some], hi[k][some], LENGTH, len(own)).sum()
            spans[-1] = runs_of(gone)
            own = own[~gone]
        kept.append(own.tobytes())
    sizes = np.diff(chunk.offsets).astype(np.int64)
    return {"n_bytes": pa.array(sizes), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "n_later": pa.array(n_later)}


def remove_repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the remaining bytes, the runs of removed bytes (from, to the one after the last), and n_later, of each document."""
    return removed_windows(docs, _tokens, _span, string_classes, LENGTH, GRAM, False, _apply, SCHEMA, merge_shards)


def brute_force(docs: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """Numbers of bytes, of removed ones and of their runs, digest of the rest, and n_later, by plain comparison, for tests."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    none = float("inf")
    times: dict[bytes, int] = {}
    least: dict[bytes, float] = {}
    for d, b in raw:
        for k in range(len(b) - length + 1):
            x = b[k : k + length]
            times[x] = times.get(x, 0) + 1
            least[x] = min(least.get(x, none), none if d is None else d)
    out = []
    for d, b in raw:
        gone, later = bytearray(len(b)), bytearray(len(b))
        for k in range(len(b) - length + 1):
            x = b[k : k + length]
            if times[x] > 1:
                gone[k : k + length] = b"\1" * length
            if least[x] < (none if d is None else d):
                later[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest(), sum(later)))
    return out
