"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow batches. They are cut into chunks of a few megabytes of whole texts, so that
memory follows the chunk and not the batch; one text longer than a chunk makes a chunk of its own.
Hashes are polynomial sums modulo 2**64 with an odd base, finished by a bit mixer: the hash of any
span comes from two prefix sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U64 = np.uint64


def released(rows: Callable) -> Callable:
    """A function over batches that gives freed memory back to the machine when its partition ends: workers live on for the next stage."""

    @wraps(rows)
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = np.asarray(x).astype(np.uint64)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i; uint8 values are first spread over 64 bits."""
    if values.dtype == np.uint8:
        values = _BYTE_VALUES[values]
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers("up", _BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), the same wherever the span stands."""
    down = _powers("down", _INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Whole texts [first, last) of a batch: their bytes, and where each starts (one more at the end)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value of each byte."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of an Arrow array of strings or binaries; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = texts.cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    n = len(binary)
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = binary.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """The words of a chunk: byte spans, the text each belongs to, 64-bit hashes; first word of each text."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def byte_set(text: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(text, dtype=np.uint8)] = True
    return out


#: Space and the controls 9 to 13 separate words.
BLANK = byte_set(bytes([0x20, 9, 10, 11, 12, 13]))


def words(chunk: Chunk, blank: np.ndarray = BLANK, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that aren't blank, never across texts. data: the bytes to hash, if changed."""
    data = chunk.data if data is None else data
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~blank[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:n] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    row = chunk.row_of(starts)
    bounds = np.searchsorted(row, np.arange(chunk.last - chunk.first + 1))
    return Words(starts, ends, row, span_hash(prefix_hash(data), starts, ends), bounds)


def union_lengths(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by spans sorted by start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


class Levels:
    """Ranks at prefix lengths 1, 2, 4 and so on, made when asked for: kept is one byte a place, the first level that tells it from the place before."""

    def __init__(self, order: np.ndarray, born: np.ndarray, count: int):
        self.order, self.born, self.count = order, born, count

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> np.ndarray:
        head = np.maximum.accumulate(np.where(self.born <= k, np.arange(len(self.order)), 0))
        rank = np.empty(len(self.order), dtype=np.int64)
        rank[self.order] = head
        return rank


def suffix_ranks(tokens: np.ndarray, segment: np.ndarray, ends: np.ndarray, limit: int | None = None, width: int = 1) -> tuple[np.ndarray, Levels]:
    """Suffix array of the concatenated segments by refinement of unsorted groups (Larsson and Sadakane).

    tokens: non-negative integers, sorted as integers. segment: of each position, non-decreasing; a suffix
    ends with its segment. ends: of each position, the end of its segment. The suffixes are first ordered by
    one token; each round then orders every group that isn't a single suffix by the rank that the suffix has
    `step` positions on, and doubles the step. limit: prefixes of that many tokens are told apart, no more.
    width: how many positions a token tells apart already. Returns the array, and the rank of each position at
    prefix lengths 1, 2, 4 and so on times the width.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), Levels(np.zeros(0, np.int64), np.zeros(0, np.uint8), 0)
    order = np.argsort(tokens)
    ordered = tokens[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    born = np.where(new, 0, 255).astype(np.uint8)
    count = 1
    step = width
    single = new & np.append(new[1:], True)
    active = np.flatnonzero(~single)  # places in the array whose group isn't a single suffix
    while len(active) and (limit is None or step < limit):
        at = order[active]
        on = at + step
        inside = on < ends[at]
        key = np.full(len(at), -1, dtype=np.int64)
        key[inside] = rank[on[inside]]
        group = rank[at]
        by = np.argsort(group * (n + 1) + (key + 1))  # both below 2**31
        at, key, group = at[by], key[by], group[by]
        order[active] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        head = active[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = head
        step *= 2
        first = active[new]
        born[first[born[first] == 255]] = count
        count += 1
        single = new & np.append(new[1:], True)
        # suffixes that end at the same length and are equal stay together: they can't be told apart
        stuck = key < 0
        active = active[~single & ~stuck]
    return order, Levels(order, born, count)


def common_prefix(levels: Levels, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of pairs of suffixes, from the ranks at prefix lengths 2**k.

    A rank at level k tells prefixes of 2**k tokens apart only for positions with so many tokens left.
    """
    a, b = a.copy(), b.copy()
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        rank = levels[k]
        again = True
        while again:
            room = np.flatnonzero((a + step <= end_a) & (b + step <= end_b))
            same = room[rank[a[room]] == rank[b[room]]]
            out[same] += step
            a[same] += step
            b[same] += step
            again = k == len(levels) - 1 and len(same) > 0
    return out
