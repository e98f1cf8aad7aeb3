"""Quality rules with a suffix-array repetition limit.

Each text is split into words. A suffix array over the words of each text gives, through the common
prefixes of neighbouring suffixes, every repeated run of words; the union of the runs of at least
`min_repeat` words is the covered part. A text fails if it covers too large a share, or if one repeat is
too long, both relative to the text. Every text is judged alone, so nothing is shuffled.

Null and empty texts have no words and fail the base rule. Columns of the input with names of the
result don't matter: only the id and the text are read. Repeated rows give repeated results; an empty table gives none.
A very long text needs about 60 bytes a word, however repetitive it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A

#: Fixed values of the contract.
SYMBOLS = A.byte_set(b"#*$%&|<>")
MIN_WORDS = 50
WINDOW = 3

#: Parameters of the repetition rule: a repeat counts from this many words; a text fails if repeats cover more than this share of it, or if one repeat is longer than this many words and than this share.
MIN_REPEAT = 10
#: The base rule already fails texts half of which is repeated, and two copies cover twice a repeat's share; both limits lie well below that, so each rejects texts of its own.
MAX_COVERED_PERCENT = 30
MAX_LONGEST = 200
MAX_LONGEST_PERCENT = 10

#: Bytes of text at a time: what bounds a worker's memory.
_CHUNK = 1 << 19
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def _duplicate_lines(chunk: A.Chunk, prefix: np.ndarray, blank_before: np.ndarray) -> np.ndarray:
    n = chunk.last - chunk.first
    breaks = np.flatnonzero(chunk.data == 10)
    start = np.union1d(chunk.offsets[:-1], breaks + 1)
    row = np.minimum(chunk.row_of(start), n - 1)
    # of texts that start at the same place all but the last are empty; row_of gives the last
    end = np.minimum(np.append(start[1:], len(chunk.data)), chunk.offsets[row + 1])
    stop = end - ((end > start) & (chunk.data[np.maximum(end - 1, 0)] == 10)) if len(chunk.data) else end
    worded = blank_before[stop] - blank_before[start] < stop - start
    start, stop, row = start[worded], stop[worded], row[worded]
    key = A.mix(A.span_hash(prefix, start, stop) + A.mix(row.astype(np.uint64)))
    by = np.lexsort((start, key))
    again = np.zeros(len(key), dtype=bool)
    again[1:] = key[by][1:] == key[by][:-1]
    return np.bincount(row[by][again], minlength=n)


def measure(chunk: A.Chunk, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of the texts of a chunk."""
    n = chunk.last - chunk.first
    data = chunk.data
    prefix = A.prefix_hash(data)
    blank = A.BLANK[data]
    blank_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(blank, out=blank_before[1:])
    w = A.words(chunk)
    out = {
        "n_words": np.diff(w.bounds),
        "word_chars": chunk.sums(~blank & ((data & 0xC0) != 0x80)),
        "n_symbols": chunk.sums(SYMBOLS[data]),
        "n_dup_lines": _duplicate_lines(chunk, prefix, blank_before),
    }
    total = len(w.hash)
    own = A.mix(w.hash + A.mix(w.row.astype(np.uint64)))  # the same word of another text is another token
    ends = w.bounds[w.row + 1] if total else np.zeros(0, np.int64)
    hit = np.zeros(total + 1, dtype=np.int64)
    if total >= WINDOW:
        whole = np.flatnonzero(np.arange(total) + WINDOW <= ends)
        sums = A.prefix_hash(own)
        starts = whole[_repeated(A.span_hash(sums, whole, whole + WINDOW))]
        hit[starts] += 1
        np.subtract.at(hit, np.minimum(starts + WINDOW, total), 1)
    out["n_repeat_words"] = np.bincount(w.row, weights=np.cumsum(hit)[:total] > 0, minlength=n).astype(np.int64)

    covered, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if total:
        order, levels = A.suffix_ranks((own >> np.uint64(1)).astype(np.int64), w.row, ends)
        # only neighbours that agree on as many words as the levels under min_repeat can share enough
        level = min(len(levels) - 1, max(0, min_repeat.bit_length() - 1))
        rank = levels[level]
        near = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
        a, b = order[near], order[near + 1]
        length = A.common_prefix(levels, a, b, ends[a], ends[b])
        enough = length >= min_repeat
        a, b, length = a[enough], b[enough], length[enough]
        start = np.concatenate([a, b])
        length = np.concatenate([length, length])
        by = np.argsort(start, kind="stable")
        start, length = start[by], length[by]
        lo, hi = A.union_lengths(start, start + length)  # a repeat never leaves its text
        cover = np.zeros(total + 1, dtype=np.int64)
        np.add.at(cover, lo, 1)
        np.subtract.at(cover, hi, 1)
        covered = np.bincount(w.row, weights=np.cumsum(cover)[:total] > 0, minlength=n).astype(np.int64)
        np.maximum.at(longest, w.row[start], length)
    out["n_covered_words"], out["longest_repeat"] = covered, longest
    return out


def quality_rules(
    docs: DataFrame,
    min_repeat: int = MIN_REPEAT,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
    max_longest_percent: int = MAX_LONGEST_PERCENT,
    keep_columns: bool = False,
) -> DataFrame:
    """One row per document with its counts and verdict; keep_columns: the input's rows that are kept instead."""
    columns = docs.schema if keep_columns else None

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in A.chunks(batch.column("text"), _CHUNK):
                m = measure(chunk, min_repeat)
                words = m["n_words"]
                failed = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * words)
                longest = m["longest_repeat"]
                repeats = (100 * m["n_covered_words"] > max_covered_percent * words) | (
                    (longest > max_longest) & (100 * longest > max_longest_percent * words)
                )
                kept = ~failed & ~repeats
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                if columns is not None:
                    yield part.filter(pa.array(kept))
                    continue
                values = [m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, (*values, failed, kept, m["n_covered_words"], longest))],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    if columns is not None:
        return docs.mapInArrow(A.released(judged), columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(A.released(judged), SCHEMA)
