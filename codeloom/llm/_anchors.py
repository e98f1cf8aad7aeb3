"""Windows of a fixed length grouped by their anchor.

A window's anchor is its run of `gram` tokens with the least hash, the leftmost of equals. Equal windows
have the same anchor at the same place, so only windows with the same anchor can be equal. Neighbouring
windows of a text that share an anchor make one stretch; there is about one for (length - gram) / 2 tokens, so
stretches are much fewer than windows, and equal stretches hold equal windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import _arrays as A

_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_BLOCK = 1 << 23


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


@dataclass
class Stretches:
    """row: text; first: its first window's token within the text; count: windows; anchor and content: hashes."""

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def stretches(prefix: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> Stretches:
    """All stretches of windows of `length` tokens. prefix: hash sums of the tokens; bounds: first token of each text."""
    n = len(prefix) - 1
    sizes = np.diff(bounds)
    ends = np.repeat(bounds[1:], sizes)
    out = []
    for base in range(0, max(n - length + 1, 0), _BLOCK):
        stop = min(n, base + _BLOCK + length - 1)
        start = np.arange(base, stop - gram + 1)
        hashes = A.span_hash(prefix, start, start + gram)
        key = (hashes & ~_PLACE) | (start - base).astype(np.uint64)
        least = sliding_min(key, length - gram + 1)
        window = np.arange(base, base + len(least))
        whole = window + length <= ends[window]
        window, place = window[whole], (least[whole] & _PLACE).astype(np.int64) + base
        if not len(window):
            continue
        new = np.ones(len(window), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(window)))
        out.append((window[first], count, hashes[place[first] - base]))
    if not out:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none, none)
    first, count, anchor = (np.concatenate(x) for x in zip(*out))
    row = np.searchsorted(bounds, first, side="right") - 1
    content = A.span_hash(prefix, first, first + count - 1 + length)
    return Stretches(row, first - bounds[row], count, anchor.view(np.int64), content.view(np.int64))
