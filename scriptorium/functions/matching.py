"""Many strings looked for in many texts at once, byte by byte; the time grows with the texts and not with the number of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(0).integers(0, 2**63, 272, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOL, _STEP, _KEY = _random[:256], _random[256:271], _random[271]
#: Bytes of text that are looked at together; the longest window; bits of a window's hash that are tried first.
_PIECE, _LONGEST, _TRIED = 1 << 20, 64, 20


def _windows(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the window at every place) for widths of 1, 2, 4 and so on."""
    width, h = 1, _SYMBOL[data]
    while len(h):
        yield width, h
        if width == _LONGEST or len(h) <= width:
            return
        h = h[:-width] * _STEP[width.bit_length()] + h[width:]
        width *= 2


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a value is known, its place) in sorted known values."""
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values, place


def _same(data: np.ndarray, at: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether the bytes at each place are those of a string."""
    n, out = rows.shape[1], np.zeros(len(at), bool)
    step = max(1, (1 << 22) // n)
    for lo in range(0, len(at), step):
        out[lo : lo + step] = (data[at[lo : lo + step, None] + np.arange(n)] == rows[which[lo : lo + step]]).all(axis=1)
    return out


class Strings:
    """Distinct strings, as bytes.

    A string is found by the hash of its first window, the widest power of two that fits into it, then by the first and the last window
    together, and is then compared.
    """

    def __init__(self, strings: list[bytes]) -> None:
        size = np.array([len(s) for s in strings], np.int64)
        data, start = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size
        width = np.minimum(2 ** np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), _LONGEST)
        self.empty = np.flatnonzero(size == 0)
        self.widths: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        for w, h in _windows(data):
            own = np.flatnonzero((width == w) & (size > 0))
            if not len(own):
                continue
            first = np.unique(h[start[own]])
            tried = np.zeros(1 << _TRIED, bool)
            tried[first >> np.uint64(64 - _TRIED)] = True
            lengths = []
            for n in np.unique(size[own]):
                alike = own[size[own] == n]
                keys = h[start[alike]] * _KEY + h[start[alike] + n - w]
                order = np.argsort(keys)
                alike = alike[order]
                lengths.append((int(n), keys[order], alike, data[start[alike, None] + np.arange(n)]))
            self.widths[w] = tried, first, lengths

    def found(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, strings): which text holds which string, each pair once."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if len(self.empty):
            rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            yield np.repeat(rows, len(self.empty)), np.tile(self.empty, len(rows))
        whole, lo = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _PIECE, "right")) - 1)
            for rows, strings in self._piece(whole[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]):
                yield rows + lo, strings
            lo = hi

    def _piece(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for w, h in _windows(data):
            if w not in self.widths:
                continue
            tried, first, lengths = self.widths[w]
            at = np.flatnonzero(tried[h >> np.uint64(64 - _TRIED)])
            at = at[_among(h[at], first)[0]]
            row = np.searchsorted(ends, at, "right")
            room = ends[row] - at
            for n, keys, which, rows in lengths:
                inside = room >= n
                a, r = at[inside], row[inside]
                known, k = _among(h[a] * _KEY + h[a + n - w], keys)
                a, pair = a[known], r[known] * len(keys) + k[known]
                pairs, one = np.unique(pair, return_index=True)
                same = _same(data, a[one], rows, pairs % len(keys))
                if not same.all():  # another string of the same hash stands first in a text
                    pairs, same = np.unique(pair[_same(data, a, rows, pair % len(keys))]), slice(None)
                yield pairs[same] // len(keys), which[pairs[same] % len(keys)]
