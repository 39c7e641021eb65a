"""Words of a batch of texts as hashes, all by array operations on the UTF-8 bytes.

A word is a longest run of ASCII letters, digits and non-ASCII characters in the lower-cased text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .fingerprints import U, mix

#: Text bytes taken at once.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
IN_WORD[128:] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        row = np.full(max(n, PIECE + 1), base, U)
        row[0] = 1
        _powers[base] = np.multiply.accumulate(row)
    return _powers[base][:n]


class WordBatch:
    """Start, end, text number and hash of every word of ``texts`` (large_string, no nulls)."""

    def __init__(self, texts: pa.Array):
        texts = pc.utf8_lower(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(self.bytes)
        inside = IN_WORD[self.bytes]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:n]
        closes[:-1] &= ~inside[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.sums = np.zeros(n + 1, U)
        np.cumsum((self.bytes.astype(U) + U(1)) * _power(BASE, n), out=self.sums[1:])
        self.back = _power(INVERSE, n + 1)
        upto = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(upto)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = self.spans(self.starts, self.ends)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes between ``starts`` and ``ends``, the same wherever they stand."""
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes (or all) of every word."""
        return self.spans(self.starts, np.minimum(self.starts + n, self.ends))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every run of ``size`` words; a text with fewer words has one of them all, a text without words none."""
        weight = mix(np.arange(1, size + 1, dtype=U) * U(BASE)) | U(1)
        n = len(self.hashes)
        padded = np.concatenate((self.hashes, np.zeros(size, U)))
        last = np.cumsum(self.counts)
        room = last[self.text] - np.arange(n)  # words of the text from here on
        total = np.zeros(n, U)
        for k in range(size):
            term = padded[k : k + n] * weight[k]
            total += term if k == 0 else np.where(room > k, term, U(0))
        first = np.arange(n) == (last - self.counts)[self.text] if n else np.zeros(0, bool)
        keep = (room >= size) | first
        return mix(total[keep]), self.text[keep]
