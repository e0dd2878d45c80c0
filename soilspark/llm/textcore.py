"""Words and shingles of whole Arrow text columns as numpy arrays.

A word is a run of digits, letters A-Z (lower-cased) or characters beyond ASCII; everything else
separates. Work goes over the UTF-8 bytes of many texts at once, so no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_500_000  # text handled at once; a longer single text makes a chunk of its own
SEGMENT_BYTES = 1 << 19  # of these the bytes that are hashed at once

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3 * 2 + 0x5851F42D4C957F2D | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_VALUE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)[_LOWER] | np.uint64(1)
_HASHED = np.where(_WORD, _VALUE, np.uint64(0))  # separators add nothing to a word's hash
_powers = np.cumprod(np.full(1024, _BASE, dtype=np.uint64))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _BASE, dtype=np.uint64))
    return _powers


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes."""
    if not len(texts):
        return
    ends = np.cumsum(lengths(texts))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more entry than texts)."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Hashes of the words of several texts. ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, texts: pa.Array):
        data, at = raw(texts)
        inside = _WORD[data]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        begins = at[:-1][(at[:-1] < at[1:])]
        head[begins] = inside[begins]  # a word never spans two texts
        last = inside.copy()
        last[:-1] &= ~inside[1:] | head[1:]
        self.start_byte = np.flatnonzero(head)
        end = np.flatnonzero(last) + 1
        self.size = end - self.start_byte
        self.hash = np.zeros(len(end), dtype=np.uint64)
        powers = _powers_to(int(self.size.max()) + 1 if len(end) else 1)
        cuts = np.unique(np.append(np.searchsorted(self.start_byte, np.arange(0, len(data), SEGMENT_BYTES)), len(end)))
        for p, q in zip(cuts, cuts[1:], strict=False):  # a few words' bytes at once, however long the texts are
            begin = self.start_byte[p:q]
            s, e = int(begin[0]), int(end[q - 1])
            within = np.arange(s, e) - np.repeat(begin, np.diff(np.append(begin, e)))
            terms = _HASHED[data[s:e]] * powers[np.minimum(within, len(powers) - 1)]
            self.hash[p:q] = mix64(np.add.reduceat(terms, begin - s))
        self.data, self.at = data, at
        self.first = np.searchsorted(self.start_byte, at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of ``k`` words, and the text of each. A text of fewer words, but not none, is one shingle."""
        n = self.counts()
        doc = np.repeat(np.arange(len(n)), n)
        left = self.first[1:][doc] - np.arange(len(doc)) if len(doc) else doc  # words from here to the end of the text
        short = n < k
        width = np.minimum(n[doc], k)
        keep = (left >= width) & (~short[doc] | (np.arange(len(doc)) == self.first[:-1][doc]))
        out = np.zeros(len(doc), dtype=np.uint64)
        padded = np.concatenate([self.hash, np.zeros(k, dtype=np.uint64)])
        for j in range(k):
            step = padded[j : j + len(doc)] + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)
            out = np.where(j < width, (out ^ step) * _BASE + (step >> np.uint64(29)), out)
        return mix64(out[keep]), doc[keep]
