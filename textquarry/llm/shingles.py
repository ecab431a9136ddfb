"""Word shingles as 64-bit hashes, computed for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(0x5EED)
# A random number for each byte; A-Z share that of a-z. White space is 09-0D and 20.
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text number of each word) of UTF-8 texts that lie one after the other in `data`.

    A word's hash is that of its bytes as a polynomial over 2**64, from one running sum over the whole buffer."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(n + 1)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1])))
    end = inside & (edge[1:] | np.concatenate((~inside[1:], [True])))
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)))
        h = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(bounds, a, side="right") - 1


def shingle_sets(texts: pa.Array, width: int, slice_bytes: int = 500_000) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order: runs of `width` words, or the whole sequence where there
    are fewer words; none without words or text."""
    texts = texts.cast(pa.large_binary())
    i = 0
    while i < len(texts):
        j, size = i, 0
        lengths = []
        while j < len(texts) and (j == i or size < slice_bytes):
            lengths.append(len(v.as_buffer()) if (v := texts[j]).is_valid else 0)
            size += lengths[-1]
            j += 1
        data = np.frombuffer(b"".join(texts[k].as_py() or b"" for k in range(i, j)), np.uint8)
        bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        h, text = word_hashes(data, bounds)
        first = np.searchsorted(text, np.arange(j - i + 1))
        with np.errstate(over="ignore"):
            grams = np.zeros(max(len(h) - width + 1, 0), np.uint64)
            for k in range(width):
                grams = grams * np.uint64(_BASE) + h[k : k + len(grams)]
            grams = mix(grams)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= width:
                    yield np.unique(grams[a : b - width + 1])
                elif b > a:
                    x = np.uint64(b - a)
                    for v in h[a:b]:
                        x = x * np.uint64(_INVERSE) + v
                    yield mix(np.array([x]))
                else:
                    yield np.zeros(0, np.uint64)
        i = j
