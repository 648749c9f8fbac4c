"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 5
MASK = (1 << 64) - 1
BLOCK = 1 << 18

_rng = np.random.default_rng(20240229)
#: A random value for every byte, A-Z as a-z.
_BYTE = _rng.integers(1, MASK, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = _rng.integers(1, MASK, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64, for i < n."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts in order, and the index of the first word of each text
    (with the number of words at the end). Words are runs without space, tab or line ends."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(BASE, len(data)), dtype=np.uint64, out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * _powers(pow(BASE, -1, 1 << 64), len(data))[starts])
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return words, first


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` words. A text of fewer
    words has one, of all of them; a text without words has none."""
    words, first = word_hashes(texts)
    count = max(0, len(words) - size + 1)
    runs = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        runs += words[k : k + count] * _ODD[k]
    runs = mixed(runs)
    out = []
    for start, end in zip(first[:-1], first[1:], strict=True):
        if end - start >= size:
            out.append(np.unique(runs[start : end - size + 1]))
        else:
            few = words[start:end]
            odd = _ODD[size + 1 + len(few)]
            out.append(mixed((few * _ODD[: len(few)]).sum(dtype=np.uint64, keepdims=True) ^ odd) if len(few) else few)
    return out


def batches(texts, limit: int = BLOCK):
    """(first row, texts as bytes) of runs of rows that hold about ``limit`` bytes; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield start, held
