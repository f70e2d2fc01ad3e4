"""Sets of word shingles as 64-bit hashes, and MinHash signatures of them, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BYTES_AT_ONCE = 1 << 21


def folded_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words each text has."""
    import xxhash

    sizes = np.array([len(t) for t in texts], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, int(sizes.sum())), sizes


def shingles(hashes: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of consecutive texts, and how many each has; a shorter text is one shingle, an empty one none."""
    total, counts = len(hashes), np.where(sizes > 0, np.maximum(sizes - length + 1, 1), 0)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place  # words from here to the end of the text
    out, power = np.zeros(total, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(length, total)):
            out[: total - k] += np.where(left[: total - k] > k, hashes[k:], np.uint64(0)) * power
            power *= _MULTIPLIER
    return mixed(out[place < np.repeat(counts, sizes)]), counts


def distinct_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and how many."""
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[first], np.bincount(of[first], minlength=len(counts))


def shingle_sets(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sets(*shingles(*word_hashes([folded_words(t) for t in texts]), length))


def signatures(values: np.ndarray, counts: np.ndarray, coordinates: int, seed: int = 13) -> np.ndarray:
    """One row per text with shingles: the least value under each of ``coordinates`` orders, mixed with its number."""
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    out = np.empty((len(counts), coordinates), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            shift, odd = rng.integers(0, 2**63, dtype=np.uint64), rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            x = (values ^ shift) * odd
            x ^= x >> np.uint64(32)
            out[:, k] = mixed(np.minimum.reduceat(x, starts) + np.uint64(k + 1) * _MULTIPLIER) if len(counts) else 0
    return out


def by_bytes(texts: pa.Array, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of a column of binaries, of about ``most`` bytes: first row and values."""
    first, part, size = 0, [], 0
    for text in texts:
        text = text.as_py()
        if part and size + len(text) > most:
            yield first, part
            first, part, size = first + len(part), [], 0
        part.append(text)
        size += len(text)
    if part:
        yield first, part
