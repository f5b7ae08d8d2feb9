"""Word shingles of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.random.default_rng(20240229)
_STEP = _MIX.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts with A-Z lower-cased, and where each text's begin (one entry more)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, ends = flat.filter(pa.array(full)), kept[ends]
    coded = flat.dictionary_encode()
    hash64 = xxhash.xxh3_64_intdigest
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(hash64, known), np.uint64, len(known))
    return (hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)), ends


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size consecutive words; entry i begins at word i, whatever text it is in."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _STEP[k]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: of size words; with fewer words, of all of them as one; without words, none."""
    hashes, ends = word_hashes(texts)
    every = rolling(hashes, size)
    sets = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(every[a : b - size + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            sets.append(own)
        elif b > a:
            short = (hashes[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
