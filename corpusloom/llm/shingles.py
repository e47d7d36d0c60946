"""Word shingles, their sets and circulant MinHash signatures of one text, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _ODD[1]
    x = (x ^ (x >> _U(27))) * _ODD[2]
    return x ^ (x >> _U(31))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; of a text of fewer words, of the whole sequence.

    A-Z count as lower case; words are runs outside space and \\t..\\r. Without words: empty.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    code = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        code = mix(code * _ODD[0] + h[i : i + len(code)])
    return np.unique(code)


def set_key(codes: np.ndarray) -> bytes:
    """128 bits that equal sets share: two sums over differently mixed elements."""
    with np.errstate(over="ignore"):
        return np.array([mix(codes + _ODD[0]).sum(dtype=np.uint64), mix(codes ^ _ODD[1]).sum(dtype=np.uint64)], ">u8").tobytes()


def circulant_minhash(codes: np.ndarray, k: int) -> np.ndarray:
    """k signature coordinates from two permutations of 32-bit places.

    The first permutation (mix, cut to 32 bits) scatters the set's elements; the second, a bijection of 32-bit
    integers, ranks places; coordinate i is the least rank after shifting all places circularly by i.
    """
    place = (mix(codes ^ _ODD[2]) >> _U(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    shift = np.arange(k, dtype=np.uint32)[:, None]
    for i in range(0, len(place), 1024):
        x = place[None, i : i + 1024] - shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(1), out=out)
    return out


def band_codes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit code for each band of so many coordinates; it depends on the band's number."""
    bands = signature.reshape(-1, rows).astype(np.uint64)
    code = np.arange(1, len(bands) + 1, dtype=np.uint64) * _ODD[0]
    for i in range(rows):
        code = mix(code + bands[:, i])
    return code.view(np.int64)
