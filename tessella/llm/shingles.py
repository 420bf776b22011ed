"""Hashes of word shingles, for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: One random 64-bit value for each byte; a word's hash is their polynomial in an odd base, modulo 2^64.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20

_powers = np.zeros(0, np.uint64)
_inverse = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, _CHUNK + (1 << 17))
        _powers, _inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (lower case for A-Z) of all texts, and where each text's words begin (one more at the end)."""
    joined = b"\n".join(texts).translate(_LOWER) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    _grow(len(b) + 1)
    inside = np.zeros(len(b) + 1, np.int8)
    inside[1:] = ~_BLANK[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers[: len(b)], out=total[1:])
    words = mix((total[end] - total[start]) * _inverse[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(start, begins)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; of fewer words, the whole sequence is one."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _CHUNK):
            size += len(texts[j]) + 1
            j += 1
        words, at = word_hashes(texts[i:j])
        n = max(len(words) - k + 1, 0)
        all_ = np.full(n, k, np.uint64)
        for w in range(k):
            all_ = mix(all_ * np.uint64(_BASE) + words[w : w + n])
        for a, e in zip(at[:-1].tolist(), at[1:].tolist()):
            if e - a >= k:
                s = all_[a : e - k + 1].copy()
                s.sort()
                yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
            elif e > a:
                h = np.full(1, e - a, np.uint64)
                for w in range(a, e):
                    h = mix(h * np.uint64(_BASE) + words[w : w + 1])
                yield h
            else:
                yield np.zeros(0, np.uint64)
        i = j


def parity(tokens: np.ndarray) -> bytes:
    """One bit for each counter of a power of two near the set's size: whether it holds an odd number of tokens."""
    size = 1 << max(6, (len(tokens) - 1).bit_length())
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the two sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
