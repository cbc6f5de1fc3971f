"""Hashed word shingles of whole texts, vectorised over Arrow batches.

ASCII letters are lowered, words are runs of bytes that are not ASCII white space, and a shingle is a run of
``k`` words; a text with fewer words is one shingle, and one without words has none.  Words hash to 64 bits with a
polynomial over random byte values, words beyond LONG_WORD bytes with blake2b; shingles mix the words' hashes.
Two given shingles collide with a probability of about 2^-64, so among the at most 10^9 shingle pairs that one
comparison of two long texts makes, a wrong count has a chance below 10^-10.
"""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK = 1 << 20
LONG_WORD = 1000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _tables:
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(CHUNK + LONG_WORD + 2, b, dtype=np.uint64)
            p[0] = 1
            _tables.append(np.cumprod(p, dtype=np.uint64))
    return _tables


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry at the end)."""
    buf = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    blank = _SPACE[buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    bounds = np.searchsorted(starts, offsets)
    out = np.zeros(len(starts), dtype=np.uint64)
    power, inverse = _powers()
    usual = np.flatnonzero(ends - starts <= LONG_WORD)
    s, e = starts[usual], ends[usual]
    cuts = np.unique(np.searchsorted(s, np.arange(0, len(buf) + CHUNK, CHUNK)))
    for a, b in zip(cuts, cuts[1:], strict=False):
        base = s[a]
        part = buf[base : e[b - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        out[usual[a:b]] = (total[e[a:b] - base] - total[s[a:b] - base]) * inverse[s[a:b] - base]
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out), bounds


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, bounds = word_hashes(texts)
    acc = h
    for j in range(1, k):
        acc = mix(acc[: max(0, len(h) - j)] * _STEP + h[j:])
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            x = h[a : a + 1]
            for j in range(a + 1, b):
                x = mix(x * _STEP + h[j : j + 1])
            out.append(mix(x ^ np.uint64((int(b - a) * int(_STEP)) % 2**64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
