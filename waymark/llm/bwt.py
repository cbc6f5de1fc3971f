"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement.

A suffix is followed, ``width`` bytes on, by another suffix of its string; the letter before a suffix is the
``width`` bytes in front of it.  With letters of one byte this is the usual transform of a set of strings; wider
letters need fewer refinements for the same common prefix.  Letters are ranked exactly, without hashes.  Each
string has one terminator for each of its ``width`` chains of suffixes; terminators are all different.

Every shard sorts its own suffixes.  The merge then starts from the shards one after the other and refines that
interleaving: the letters before the suffixes, read in the order so far, deal the shards' entries anew.  After t
refinements all suffixes are in order by t letters, and the blocks of suffixes that agree in t letters are known.
No suffixes are compared with each other again.
"""

from __future__ import annotations

import numpy as np


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of unsigned 32-bit keys, as two radix passes of 16 bits."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and int(x.max()) <= 0xFFFF:
        return low
    return low[np.argsort((x >> 16).astype(np.uint16)[low], kind="stable")]


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit keys."""
    order = np.argsort(keys)
    there = keys[order]
    step = np.empty(len(keys), dtype=np.uint32)
    if len(keys):
        step[0] = 0
        np.not_equal(there[1:], there[:-1], out=step[1:].view(np.uint32), casting="unsafe")
    out = np.empty(len(keys), dtype=np.uint32)
    out[order] = np.cumsum(step, dtype=np.uint32)
    return out


def wide_letters(buf: np.ndarray, width: int) -> np.ndarray:
    """The rank of the ``width`` bytes at each position of ``buf`` (zeros beyond its end).

    Ranks of eight bytes are joined to ranks of twice as many, the last two overlapping as far as they must.
    """
    n, m = len(buf), len(buf) + width
    padded = np.concatenate([buf, np.zeros(width + 8, np.uint8)])
    have = min(8, width)
    key = np.zeros(m, dtype=np.uint64)
    for j in range(have):
        key = (key << np.uint64(8)) | padded[j : j + m]
    out = ranks(key)
    while have < width:
        step = min(have, width - have)
        after = np.concatenate([out[step:], np.full(step, out[-1])])  # the last position holds zeros only
        out = ranks((out.astype(np.uint64) << np.uint64(32)) | after)
        have += step
    return out[:n]


class Shard:
    """Sorted suffixes of some strings: positions, the letter before each, and whose terminators they reach."""

    def __init__(self, letter: np.ndarray, follow: np.ndarray, before: np.ndarray, ids: np.ndarray):
        """``letter``: of each suffix, 0 for terminators; ``follow``: index of the next suffix, own index for
        terminators; ``before``: letter in front, 0 for first suffixes; ``ids``: the suffixes' global numbers."""
        n = len(letter)
        ends = letter == 0
        name = letter.astype(np.uint64) + np.uint64(n)
        name[ends] = np.arange(np.count_nonzero(ends), dtype=np.uint64)  # all different, below all letters
        hop = follow
        while True:  # prefix doubling, for this shard's suffixes only
            pair = np.where(ends, name << np.uint64(32), (name << np.uint64(32)) | name[hop])
            new = ranks(pair).astype(np.uint64)
            hop = hop[hop]
            if int(new.max(initial=0)) == n - 1 or np.array_equal(new, name):
                break
            name = new
        order = np.argsort(new, kind="stable")
        self.ids, self.bwt = ids[order], before[order]


def merge(shards: list[Shard], terminators: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix numbers, shard after shard, and the block of each after ``rounds`` refinements.

    Suffixes of one block agree in ``rounds`` letters.  ``terminators`` counts those of each shard.
    """
    before = np.concatenate([s.bwt for s in shards])
    sizes = [len(s.bwt) for s in shards]
    kind = np.uint8 if len(shards) < 256 else np.uint16
    inter = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    n, n_ends = len(inter), sum(terminators)
    ends = np.repeat(np.arange(len(shards), dtype=kind), terminators)
    block = np.zeros(n, dtype=np.int64)
    for _ in range(rounds):
        place = np.argsort(inter, kind="stable")  # of each shard's entries, in turn
        letters = np.empty(n, dtype=np.uint32)
        letters[place] = before
        order = stable_order(letters)
        # entries with no letter before them lead to the terminators, which have their own fixed order
        rest = order[n_ends:]
        ranked, old = letters[rest], block[rest]
        head = np.ones(n, dtype=np.int64)  # terminators are blocks of their own
        if len(rest) > 1:
            head[n_ends + 1 :] = (ranked[1:] != ranked[:-1]) | (old[1:] != old[:-1])
        inter = np.concatenate([ends, inter[rest]])
        block = np.cumsum(head)
    place = np.argsort(inter, kind="stable")
    return np.concatenate([s.ids for s in shards]), block[place]


def repeated_windows(strings: list[bytes], weights: list[int], length: int, width: int, shard_bytes: int = 1 << 17) -> list[np.ndarray]:
    """For each string, whether the ``length`` bytes at each start occur twice or more in all strings.

    A string of weight 2 or more counts as so many copies of itself.  ``length`` is a multiple of ``width``.
    """
    if length % width:
        raise ValueError("the length must be a multiple of the letters' width")
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return [np.zeros(0, dtype=bool) for _ in strings]
    # a gap of ``width`` zeros ends each string: the last letters of its chains, and its terminators
    gaps = sizes + width
    starts = np.concatenate([[0], np.cumsum(gaps)])
    buf = np.zeros(int(starts[-1]), dtype=np.uint8)
    inside = np.ones(len(buf), dtype=bool)
    for s, at in zip(strings, starts, strict=False):
        buf[at : at + len(s)] = np.frombuffer(s, np.uint8)
        inside[at + len(s) : at + len(s) + width] = False
    letter = wide_letters(buf, width) + np.uint32(1)
    letter[~inside] = 0
    before = np.zeros(len(buf), dtype=np.uint32)
    before[width:] = letter[:-width]  # the gap in front of a string's first suffixes has letter 0
    cuts, held = [0], 0
    for i, g in enumerate(gaps.tolist()):
        held += g
        if held >= shard_bytes or i == len(strings) - 1:
            cuts.append(i + 1)
            held = 0
    shards, ends = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = int(starts[a]), int(starts[b])
        own = np.arange(hi - lo)
        follow = np.where(inside[lo:hi], own + width, own)
        shards.append(Shard(letter[lo:hi], follow, before[lo:hi], np.arange(lo, hi)))
        ends.append((b - a) * width)
    ids, block = merge(shards, ends, length // width)
    of = np.empty(len(buf), dtype=np.int64)
    of[ids] = block
    weight = np.repeat(np.array(weights, dtype=np.int64), gaps)
    left = np.repeat(starts[:-1] + sizes, gaps) - np.arange(len(buf))
    weight[left < length] = 0  # shorter suffixes, padded with zeros, are no windows
    count = np.bincount(of, weights=weight)
    twice = count[of] >= 2
    return [twice[at : at + max(0, len(s) - length + 1)] for s, at in zip(strings, starts, strict=False)]
