import random
from collections import Counter

import numpy as np
import pytest

from waymark.llm.bwt import Shard, merge, repeated_windows, stable_order, wide_letters


def test_stable_order():
    rng = np.random.default_rng(1)
    for top in (10, 70_000, 2**32):
        x = rng.integers(0, top, 5000, dtype=np.uint32)
        assert np.array_equal(stable_order(x), np.argsort(x, kind="stable"))


def test_wide_letters_are_exact_and_ordered():
    rng = random.Random(2)
    buf = np.frombuffer(bytes(rng.choice(b"ab\x00") for _ in range(400)), np.uint8)
    for width in (1, 3, 8, 9, 20):
        b = buf.tobytes() + bytes(width)
        words = [b[i : i + width] for i in range(400)]
        want = {w: i for i, w in enumerate(sorted({*words, bytes(width)}))}
        assert wide_letters(buf, width).tolist() == [want[w] for w in words]


def test_merge_equals_one_sort():
    """With letters of one byte, the merged order is that of all suffixes of all strings."""
    rng = random.Random(3)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(2, 9))]
        shards, ends, suffixes, base = [], [], [], 0
        for lo in range(0, len(strings), 2):
            part = strings[lo : lo + 2]
            letter, follow, before = [], [], []
            for k, s in enumerate(part):
                at = len(letter)
                for i, c in enumerate(s):
                    letter.append(c)
                    follow.append(at + i + 1)
                    before.append(s[i - 1] if i else 0)
                    suffixes.append(s[i:] + bytes([0]) + (lo + k).to_bytes(2))
                letter.append(0)
                follow.append(at + len(s))
                before.append(s[-1])
                suffixes.append(bytes([0]) + (lo + k).to_bytes(2))
            n = len(letter)
            shards.append(Shard(np.array(letter, np.uint32), np.array(follow), np.array(before, np.uint32), np.arange(base, base + n)))
            ends.append(len(part))
            base += n
        ids, block = merge(shards, ends, 30)
        assert len(set(block.tolist())) == base
        assert [suffixes[i] for i in ids[np.argsort(block)]] == sorted(suffixes)


@pytest.mark.parametrize(("length", "width"), [(4, 1), (6, 2), (6, 3), (8, 8), (40, 20)])
def test_repeated_windows(length, width):
    rng = random.Random(length * 100 + width)
    for _ in range(40):
        base = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 200)))
        strings, weights = [], []
        for _ in range(rng.randrange(1, 12)):
            a = rng.randrange(len(base))
            strings.append(base[a : a + rng.randrange(90)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))))
            weights.append(rng.choice([1, 1, 1, 2]))
        seen = Counter()
        for s, w in zip(strings, weights):
            for i in range(len(s) - length + 1):
                seen[s[i : i + length]] += w
        got = repeated_windows(strings, weights, length, width, shard_bytes=rng.choice([1, 60, 1 << 17]))
        for s, g in zip(strings, got):
            assert g.tolist() == [seen[s[i : i + length]] >= 2 for i in range(len(s) - length + 1)]
