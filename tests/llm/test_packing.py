import random
from collections import Counter

import pytest

from tessella.llm import packing


def one_by_one(histogram, window):
    """The packs of pieces that are dealt one at a time, longest first, each to the pack filled least."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            least = min(packs, key=sum, default=None)
            if least is None or sum(least) + length > window:
                packs.append([length])
            else:
                least.append(length)
    return Counter(map(sum, packs))


@pytest.mark.parametrize("hot", [{400: 10_000}, {300: 10_000}, {1500: 10_000}, {1: 10_001}, {4096: 10_000}])
@pytest.mark.parametrize("rest", [None, (50, 800), (20, 1500)])
def test_a_hot_length_shares_packs(hot, rest):
    rng = random.Random(3)
    h = Counter(hot)
    if rest:
        h.update(rng.randint(*rest) for _ in range(20_000))
    got = packing.shortest_pack_first(dict(h), 4096)
    used = Counter()
    for count, pattern in got:
        assert sum(pattern) <= 4096
        for n in pattern:
            used[n] += count
    assert used == h
    packs, ids = sum(c for c, _ in got), sum(k * n for k, n in h.items())
    if rest:
        assert ids / (packs * 4096) > 0.99
    else:
        (length, n), = hot.items()
        assert packs == -(-n // (4096 // length))


def test_packs_are_those_of_pieces_dealt_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        window = rng.choice((10, 37, 64))
        h = {rng.randint(1, window): rng.randint(1, 30) for _ in range(rng.randint(1, 6))}
        fills = Counter()
        for count, pattern in packing.shortest_pack_first(h, window):
            fills[sum(pattern)] += count
        assert fills == one_by_one(h, window)
