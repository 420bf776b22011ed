import numpy as np

from tessella.llm.token_store import expansion_lengths, repair


def test_rounds_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1000, 300, np.uint32)
    ids = np.concatenate([x for _ in range(40) for x in (passage, rng.integers(0, 1000, 5, np.uint32))])
    symbols, rules = repair(ids, 1000)
    pairs = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)[1]
    assert pairs.max() < 16
    lengths = expansion_lengths(rules, 1000)
    assert lengths.max() > 16
    out = symbols.tolist()
    while any(x >= 1000 for x in out):
        out = [y for x in out for y in (rules[x - 1000].tolist() if x >= 1000 else [x])]
    assert out == ids.tolist()
