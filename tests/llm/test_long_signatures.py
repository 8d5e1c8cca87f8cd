"""The long signatures of near duplicates: small, and as good a filter as whole minima."""

import numpy as np

from revtables.llm import near_duplicates as near


def test_four_bits_tell_sets_apart():
    dice = np.random.default_rng(1)
    least = near.agreeing(near.alike(0.85), near.LONG)

    def met(similarity: float) -> int:
        both = round(2 * 1000 * similarity / (1 + similarity))
        pool = dice.integers(0, 1 << 63, 2 * 1000 - both, dtype=np.uint64)
        packed = [near.long_signature(x).tobytes() for x in (pool[:1000], pool[-1000:])]
        assert {len(x) for x in packed} == {near.LONG // 2}
        a, b = near.long_values(packed)
        assert a.max() < near.VALUES
        return np.count_nonzero(a == b)

    assert min(met(0.86) for _ in range(100)) >= least
    assert max(met(0.65) for _ in range(100)) < least


def test_signatures_of_no_sets():
    assert near.long_values([]).shape == (0, near.LONG)
