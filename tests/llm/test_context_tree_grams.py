"""The distinct grams of a chunk are found by a sort in place."""

import numpy as np

from cairn.llm import context_tree


def test_sorted_once_is_unique():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 5000):
        grams = rng.integers(0, 1 << 60, n) % max(1, n // 2)
        want = np.unique(grams)
        assert (context_tree.sorted_once(grams) == want).all() and len(want) == len(context_tree.sorted_once(want.copy()))
