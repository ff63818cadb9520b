"""Keys of the Jaccard join: linked sets share one, unlike sets of a size do not meet under empty or tiny groups."""

from __future__ import annotations

import numpy as np
import pytest

from llm.jaccard_join import group_keys


def keys_of(sets: list[np.ndarray], percent: int) -> list[set[int]]:
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    keys, doc = group_keys(np.concatenate([np.sort(s) for s in sets]), bounds, np.arange(len(sets)), percent)
    return [set(keys[doc == i].tolist()) for i in range(len(sets))]


def some_tokens(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(0, 1 << 63, n).astype(np.uint64)


@pytest.mark.parametrize("percent", [80, 90])
def test_unlike_sets_share_no_key(percent):
    rng = np.random.default_rng(7)
    keys = keys_of([some_tokens(rng, int(n)) for n in rng.integers(200, 220, 400)], percent)
    assert sum(map(len, keys)) == len(set().union(*keys))


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(8)
    for _ in range(400):
        a, b = rng.integers(1, 260, 2)
        if 100 * min(a, b) < percent * max(a, b):
            b = a
        least = -(-percent * (a + b) // (100 + percent))
        common = some_tokens(rng, int(least))
        x, y = (np.concatenate([common, some_tokens(rng, int(n - least))]) for n in (a, b))
        one, other = keys_of([x, y], percent)
        assert least == a == b or one & other
