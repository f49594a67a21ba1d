"""Draws from populations beyond numpy's limit, against exact probabilities."""

from fractions import Fraction
from math import comb

import numpy as np
import pytest

from folioforge.llm import sharding


@pytest.mark.parametrize("good, bad, drawn", [(30, 40, 25), (1, 50, 10), (50, 1, 10), (5, 5, 10), (0, 9, 4), (9, 0, 4), (7, 7, 0), (200, 3, 199)])
def test_weights_are_the_probabilities(good, bad, drawn):
    at, up, down = sharding._weights(good, bad, drawn, step=3)
    total = 1 + up.sum() + down.sum()
    got = {at: 1 / total} | {at + 1 + i: w / total for i, w in enumerate(up)} | {at - 1 - i: w / total for i, w in enumerate(down)}
    want = {x: Fraction(comb(good, x) * comb(bad, drawn - x), comb(good + bad, drawn)) for x in range(max(0, drawn - bad), min(drawn, good) + 1)}
    assert set(got) == set(want) and all(abs(got[x] - float(p)) < 1e-12 for x, p in want.items())


def test_large_populations():
    g = np.random.Generator(np.random.PCG64(1))
    good, bad, drawn = 3 * 10**12, 7 * 10**12, 10_000
    at, up, down = sharding._weights(good, bad, drawn)
    total = 1 + up.sum() + down.sum()
    mean = (at + (np.arange(1, len(up) + 1) * up).sum() / total - (np.arange(1, len(down) + 1) * down).sum() / total)
    assert abs(mean - 3000) < 1e-6 and abs(1 / total - 1 / np.sqrt(2 * np.pi * 10_000 * 0.3 * 0.7)) < 1e-6
    draws = np.array([sharding._hypergeometric(g, good, bad, drawn) for _ in range(3000)])
    assert abs(draws.mean() - 3000) < 4 * np.sqrt(2100 / 3000) and abs(draws.var() / 2100 - 1) < 0.12
    matrix = sharding.communication_matrix([2 * 10**9, 3 * 10**9, 0, 7], 3, 5)
    assert matrix.sum(axis=1).tolist() == [2 * 10**9, 3 * 10**9, 0, 7] and np.ptp(matrix.sum(axis=0)) <= 1
