"""Packing's plan against the lower bound and best-fit decreasing, over histograms of several shapes."""

import math

import numpy as np

from plumbline.llm import packing


def shapes():
    rng = np.random.default_rng(1)
    return {
        "uniform": rng.integers(1, 2048, 20_000),
        "lognormal": np.clip(rng.lognormal(6, 0.9, 100_000).astype(int), 1, 2047),
        "few": np.clip(rng.lognormal(6, 0.9, 700).astype(int), 1, 2047),
        "thirds": np.repeat([700, 683, 1365, 341], [500, 200, 100, 50]),
        "halves": np.repeat([1025], [300]),
        "one": np.array([5]),
    }


def test_no_plan_needs_more_than_best_fit_decreasing():
    for name, lengths in shapes().items():
        sizes, demand = np.unique(lengths, return_counts=True)
        configs = packing.plan(dict(zip(sizes.tolist(), demand.tolist())), 2048)
        assert all(sum(s * n for s, n in c.items()) <= 2048 for c, _ in configs)
        placed = {int(s): 0 for s in sizes}
        for c, t in configs:
            for s, n in c.items():
                placed[s] += n * t
        assert placed == dict(zip(sizes.tolist(), demand.tolist())), name
        used = sum(t for _, t in configs)
        assert used <= sum(t for _, t in packing.best_fit(sizes, demand, 2048)), name
        if name in ("lognormal", "few"):
            assert used <= 1.0005 * math.ceil(lengths.sum() / 2048) + 1
    assert packing.plan({}) == []


def test_program_places_most_of_dense_histograms():
    lengths = shapes()["lognormal"]
    sizes, demand = np.unique(lengths, return_counts=True)
    found, left = packing.rounded_program(sizes, demand, 2048)
    assert 1 - left.sum() / demand.sum() > 0.8
    assert all(sum(s * n for s, n in c.items()) == 2048 for c, _ in found)


def test_exact_fill_is_the_best_subset():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = sorted(set(rng.integers(1, 60, rng.integers(1, 7)).tolist()))
        left = rng.integers(0, 4, len(sizes)).tolist()
        left[-1] += 1
        sums = {0}
        for k, s in enumerate(sizes):
            sums = {x + s * n for x in sums for n in range(left[k] - (k == len(sizes) - 1) + 1)}
        got = packing.exact_fill(sizes, left, len(sizes) - 1, 100)
        assert all(n <= left[k] for k, n in got.items())
        assert sum(sizes[k] * n for k, n in got.items()) == sizes[-1] + max(x for x in sums if x <= 100 - sizes[-1])
