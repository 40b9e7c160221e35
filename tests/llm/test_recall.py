"""Shares of pairs just above the limits that candidate search and give-up tests let through, on seeded pairs."""

import numpy as np
from guildward.llm import embedding_dedup, minhash_dedup


def test_texts_at_the_limit_are_found():
    rng, found, total, bands = np.random.default_rng(11), 0, 0, minhash_dedup.BANDS
    floor = minhash_dedup._Block(80).floor
    for _ in range(3000):
        n, j = int(rng.choice([40, 100, 400, 1500], p=[0.4, 0.3, 0.2, 0.1])), rng.uniform(0.80, 0.82)
        shared = int(np.ceil(2 * n * j / (1 + j)))
        items = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        a, b = np.sort(items[:n]), np.sort(items[n - shared :])
        if 100 * shared < 80 * (2 * n - shared):
            continue
        ra, rb = minhash_dedup.sketch(a), minhash_dedup.sketch(b)
        banded = (ra.reshape(bands, -1) == rb.reshape(bands, -1)).all(1).any()
        _, may = minhash_dedup.estimate(ra[None], rb[None], np.array([n]), np.array([n]), 0.8)
        found += bool(banded and may[0] and (ra == rb).sum() >= floor)
        total += 1
    assert total > 2500 and found / total >= 0.999, (found, total)


def test_vectors_at_the_limit_are_found():
    for dim in (32, 64, 128):
        rng = np.random.default_rng(dim)
        x, z = rng.standard_normal((2, 1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        cos = rng.uniform(0.93, 0.94, (1000, 1))
        y = cos * x + (1 - cos**2) ** 0.5 * z
        code = embedding_dedup.code(dim)
        shared = [len(np.intersect1d(a, b)) for a, b in zip(code.decode(x), code.decode(y), strict=True)]
        assert np.mean(np.array(shared) > 0) >= 0.999


def test_pairs_at_the_limit_do_not_depend_on_their_group():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((40, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    least = float(embedding_dedup.exact(unit[3], unit[17]))
    ids, weights, filters = list(range(40)), [1] * 40, [np.array([5], "<i4").tobytes()] * 40
    for bump, want in ((0.0, True), (1e-15, False)):
        small, large = embedding_dedup._Links(), embedding_dedup._Links()
        pairs = np.array([3, 17])
        embedding_dedup._compare_small(small, 2, np.array([0]), unit[pairs], [3, 17], weights, filters, np.array([5]), least + bump)
        embedding_dedup._compare_large(large, np.arange(40), None, unit, ids, weights, filters, 5, least + bump)
        together = any({a, b} == {3, 17} for a, b in large.edges)
        assert bool(small.edges) is want
        assert large.counts[3] == sum(embedding_dedup.exact(unit[3], unit[k]) >= least + bump for k in range(40) if k != 3)
        assert want or not together
