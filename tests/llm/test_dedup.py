import random
import re

import numpy as np
from pyspark.sql import functions as F

from guildward.llm import embedding_dedup, minhash_dedup
from guildward.llm.common import WordHash


def closure(n, links):
    low = list(range(n))
    for _ in range(n):
        before = list(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low
    return low


def brute(rows, width, percent):
    """{doc_id: (size, component)} by all pairs; doc_ids are unique and not null."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    ids, low = [i for i, _ in rows], closure(len(rows), links)
    least = {}
    for i, c in zip(ids, low, strict=True):
        least[c] = min(i, least.get(c, i))
    return {i: (len(s), least[c]) for i, s, c in zip(ids, sets, low, strict=True)}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(150):  # copies of one text with few to many edits: some link, some don't
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [rows[0].upper(), rows[1], rows[2].replace(" ", "\n"), "", None, " ", "one", "ONE", "one two", "two one", "É é", "é é", "x " * 3000, "x " * 2500]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 32)  # several blocks per group
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (2, 5):
        want = brute(rows, width, 80)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, width).collect()}
        assert got == want
        assert len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, None, None), (3, "", "x"), (4, text.upper(), "x"), (5, "other words here", "x"), (5, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_duplicates(df).collect()))
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 1, False), (5, 1, False), (5, 1, False)]
    assert minhash_dedup.near_duplicates(df.where("false")).count() == 0


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2400], np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))])
    sa, sb = minhash_dedup.sketch(a), minhash_dedup.sketch(b)
    assert (minhash_dedup.merge(sa, sb) == minhash_dedup.sketch(np.union1d(a, b))).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got, may = minhash_dedup.estimate(sa[None], sb[None], np.array([len(a)]), np.array([len(b)]), 0.8)
    assert abs(got[0] - true) < 0.08 and minhash_dedup.estimate(sa[None], sa[None], np.array([9]), np.array([9]), 0.8)[1][0]
    far = minhash_dedup.sketch(np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)))
    assert not minhash_dedup.estimate(sa[None], far[None], np.array([len(a)]), np.array([3000]), 0.8)[1][0] and may is not None
    assert len(minhash_dedup.shingle_set(b"A b a B", 2, WordHash())) == 2


def brute_vectors(rows, least=0.93):
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    label = np.array([c for _, _, c in rows])
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    low = closure(len(rows), list(zip(*np.nonzero(near), strict=True)))
    ids = [i for i, _, _ in rows]
    return {ids[i]: (int(near[i].sum()), min(ids[k] for k in range(len(rows)) if low[k] == low[i])) for i in range(len(rows))}


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 24)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(32)
    rows = [(int(i), (centre + 0.28 * rng.standard_normal(32)).tolist(), int(i) % 2) for i in rng.permutation(200)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(30)] + [(2000 + i, rng.standard_normal(32).tolist(), 0) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    want = brute_vectors(rows)
    assert got == want and sum(n for n, _ in want.values()) > 500


def test_near_vectors_odd_rows(spark):
    one = [1.0] * 8
    rows = [
        (1, one, 1), (2, [2.0] * 8, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [1.0, None] * 4, 1), (8, [float("nan")] * 8, 1),
        (9, [float("inf")] * 8, 1), (10, [], 1), (11, [1.0] * 4, 1), (None, one, 1), (12, [1e300] * 8, 1), (13, one, 1), (13, one, 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("mine"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup.near_vectors(df).collect())
    linked = {(1, 4, 1), (2, 4, 1), (12, 4, 1), (13, 4, 1)}
    assert set(got) == linked | {(i, 0, i) for i in (0, 3, 4, 5, 6, 7, 8, 9, 10, 11)} and len(got) == len(rows)
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0
