"""Collocations, conversation tries and top-k search against brute force, with bounds so small that every split is taken."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from guildward.llm import collocations, conversation_trie, topk_search
from guildward.tables import Work


# collocations


def brute_frequent(rows, least, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return {k: v for k, v in f.items() if v >= least}, n


def brute_collocations(rows, least=10, longest=3, inside=50):
    f, n = brute_frequent(rows, least, longest)
    out = set()
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        scores = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(scores)
        around = [g for (o, x), g in f.items() if o == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if not any(100 * g >= inside * a for g in around):
            out.add((lang, " ".join(w), len(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score, k))
    return out


def random_texts(seed, n=150):
    r = random.Random(seed)
    words = ["the", "The", "a", "à", "x1", "of", "of\x01", "i\x00", "中文", "z-z", "ß"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(r.randrange(40)))
        rows.append((text, r.choice(["en", "en", "en", "de", None])))
    rows += [(None, "en"), ("", "fr"), (" \t.", None), ("of the a " * 400, "en"), ("Of the A", "de")] + [("the same row", "en")] * 12
    return rows


@pytest.mark.parametrize("longest,most,held", [(3, 10**6, 10**6), (3, 3, 50), (4, 5, 200), (2, 1, 30)])
def test_collocations(spark, longest, most, held):
    rows = random_texts(longest)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.collocations(docs, 6, longest, most=most, held=held).collect()
    assert {tuple(r) for r in got} == brute_collocations(rows, 6, longest) and len(got) == len({tuple(r)[:2] for r in got})


def test_collocations_of_a_long_text_in_parts(spark):
    """One text of several parts and hand-overs; no occurrence at a seam is lost or counted twice."""
    r = random.Random(5)
    rows = [(" ".join(r.choice(["ab", "cd", "ef.", "Gh"]) for _ in range(600_000)), "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    every, totals = collocations.frequent(docs, 1000, held=70_001)
    want, n = brute_frequent(rows, 1000, 3)
    assert {(x.lang, tuple(x.phrase.split(" "))): x.f for x in every.collect()} == want and totals.first().n == n["en"]


def test_collocations_without_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string, phrase string, N long")
    assert collocations.top(collocations.collocations(empty)).count() == 0
    clash = spark.createDataFrame([("a b. " * 20, None, "x", 1)], "text string, lang string, Phrase string, n long")
    assert [tuple(r)[:4] for r in collocations.collocations(clash).collect()] == [("und", "a b", 2, 20)]


def test_top_order(spark):
    rows = [("en", p, 2, a, 9, 9, 99, s, 1) for p, a, s in [("b b", 5, 7), ("a b", 5, 7), ("é a", 6, 7), ("z z", 1, 8), ("q q", 1, 1)]]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l long, r long, n long, score long, cut int")
    assert [r.phrase for r in collocations.top(df, 4).orderBy("rank").collect()] == ["z z", "é a", "a b", "b b"]


def test_scores_beyond_64_bits(spark):
    """The decimal product of counts is exact where a long would overflow."""
    a, left, right = 9_000_000_001, 9_000_000_007, 9_000_000_011
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(*[f"cast({c} as decimal(14,0)) {c}" for c in "alr"])
    got = df.selectExpr("cast((a * a * cast(1000000 as decimal(7,0))) div (l * r) as long) x").first().x
    assert got == 1_000_000 * a * a // (left * right)


# conversation tries


def brute_trie(convs):
    """convs: id -> list of (role, text), rebuilt."""
    members = defaultdict(list)
    for c, p in convs.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        up = min(members[p[:-1]]) if p else None
        out[min(cs), len(p)] = (up, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[: (h := conversation_trie.head_length(c))] + v[h:] for c, v in own.items()}


def as_nodes(df):
    got = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def random_conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 230), -101, -100, -5, 10**12, 10**12 + 1]:
        for t in range(r.choice([0, 1, 2, 4, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "héé", "long " * 5])))
    rows += [(7000 + i, t, "user", "copy") for i in range(40) for t in range(7)]  # copies
    rows += [(8000 + i, t, "u", "shared" if t < 12 else f"{i % 7}{t}") for i in range(40) for t in range(15)]  # a long way in common
    rows += [(9000 + i, t, "u", "comb") for i in range(12) for t in range(i)]
    rows += [(None, 1, "u", "nobody"), (300, None, "u", "null first"), (300, -1, "u", "b"), (300, 3, "u", "tie"), (300, 3, "u", "tie"), (300, 3, "u", "eit")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [8, 10**6])
def test_trie(spark, most):
    rows = random_conversations(3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert as_nodes(conversation_trie.rebuilt_trie(df, most)) == brute_trie(brute_rebuilt(rows))


def test_trie_without_rebuilding(spark):
    rows = [(c, t, "u", x) for c, p in enumerate(["ab", "ab", "abc", "ad", "x", "x"]) for t, x in enumerate(p)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = {c: [("u", x) for x in p] for c, p in enumerate(["ab", "ab", "abc", "ad", "x", "x"])}
    assert as_nodes(conversation_trie.conversation_trie(df, 2)) == brute_trie(convs)


def test_trie_edges(spark):
    ddl = "conv_id long, turn long, role string, text string, depth string, PATH int"
    assert conversation_trie.rebuilt_trie(spark.createDataFrame([], ddl)).count() == 0
    turnless = [c for c in range(1, 99) if conversation_trie.head_length(c) >= 1][0]
    one = conversation_trie.rebuilt_trie(spark.createDataFrame([(turnless, 0, "u", "gone", "x", 1)], ddl))
    digest = hashlib.sha256(str(turnless).encode()).hexdigest()
    assert as_nodes(one) == {(turnless, 0): (None, 1, 0, 1, 0, digest)}


def test_long_conversation(spark):
    """One conversation of very many turns is a chain, whatever the bound of a task."""
    df = spark.range(30_000).selectExpr("0L conv_id", "id turn", "'u' role", "cast(id as string) text")
    got = as_nodes(conversation_trie.conversation_trie(df, 1000))
    assert len(got) == 30_001 and all(v[1:5] == (1, int(d < 30_000), 1, 0) for (_, d), v in got.items())


# top-k search


def brute_topk(rows, k=5, every=50):
    valid = []
    for i, v in rows:
        if i is None or v is None or None in v or not all(math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) if math.isfinite(256 * x) else None for x in v]
        if None not in v:
            valid.append((i, v))
    out = []
    for q in {(i, tuple(v)) for i, v in valid if i % every == 0}:
        end = 2**63
        scores = [(max(-end + 1, min(end - 1, sum(a * b for a, b in zip(q[1], v, strict=True)))), i) for i, v in valid if i != q[0] and len(v) == len(q[1])]
        out += [(q[0], n + 1, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def random_vectors(seed, n=600, dim=8):
    g = np.random.default_rng(seed)
    rows = [(int(i), (g.normal(size=dim) * g.choice([0.01, 1, 1, 3])).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim) for i in range(150)]  # a group of equal vectors
    near = g.normal(size=dim)
    rows += [(2000 + i, (near + g.normal(size=dim) * 0.02).tolist()) for i in range(150)]
    rows += [(3000, None), (3001, [None] + [1.0] * (dim - 1)), (3002, [math.nan] * dim), (3050, [math.inf] * dim), (None, [1.0] * dim), (3100, [0.0] * dim), (3150, [])]
    rows += [(3151, []), (3200, [1.0, 2.0]), (3201, [2.0, 1.0]), (50, rows[50][1]), (51, rows[51][1]), (100, [0.25] * dim), (-50, [-1.0] * dim)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_topk(spark, seed, monkeypatch):
    rows = random_vectors(seed)
    monkeypatch.setattr(topk_search, "STRIPE_BUCKETS", 2)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 700)
    monkeypatch.setattr(topk_search, "BUCKET_BYTES", 2000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = Work(spark).table(topk_search.prepare(df))
    got = topk_search.search(v, v.where("vec_id % 50 = 0")).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows)


def test_topk_of_very_large_components(spark):
    rows = [(i, [float(10 ** (i % 17)), -3.5, i * 1e9, 1e300 if i == 7 else 1.0]) for i in range(101)] + [(200, [1e308] * 4)]
    v = Work(spark).table(topk_search.prepare(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = topk_search.search(v, v.where("vec_id % 50 = 0")).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(rows)


def test_topk_empty(spark):
    v = Work(spark).table(topk_search.prepare(spark.createDataFrame([], "vec_id long, embedding array<float>, score int")))
    assert topk_search.search(v, v).count() == 0


def test_buckets_prune(spark):
    """A bucket that no query can reach is not multiplied, and a high cosine looks at few vectors of one."""
    g = np.random.default_rng(0)
    unit = g.normal(size=(4000, 32))
    unit = np.floor(unit / np.linalg.norm(unit, axis=1)[:, None] * 1000)
    best = topk_search.Best(np.arange(6), np.repeat(unit[:1], 6, 0), 5)
    best.add(np.arange(10, 20), np.repeat(unit[:1], 10, 0))
    looked = best.looked
    order = np.argsort(-np.linalg.norm(unit[1:], axis=1))
    assert best.add(np.arange(100, 4099), unit[1:][order])
    assert best.looked - looked < 6 * 4000 / 3
    looked = best.looked
    assert not best.add(np.arange(5000, 5100), unit[1:101] / 2) and best.looked == looked


def test_sql_of_splits_by_hash(spark):
    """The SQL's checksum of an id is that of zlib."""
    sql = conversation_trie.OP12_SQL[: conversation_trie.OP12_SQL.index("turns AS (")].rstrip().rstrip(",") + " SELECT * FROM crc"
    con = duckdb.connect()
    con.execute("create view conversations as select i::BIGINT conv_id, 0 turn, '' role, '' text from (values (0), (7), (123456), (-12)) t(i)")
    assert all(h == conversation_trie.head_length(c) for c, h in con.execute(sql).fetchall())
