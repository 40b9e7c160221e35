"""The registered queries themselves, over whole small tables, against brute force."""

import hashlib
import math
import os
import struct
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from guildward.llm import arrow, html_extract, packing, quality_model, quality_rules, queries, secrets_scan, token_files
from guildward.llm.common import WordHash

from tests.llm.test_dedup import brute, closure
from tests.llm.test_small_operators import brute_base, brute_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of a query by their first column."""
    made = {}

    def of(name):
        if name not in made:
            got = queries.queries()[name](spark, SF).collect()
            made[name] = {r[0]: r for r in got}
            assert len(made[name]) == len(got) or name.startswith("op5")
        return made[name]

    return of


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def labels():
    t = pq.read_table(f"{SF}/labels.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["quality"].to_pylist(), strict=True))


def test_op1(rows, texts, labels):
    """Base counts, ratios and verdicts from plain dictionaries over the buckets."""
    got, table = rows("op1_quality_rules"), WordHash()
    hashes = {i: np.array([table[w] for w in arrow.words_of((t or "").encode())], np.uint64) for i, t in texts.items()}
    every = {i: quality_rules.buckets_of(h).tolist() if len(h) else [] for i, h in hashes.items()}
    size, total = quality_rules.MOST_BUCKETS, sum(map(len, every.values()))
    while size > quality_rules.LEAST_BUCKETS and total <= quality_rules.LOAD * (size // 2):
        size //= 2
    raw, good = {}, {}
    trusted = [i for i, q in labels.items() if q == 1 and i in texts]
    for i, grams in every.items():
        for b in grams:
            raw[b % size] = raw.get(b % size, 0) + 1
            if i in set(trusted):
                good[b % size] = good.get(b % size, 0) + 1
    n_good, more = sum(good.values()), sum(good.values()) / total

    def mean(grams, without=None):
        own = {}
        for b in without or []:
            own[b % size] = own.get(b % size, 0) + 1
        out = 0.0
        for b in grams:
            k = b % size
            p = (good.get(k, 0) - own.get(k, 0) + more) / (n_good - len(without or []) + more * size)
            out += math.log(p) - math.log((raw.get(k, 0) + 1) / (total + size))
        return out / len(grams)

    base = {i: brute_base(t) for i, t in texts.items()}
    failed = {i: b[0] < 20 or 100 * b[4] > 30 * b[0] for i, b in base.items()}
    steps = sorted(math.floor(mean(every[i], every[i]) * quality_rules.STEPS) for i in trusted if not failed[i])
    at = lambda q: steps[max(0, math.ceil(q * len(steps)) - 1)] / quality_rules.STEPS
    threshold = at(0.01) - quality_rules.MARGIN * (at(0.5) - at(0.01))
    rejected = 0
    for i in texts:
        r = got[i]
        assert tuple(r[1:6]) == base[i] and r.base_failed == failed[i]
        llr = mean(every[i]) if every[i] else 0.0
        assert abs(r.llr - llr) < 1e-9
        assert r.kept == (not failed[i] and llr >= threshold) or abs(llr - threshold) < 1e-9
        rejected += not r.kept and not failed[i]
    assert len(got) == len(texts) and rejected > 0


def test_op2(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    got = queries.queries()["op2_url_filter"](spark, SF)
    want = con.execute(queries.oracle_sql()["op2_url_filter"])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_op3(rows):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    got = rows("op3_embedding_dedup")
    x = np.array(t["embedding"], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([-1 if v is None else hash(v) for v in t["label"]])
    near = (x @ x.T >= 0.93) & (label[:, None] == label) & (label != -1)
    np.fill_diagonal(near, False)
    low = closure(len(x), list(zip(*np.nonzero(near), strict=True)))
    ids = t["vec_id"]
    for i, v in enumerate(ids):
        component = min(ids[k] for k in range(len(ids)) if low[k] == low[i])
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (near[i].sum(), component, component == v)


def test_op4_and_op9(rows, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(path("word_bpe_49k.json")), 0
    four, nine = rows("op4_bpe"), rows("op9_token_files")
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert tuple(four[i])[1:4] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        whole = packed + struct.pack("<I", token_files.END_ID)
        assert tuple(nine[i])[1:4] == (start, len(ids) + 1, zlib.crc32(whole))
        start += len(ids) + 1
    assert len(four) == len(nine) == len(texts)


def test_op5(spark, texts):
    placed = queries.queries()["op5_best_fit_packing"](spark, SF).collect()
    t = pq.read_table(f"{SF}/documents.parquet")
    source = dict(zip(t["doc_id"].to_pylist(), t["source"].to_pylist(), strict=True))
    bins, length = {}, {}
    for r in placed:
        bins.setdefault(r.bin_id, []).append(r)
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {i: len((x or "").encode().split()) + 1 for i, x in texts.items()}
    same = {i: (x or "").lower().encode().split() for i, x in texts.items()}
    for held in bins.values():
        assert sum(r.length for r in held) <= packing.CAPACITY
        for key in (lambda r: source[r.doc_id], lambda r: b" ".join(same[r.doc_id]) or None):
            seen = [key(r) for r in held if key(r) is not None]
            assert len(seen) == len(set(seen))


def test_op6(rows, texts):
    got = rows("op6_near_duplicates")
    want = brute(sorted(texts.items()), 2, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items()) and not all(r.kept for r in got.values())


def naive_features(text):
    """quality_model.FEATURES by characters and words, one by one."""
    text = text or ""
    data = text.encode()
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    n, size = len(words), max(len(data), 1)
    count = lambda letters: sum(c in letters for c in text)
    upper, letters = sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text)
    lines = text.split("\n")
    return [
        math.log1p(n), count("#*$%&|<>") / size, upper / max(letters, 1), sum("0" <= c <= "9" for c in text) / size, count("!?") / size, count(".,;") / max(n, 1),
        sum(map(len, words)) / max(n, 1), sum(b > 127 for b in data) / size, len(set(words)) / max(n, 1), len(set(words)) / math.sqrt(max(n, 1)),
        sum(len(w.encode()) < 3 for w in words) / max(n, 1), brute_base(text)[3] / len(lines), n / len(lines), text.count("|") / max(n, 1),
    ]


def test_op7(rows, texts, labels):
    got = rows("op7_quality_classifier")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    ids = sorted(i for i in labels if i in texts and not held[i])
    x = {i: np.array(naive_features(t)) for i, t in texts.items()}
    assert all(np.allclose(quality_model.features((t or "").encode()), x[i]) for i, t in texts.items())
    own = np.array([[float(v) for v in quality_model.features((texts[i] or "").encode())] for i in ids])
    model = quality_model.fit(own, np.array([labels[i] for i in ids], float))
    for i, t in texts.items():
        z = model.intercept
        row = [float(v) for v in quality_model.features((t or "").encode())]
        place = lambda edges, v: sum(e <= v for e in edges)
        for edges, table, v in zip(model.edges, model.tables, row, strict=True):
            z += table[place(edges, v)]
        for a, b, table in model.pairs:
            z += table[place(model.coarse[a], row[a]), place(model.coarse[b], row[b])]
        score = 1 / (1 + math.exp(-z))
        assert got[i].held_out == held[i] and abs(got[i].score - score) < 1e-9 and got[i].predicted == (got[i].score >= 0.7)


def test_op7_tells_held_out_rows_apart(spark):
    """On the next larger tables, where some ninety labelled rows are held out."""
    larger = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op7_quality_classifier"](spark, larger).collect()}
    t = pq.read_table(f"{larger}/labels.parquet").to_pydict()
    judged = [(got[i].score, q) for i, q in zip(t["doc_id"], t["quality"], strict=True) if got[i].held_out]
    good, bad = [s for s, q in judged if q == 1], [s for s, q in judged if q == 0]
    assert len(good) > 50 and len(bad) > 10
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([(s >= quality_model.KEEP_FROM) == q for s, q in judged]) > 0.95


def test_op8(rows, texts):
    got = rows("op8_secret_scans")
    for i, t in texts.items():
        spans = brute_spans(t)
        r = got[i]
        kinds = [x.split(":")[0] for x in spans.split(",") if x]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith(secrets_scan.MARKOV)) == spans
    assert sum(bool(r.spans) for r in got.values()) > 0


def test_op10(rows):
    t = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    got = rows("op10_html_extraction")
    for i, url, page in zip(t["page_id"], t["url"], t["html"], strict=True):
        article = page[page.index("<article>") : page.index("</article>")]
        plain = __import__("re").sub(r"\s+", " ", __import__("html").unescape(__import__("re").sub("<[^>]*>", " ", article))).strip()
        assert tuple(got[i])[1:] == (url, html_extract.main_text(page), len(html_extract.main_text(page)))
        assert got[i].text.replace("\n", " ").split() == plain.split()
