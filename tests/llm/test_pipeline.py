import random
import re

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F
from guildward.llm import queries

from tests.llm.test_dedup import brute
from tests.llm.test_small_operators import brute_base

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def tables(spark, folder):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = [sentence(rng.randrange(30, 90)) + "." for _ in range(120)]
    bad = [" ".join(w.upper() + rng.choice(["%%%", "$$$", "!!"]) for w in sentence(60).split()) for _ in range(60)]
    copies = [good[0], good[1] + " end", "token = abcdefghijklmnop " + good[2]]
    texts = good + bad + copies + [None, "", "short text"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(180) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i, *_ in rows if i < 120}
    assert good <= set(seen["quality classifier"]) and not {i for i in range(120, 180)} & set(seen["quality classifier"])
    ruled = seen["quality rules"]
    assert good <= set(ruled)
    for i in ruled:
        n, *_, repeated = brute_base(ruled[i])
        assert n >= 20 and 100 * repeated <= 30 * n
    left = sorted(ruled.items())
    want = {i for i, (_, c) in brute(left, 5, 80).items() if c == i}
    assert set(seen["minhash near-dedup"]) == want and 180 not in want
    clean = seen["secret scans"]
    assert set(clean) == want and not any(re.search("token = [a-z]", t) for t in clean.values())
    assert {i for i in want if clean[i] != ruled[i]} <= {182}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == want
    assert sum(r.length for r in out) == sum(len(t.split()) + 1 for t in clean.values())


def test_repeated_rows_of_an_id(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, "other " * 30, "en", "s", 1), (None, text, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"]


def test_other_texts_of_an_id_and_clashing_columns(spark, tmp_path):
    """An id is one document, whatever its rows say; columns called like results stay as they are."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, c, "en", "s", 3), (3, c + " end", "en", "t", 4), (4, None, None, None, None), (None, a, "en", "s", 5)]
    df = spark.createDataFrame(rows, DOCS)
    own = ["score", "predicted", "n_words", "kept", "llr", "spans", "base", "c0", "id", "_id", "row", "n", "digest", "KEPT_"]
    df = df.select("*", *[F.lit(0.25).alias(x) for x in own])
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "4", "None"]
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, str(tmp_path))
        assert after.columns == df.columns and all(r[x] == 0.25 for r in after.collect() for x in own)
    assert corpus_pipeline.best_fit(spark, df, "").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.queries()) <= set(names) and "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
