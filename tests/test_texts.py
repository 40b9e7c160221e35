"""Texts are joined last: what is dealt out grows with the contents, not with how often they are posted."""

import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from guildward.config import Config
from guildward.operators import identity
from guildward.plans import decisions
from guildward.tables import Work

RULES = [(1, "g", "sensitive", "bad", True), (2, "g", "redline", "idiot", True)]
REVIEWED = Config(ai_review_enabled=True, api_key="k", model="m")


def decided(spark, rows, contents, **more):
    table = spark.createDataFrame(RULES, "id long, guild_id string, scope string, pattern string, enabled boolean")
    lists = spark.createDataFrame([], "guild_id string, user_id string, list_type string")
    return decisions.decide(rows, table, lists, more.pop("config", REVIEWED), contents=contents, **more)


def posted(spark, n, texts):
    m = spark.range(n).select(F.col("id").alias("message_id"), F.lit("g").alias("guild_id"), F.concat(F.lit("u"), "id").alias("user_id"), (F.col("id") + 1).alias("t_ms"))
    return m.withColumn("content_id", F.col("message_id") % texts)


@pytest.fixture
def shuffled(spark):
    """Gives the bytes that were written for shuffles so far; joins are made by shuffles meanwhile."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.5)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    yield written
    spark.conf.unset(name)


def random_texts(n, size):
    rng = random.Random(3)
    return [(i, "bad " + "".join(rng.choice("0123456789qwertzu") for _ in range(size))) for i in range(n)]


def test_reviews_deal_a_text_once(spark, shuffled):
    texts = random_texts(20, 20_000)
    contents = spark.createDataFrame(texts, "content_id long, content string")
    before = shuffled()
    asked = decided(spark, posted(spark, 1000, 20), contents).requests
    digests = [r[0] for r in asked.groupBy(F.md5("request")).count().collect()]
    assert len(digests) == 20
    # 400 KB of texts, posted as 20 MB
    assert shuffled() - before < 3_000_000


def test_decisions_deal_a_text_once(spark, shuffled):
    texts = [(i, "idiot" + t) for i, t in random_texts(20, 20_000)]
    contents = spark.createDataFrame(texts, "content_id long, content string")
    before = shuffled()
    made = decided(spark, posted(spark, 1000, 20), contents).decisions
    assert sorted(r[1] for r in made.groupBy(F.md5("content")).count().collect()) == [50] * 20
    assert shuffled() - before < 3_000_000


def test_texts_of_contents_and_of_messages_give_the_same(spark):
    texts = [(0, "bad  one"), (1, "idiot " * 60), (2, "fine"), (3, "x" * 3000 + "bad")]
    contents = spark.createDataFrame(texts, "content_id long, content string")
    rows = posted(spark, 12, 4).withColumn("channel_id", F.lit("c"))
    outs = [decided(spark, rows, contents), decided(spark, rows.join(contents, "content_id").drop("content_id"), None)]
    for name, columns in (("requests", "message_id, status, request, content, stored, short, channel_id"), ("decisions", "message_id, code, content, stored, short, channel_id")):
        a, b = ({tuple(r) for r in getattr(o, name).select(columns.split(", ")).collect()} for o in outs)
        assert a == b and a


def test_a_message_asks_once_if_its_text_is_there_twice(spark):
    contents = spark.createDataFrame([(0, "bad"), (0, "bad too"), (1, "bad")], "content_id long, content string")
    got = sorted((r.message_id, r.content) for r in decided(spark, posted(spark, 2, 2), contents).requests.collect())
    assert got == [(0, "bad too"), (1, "bad")]


def scored(spark, rows):
    results = [(1, "review"), (2, "pass"), (4, "review"), (5, "pass"), (6, "review"), (7, "review"), (7, "review"), (8, "review"), (8, "pass"), (10, "action"), (11, "other")]
    table = spark.createDataFrame(results, "message_id long, status string").withColumns({"label": F.lit("普通广告"), "confidence": F.lit(0.75), "violation_probability": F.lit(0.5)})
    return table.join(rows.select("message_id").distinct(), "message_id")


def of_kinds(spark):
    """Messages 1 to 11, of which 3 is there twice, and contents."""
    texts = {1: "bad", 2: "bad", 3: "bad", 4: "fine", 5: "fine", 6: "idiot bad", 7: "bad", 8: "bad", 9: "fine", 10: "bad", 11: "bad"}
    contents = spark.createDataFrame([*texts.items()], "content_id long, content string")
    rows = spark.createDataFrame([(i, "g", f"u{i}", i, i) for i in [*texts, 3]], "message_id long, guild_id string, user_id string, t_ms long, content_id long")
    return rows, contents


@pytest.mark.parametrize("settled", [False, True])
@pytest.mark.parametrize("most", [None, 0])
def test_reviews_of_scored_messages(spark, monkeypatch, settled, most):
    if most is not None:
        monkeypatch.setattr(identity, "BROADCAST_ROWS", most)
    rows, contents = of_kinds(spark)
    more = {"settle": Work(spark).settled} if settled else {}
    got = decided(spark, rows, contents, scores=scored(spark, rows), **more).requests.collect()
    said = "该消息由模型分类为普通广告，分类置信度 75.0%，总违规概率 50.0%"
    hit = "命中敏感关键词 #1(bad)"
    asks = sorted((r.message_key, r.status, r.content, json.loads(r.request)["messages"][1]["content"].split("\n")[:2]) for r in got)
    assert asks == sorted(
        [("g:1#1", "pending", "bad", ["Patterns: bad", f"Evidence: {hit}；{said}"]), ("g:3#1", "pending", "bad", ["Patterns: bad", f"Evidence: {hit}"]),
         ("g:3#2", "duplicate", "bad", ["Patterns: bad", f"Evidence: {hit}"]), ("g:4#1", "pending", "fine", ["Patterns: 违规消息检测模型", f"Evidence: {said}"]),
         ("g:7#1", "pending", "bad", ["Patterns: bad、bad", f"Evidence: {hit}；{said}；{hit}；{said}"]), ("g:8#1", "pending", "bad", ["Patterns: bad", f"Evidence: {hit}；{said}"]),
         ("g:11#1", "pending", "bad", ["Patterns: bad", f"Evidence: {hit}"])]
    )


def test_requests_of_settled_tables_deal_only_texts(spark, shuffled):
    rows, contents = of_kinds(spark)
    rows = rows.distinct()
    got = decided(spark, rows, contents, scores=scored(spark, rows), settle=Work(spark).table).requests
    # by content_id, of the requests and of the contents
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_settled_tables_leave_no_shuffle_files(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}
    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 500).alias("k")).count()
    assert Work(spark).settled(df).count() == 500
    made = {p for p in files() - before if p.name.endswith(".data")}
    # the count's own sum is left, which has a row a task
    assert sum(p.stat().st_size for p in made if p.exists()) < 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("most", [None, 0])
def test_keys_of_counted_messages_are_those_of_numbered_ones(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(identity, "BROADCAST_ROWS", most)
    rows = [(1, "g", "u", 5), (1, "g", "u", 5), (1, "h", "u", 5), (1, "g", "v", 4), (2, "g", "u", 6), (None, "g", "u", 7), (None, "g", "u", 7), (None, "g", None, None)]
    df = spark.createDataFrame(rows, "message_id long, guild_id string, user_id string, t_ms long")
    for some in (df, df.distinct().where("message_id is null or user_id = 'u'"), df.where("false")):
        a, b = (sorted(map(str, x.collect())) for x in (identity.keyed(some, Work(spark).settled).select(*df.columns, identity.ROW_KEY), identity.with_key(some)))
        assert a == b
