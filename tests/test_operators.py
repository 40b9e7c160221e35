import random

import pytest
from pyspark.sql import functions as F

from guildward.config import Config, Policy, ladder
from guildward.operators import audit, classifier, gates, keywords, offenses, retention, rules
from guildward.plans import decisions
from guildward.plans.console import Console, days, last_of, page_of
from guildward.sources import wordlists

WORDLIST = "﻿# sample\nIdiot\r\n i d i o t \nv.x\nv x\n微 信 返利\nV信返利\n\n!!!\n兼职\n兼职啊啊啊啊\n兼职啊啊\n#end\nclown\n" + "x" * 201 + "\n薇信返利"
LEXICON = [("a.txt", "﻿# t\nfoo\nBAR!\nhttp://x.y\nx\n---\nfoo.\nexample.com/a\nbaz   qux"), ("b.txt", "bar\n// c\n```\nwww.site\nquux\n\nnew-word"), ("非法网址.txt", "skipped\nfile")]
RULES = "id long, guild_id string, scope string, pattern string, enabled boolean"


def messages(spark, rows):
    return spark.createDataFrame(rows, "message_id long, guild_id string, user_id string, content string, t_ms long")


def access(spark, rows=()):
    return spark.createDataFrame(list(rows), "guild_id string, user_id string, list_type string")


def test_matching_methods_agree(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    table = [(i + 1, rng.choice("gh"), rng.choice(["redline", "sensitive"]), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))), i % 9 != 0) for i in range(60)]
    df = spark.createDataFrame([(i, rng.choice("gh"), t) for i, t in enumerate(texts)], "message_id long, guild_id string, content string")
    from guildward.functions import text

    views = text.message_views(df)
    rule_table = spark.createDataFrame(table, RULES)
    got = [
        {(r.message_id, r.id, r.match_seq, r.end_pos) for r in keywords.match(views, rule_table, ["message_id"], method=m).collect()} for m in ("join", "automaton")
    ]
    assert got[0] == got[1] and got[0]
    assert max(x[2] for x in got[0]) == 20


def test_offense_windows(spark):
    rows = [(0, 0), (1, 10), (2, 20), (3, 31), (4, 41)]
    df = spark.createDataFrame([(i, "g", "u", "c", t) for i, t in rows], "message_id long, guild_id string, user_id string, category string, t_ms long")
    got = lambda x: [r.offense_count for r in x.orderBy("message_id").collect()]
    assert got(offenses.count(df, 10)) == [1, 2, 3, 1, 2]
    clears = spark.createDataFrame([("g", "u", 15)], "guild_id string, user_id string, t_ms long")
    assert got(offenses.count(df, 100, clears)) == [1, 2, 1, 2, 3]


def test_levels(spark):
    levels = ladder([{"offense_count": 1, "action": "mute", "mute_minutes": 60}, {"offense_count": 2, "action": "mute", "mute_minutes": 5}, {"offense_count": 4, "action": "kick"}])
    got = [r.x.level if r.x else None for r in spark.range(6).select("id", offenses.unlocked(levels, F.col("id")).alias("x")).orderBy("id").collect()]
    assert got == [None, 1, 1, 1, 3, 3]


def pipeline(spark, rows, rule_rows, config=Config(governance_preset="strict"), **more):  # noqa: B008
    lists = more.pop("access", access(spark))
    return decisions.decide(messages(spark, rows), spark.createDataFrame(rule_rows, RULES), lists, config, **more)


def test_pipeline(spark):
    rows = [
        (1, "g", "u1", "you IDIOT", 1000), (2, "g", "u1", "idiot again", 2000), (3, "g", "u1", "i.d.i.o.t", 3000), (4, "g", "u2", "maybe bad", 4000),
        (5, "g", "white", "idiot", 5000), (6, "g", "black", "hello", 6000), (7, "g", "u3", "   ", 7000), (8, "", "u3", "idiot", 8000), (9, "other", "u4", "idiot", 9000),
    ]
    lists = access(spark, [("g", "white", "whitelist"), ("g", "white", "blacklist"), ("g", "black", "blacklist")])
    out = pipeline(spark, rows, [(1, "g", "redline", "idiot", True), (2, "g", "sensitive", "bad", True), (3, "g", "redline", "hello", False)], access=lists)
    got = {r.message_id: (r.code, r.offense_count, r.final_action, r.mute_minutes, r.passed, r.plan) for r in out.decisions.collect()}
    assert got == {
        1: ("redline_keyword", 1, "delete", 0, False, ["notice", "delete"]),
        2: ("redline_keyword", 2, "delete", 0, False, ["notice", "delete"]),
        3: ("redline_keyword", 3, "mute", 10, False, ["notice", "delete", "mute"]),
        6: ("blacklist_user", 1, "delete", 0, False, ["notice", "delete"]),
    }
    assert [(r.message_id, r.status) for r in out.requests.collect()] == [(4, "skipped")]
    stages = {(r.stage, r.result): r["count"] for r in out.events.groupBy("stage", "result").count().collect()}
    assert stages == {("access", "hit"): 1, ("keyword", "hit"): 4, ("ai_review", "skipped"): 1, ("decision", "confirmed"): 4, ("decision", "skipped"): 1}
    assert {(r.message_id, r.status, r.reviewed_by_ai) for r in out.audits.collect()} == {(i, "confirmed", False) for i in (1, 2, 3, 6)} | {(4, "skipped", False)}
    assert out.audits.select("trace_id").distinct().count() == 5


def test_reviews_count_as_offenses(spark):
    rows = [(1, "g", "u", "bad one", 1000), (2, "g", "u", "bad two", 2000), (3, "g", "u", "idiot", 90_000)]
    config = Config(ai_review_enabled=True, api_key="k", model="m")
    answers = spark.createDataFrame(
        [("g:1", '{"violation": true, "category": "欺诈", "reason": "x"}', 5000), ("g:1", "second answer", 6000), ("g:2", '{"violation": false, "category": "不违规", "reason": ""}', 5000)],
        "review_key string, raw string, done_ms long",
    )
    out = pipeline(spark, rows, [(1, "g", "sensitive", "bad", True), (2, "g", "redline", "idiot", True)], config, answers=answers)
    got = {r.message_id: (r.code, r.offense_count) for r in out.decisions.collect()}
    assert got == {1: ("ai_review", 1), 3: ("redline_keyword", 2)}
    assert {r.message_id: r.status for r in out.requests.collect()} == {1: "confirmed", 2: "dismissed"}
    assert {(r.message_id, r.status, r.reviewed_by_ai) for r in out.audits.collect()} == {(1, "confirmed", True), (2, "dismissed", True), (3, "confirmed", False)}


def test_classifier_plug(spark):
    def evaluate(body, matched):
        if body == "boom":
            raise RuntimeError
        return {"status": "skipped"} if body == "skip" else {"status": "review", "label": "博彩", "confidence": 0.5, "violation_probability": 0.5, "probabilities": {"x": float(matched)}}

    rows = [(i, "g", "u", t, 1000) for i, t in enumerate(["bad", "boom", "skip", "idiot", "fine"])]
    out = pipeline(spark, rows, [(1, "g", "sensitive", "bad", True), (2, "g", "redline", "idiot", True)])
    asked = messages(spark, rows).select("message_id", F.col("content").alias("plain_text"))
    got = {r.message_id: r.probabilities["x"] for r in classifier.classify(asked, out.signals, evaluate).collect()}
    assert got == {0: 1.0, 4: 0.0}


def test_days(spark):
    df = spark.sql("select timestamp'2024-01-02 23:59:59' t union all select timestamp'2024-01-03 00:00:00'")
    assert df.where(days("t", "2024-01-02", "2024-01-02")).count() == 1 and df.where(days("t")).count() == 2


def test_scores_route(spark):
    rows = [(1, "g", "u", "bad", 1000), (2, "g", "u", "fine", 2000), (3, "g", "u", "bad", 3000), (4, "g", "u", "idiot", 4000)]
    scores = spark.createDataFrame(
        [(1, "action", "博彩", 0.9, 0.8), (2, "review", "普通广告", 0.5, 0.5), (3, "pass", "不违规", 0.9, 0.1), (4, "action", "博彩", 0.9, 0.8)],
        "message_id long, status string, label string, confidence double, violation_probability double",
    )
    config = Config(ai_review_enabled=True, api_key="k")
    out = pipeline(spark, rows, [(1, "g", "sensitive", "bad", True), (2, "g", "redline", "idiot", True)], config, scores=scores)
    assert {r.message_id: r.code for r in out.decisions.collect()} == {1: "spam_model", 4: "redline_keyword"}
    assert [r.message_id for r in out.requests.collect()] == [2]
    assert {(r.message_id, r.status) for r in out.audits.collect()} == {(1, "confirmed"), (2, "pending"), (3, "dismissed"), (4, "confirmed")}


def test_review_duplicates(spark):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 5, 9, 10, 19, 20, 45])], "message_id long, review_key string, t_ms long")
    got = [r.duplicate for r in audit.deduplicated(df, 10).orderBy("message_id").collect()]
    assert got == [False, True, True, False, True, False, False]


def test_join_requests(spark):
    df = spark.createDataFrame([("g", "a", "say pw"), ("g", "b", "no"), ("g", "c", "pw")], "guild_id string, user_id string, content string")
    lists = access(spark, [("g", "c", "blacklist")])
    decide = lambda c: {r.user_id: r.decision for r in gates.join_requests(df, lists, c).collect()}
    assert decide(Config(signal="pw")) == {"a": "approve", "b": "reject", "c": "reject"}
    assert decide(Config()) == {"a": None, "b": None, "c": "reject"}
    assert decide(Config(enabled=False)) == {} == decide(Config(guild_ids=("x",)))


def test_privileged(spark):
    rows = [("1", [("owner", "x")]), ("2", [("9", "admin")]), ("3", [("9", "Admin")]), ("4", None), ("5", [])]
    df = spark.createDataFrame(rows, "user_id string, roles array<struct<id:string,name:string>>")
    got = [r[0] for r in df.orderBy("user_id").select(gates.privileged(Config(admin_user_ids=("5",)))).collect()]
    assert got == [True, True, False, False, True]


def test_wordlist(spark):
    numbered = wordlists.lines(spark.createDataFrame([("﻿# c\n微信返利\n薇信 返利\r\n\n！！！\n兼职\n",)], "text string"))
    assert [r.pattern for r in wordlists.patterns(numbered).orderBy("line_no").collect()] == ["微信返利", "兼职"]
    assert wordlists.counters(numbered).first().asDict() == {"read_count": 4, "pattern_count": 2, "duplicate_count": 1, "invalid_count": 1}
    assert wordlists.decode_upload("5b6u5L+h") == "微信"
    for bad in ("/w==", "not base64!"):
        with pytest.raises(ValueError):
            wordlists.decode_upload(bad)
    with pytest.raises(ValueError):
        wordlists.check_text("\n" * 100_001)


def test_lexicon_files(spark, tmp_path):
    for name, content in LEXICON:
        (tmp_path / name).write_text(content, encoding="utf-8")
    files = wordlists.read_folder(spark, str(tmp_path))
    wordlists.write_lexicon(files, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["bar", "bazqux", "foo", "newword", "quux"]
    assert wordlists.lexicon_stats(files).first()["skipped_files"] == 1


def test_console(spark):
    assert page_of("x", 0) == (1, 25) and page_of(2.7, 1000, 50) == (2, 100) and last_of(None) == 10 and last_of(99) == 30 and last_of(-3) == 1
    console, now = Console(Config(guild_ids=("g",))), F.timestamp_millis(F.lit(0))
    table = spark.createDataFrame([], "id long, guild_id string, scope string, pattern string, enabled boolean, created_by string, created_at timestamp")
    table, stats = console.import_wordlist(table, "g", "redline", "b\na\nA!\n", "me", now)
    assert stats.first()["created_count"] == 2 and [(r.id, r.pattern) for r in table.orderBy("id").collect()] == [(1, "b"), (2, "a")]
    table = console.create_rule(table, "g", "sensitive", "a", "me", now)
    with pytest.raises(ValueError):
        console.create_rule(table, "g", "sensitive", "a.", "me", now)
    with pytest.raises(ValueError):
        console.update_rule(table, "g", 1, "redline", "A", True)
    with pytest.raises(ValueError):
        console.delete_rule(table, "g", 77)
    with pytest.raises(ValueError):
        console.rules(table, "elsewhere")
    table = console.update_rule(table, "g", 1, "redline", "c", False)
    rows, total = console.rules(table, "g", scope="redline", search="C")
    assert total == 1 and rows.first()["enabled"] is False
    assert console.groups(table).first().asDict() == {"guild_id": "g", "rule_count": 3, "enabled_count": 2}
    assert console.delete_group(console.delete_rule(table, "g", 1), "g")[1] == 2


def test_access_list(spark):
    table = spark.createDataFrame([], "id long, guild_id string, user_id string, list_type string, reason string, created_by string, created_at timestamp")
    now = F.timestamp_millis(F.lit(0))
    table, new = rules.add_access(table, "g", "u", "blacklist", "r", "me", now)
    assert new and not rules.add_access(table, "g", "u", "blacklist", "", "me", now)[1]
    assert Console(Config()).access_list(table, "g", "blacklist").first()["entry"] == "#1 u，原因：r"
    table, gone = rules.remove_access(table, "g", "u", "blacklist")
    assert gone and table.count() == 0


def test_retention(spark):
    day = retention.DAY_MS
    audits = spark.createDataFrame([(1, "t1", "g", 0), (2, "t2", "g", 5 * day), (3, "t3", "h", 0)], "id long, trace_id string, guild_id string, created_ms long")
    events = spark.createDataFrame([("t1", 0), ("t2", 0), ("t4", 0), ("t3", 0)], "trace_id string, created_ms long")
    config = Config(guild_ids=("g",), audit_retention_days=0)
    assert {r.id for r in retention.kept_audits(audits, config, 3 * day).collect()} == {2, 3}
    assert {r.trace_id for r in retention.kept_events(events, audits, config, 3 * day).collect()} == {"t3", "t4"}
    assert retention.kept_events(events, audits, Config(), 60 * day).count() == 0


def test_manual_actions(spark):
    rows = [(i, "g", "u", i * 1000, "manual_action", "manual", a, "r", "r", "") for i, a in enumerate(["warn", "mute", "mute", "silent"])]
    schema = "message_id long, guild_id string, user_id string, t_ms long, code string, source string, action string, evidence string, public_reason string, pattern string"
    actions = spark.createDataFrame(rows, schema)
    counted = offenses.count(actions.where("action <> 'silent'").withColumn("category", offenses.category(F.col("source"))), Policy().window_ms)
    got = {r.message_id: (r.final_action, r.mute_minutes, r.offense_count) for r in offenses.manual(actions, counted, Policy()).collect()}
    assert got == {0: ("warn", 0, 1), 1: ("mute", 10, 2), 2: ("mute", 10, 3)}


def test_settled_signals_give_the_same(spark, tmp_path):
    def settle(df):
        df.write.parquet(str(tmp_path / "signals"))
        return spark.read.parquet(str(tmp_path / "signals"))

    rows, table = [(1, "g", "u", "idiot", 1000), (2, "g", "u", "bad", 2000)], [(1, "g", "redline", "idiot", True), (2, "g", "sensitive", "bad", True)]
    outs = [pipeline(spark, rows, table), pipeline(spark, rows, table, settle=settle)]
    a, b = ({tuple(map(str, r)) for r in o.audits.collect()} for o in outs)
    assert a == b and len(a) == 2


def test_empty_tables(spark):
    out = pipeline(spark, [(1, "g", "u", "x", 1)], [(1, "g", "redline", "zzz", True)])
    assert out.decisions.count() == out.audits.count() == out.requests.count() == 0


def test_gates_of_contents_and_roles(spark):
    rows = [(1, "g", "a", 1, 1), (2, "g", "a", 2, 2), (3, "g", "admin", 1, 3), (4, "g", "a", 9, 4), (5, "", "a", 1, 5), (6, "h", "a", 1, 6)]
    m = spark.createDataFrame(rows, "message_id long, guild_id string, user_id string, content_id long, t_ms long")
    contents = spark.createDataFrame([(1, "text"), (2, " \u3000\n"), (3, None)], "content_id long, content string")
    config = Config(guild_ids=("g",), admin_user_ids=("admin",))
    left = lambda df, c=contents: sorted(r.message_id for r in gates.gate(df, config, c).collect())
    assert left(m) == [1]
    plain = m.withColumn("roles", F.when(F.col("message_id") == 1, F.array(F.lit("x"), F.lit("owner"))))
    assert left(plain) == []
    mixed = m.withColumn("content", F.lit("t")).withColumn("roles", F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("Owner").alias("name"))))
    assert left(mixed, None) == [1, 2, 4]
    whole = decisions.decide(m, spark.createDataFrame([], RULES), access(spark, [("g", "a", "blacklist"), ("g", "admin", "blacklist")]), config, contents=contents)
    assert [r.message_id for r in whole.decisions.collect()] == [1]


def test_patterns_beyond_one_automaton(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, "g", "".join(rng.choice("abcd") for _ in range(40))) for i in range(60)]
    rows = [(i + 1, "g", "redline", "".join(rng.choice("abcd") for _ in range(4)), True) for i in range(150)]
    views = spark.createDataFrame(texts, "message_id long, guild_id string, keyword_text string")
    got = lambda: {tuple(r) for r in keywords.match(views, spark.createDataFrame(rows, RULES), ["message_id"]).collect()}
    one = got()
    monkeypatch.setattr(keywords, "AUTOMATON_PATTERNS", 30)
    assert got() == one and one


def test_settings_are_checked():
    from guildward.config import flatten

    assert flatten({"a": {"flood_rate_per_minute": 240}, "b": {"audit_retention_days": 1}}).flood_rate_per_minute == 240
    level = {"offense_count": 1, "action": "warn"}
    for bad in ({"flood_rate_per_minute": 241}, {"audit_retention_days": 0}, {"offense_window_hours": "x"}, {"punishment_levels": [level] * 11}, {"punishment_levels": [{"action": "warn"}]},
                {"punishment_levels": [level | {"mute_minutes": 0}]}, {"governance_preset": "odd"}):
        with pytest.raises(ValueError):
            flatten({"s": bad})


def test_numbers_are_rounded_from_their_binary_value(spark):
    from decimal import ROUND_HALF_UP, Decimal
    from guildward.functions import text

    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 0.95, 1.005, 83.45, 12.345, 99.95, 1e5 + 0.35, 0.5, 2.675] + [k / 1000 for k in range(50, 4000, 100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2):
        want = [str(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]
        assert [r.s for r in df.select(text.fixed(F.col("x"), digits).alias("s")).collect()] == want


def test_carried_offenses_go_on(spark):
    rows = [(i, "g", "u", "c", t) for i, t in enumerate([0, 5, 9, 30, 34, 35])]
    schema = "message_id long, guild_id string, user_id string, category string, t_ms long"
    whole = [r.offense_count for r in offenses.count(spark.createDataFrame(rows, schema), 10).orderBy("message_id").collect()]
    for cut in range(1, 6):
        first = offenses.count(spark.createDataFrame(rows[:cut], schema), 10)
        state = first.groupBy("guild_id", "user_id", "category").agg(
            F.max_by("offense_count", "t_ms").alias("offense_count"), F.max("t_ms").alias("updated_ms"), F.min("first_ms").alias("created_ms")
        )
        rest = offenses.count(spark.createDataFrame(rows[cut:], schema), 10, carry=state).orderBy("message_id").collect()
        assert [r.offense_count for r in rest] == whole[cut:] and rest[0].first_ms == 0


def test_import_reports(spark):
    assert wordlists.progress(0) == [] and wordlists.progress(250)[0] == (100, 40, "词库导入进度：100/250（40%），已新增 100 条。")
    assert [p[0] for p in wordlists.progress(2450)] == [300, 600, 900, 1200, 1500, 1800, 2100, 2400, 2450]
    table = spark.createDataFrame([(1, "g", "redline", "known", True, "b", None)], RULES + ", created_by string, created_at timestamp")
    after, counts = Console(Config()).import_wordlist(table, "g", "redline", "known\nnew\nnew!\n!!", "me", F.timestamp_millis(F.lit(0)))
    assert after.count() == 2
    assert wordlists.summary(counts, "redline").first().message == "红线词库导入完成：读取 4 条，新增 1 条，重复 2 条，无效 1 条。"


def test_retention_job(spark, tmp_path):
    from guildward.plans import retention_job

    day = 86_400_000
    spark.createDataFrame([(1, "t1", "g", 0), (2, "t2", "g", 99 * day)], "id long, trace_id string, guild_id string, created_ms long").write.parquet(f"{tmp_path}/in/audits")
    spark.createDataFrame([(1, "t1", 0), (2, "t2", 99 * day), (3, "t9", 0)], "id long, trace_id string, created_ms long").write.parquet(f"{tmp_path}/in/events")
    spark.createDataFrame([("g", "u", 0), ("g", "v", 100 * day)], "guild_id string, user_id string, updated_ms long").write.parquet(f"{tmp_path}/in/offenses")
    assert retention_job.run(spark, Config(), f"{tmp_path}/in", f"{tmp_path}/out", 100 * day) == {"audits": 1, "events": 2, "offenses": 1}
    assert [r.user_id for r in spark.read.parquet(f"{tmp_path}/out/offenses").collect()] == ["v"]


def test_long_runs_of_equal_reviews(spark):
    rows = [(i, "k", t) for i, t in enumerate(range(0, 3000, 7))] + [(1000 + i, "other", t) for i, t in enumerate([0, 5, 9, 20])]
    got = {r.message_id: r.duplicate for r in audit.deduplicated(spark.createDataFrame(rows, "message_id long, review_key string, t_ms long"), 10).collect()}
    last = {}
    for i, k, t in rows:
        queued = k not in last or t - last[k] >= 10
        assert got[i] is not queued
        if queued:
            last[k] = t


def test_lexicon_order(spark):
    files = spark.createDataFrame([("a.txt", "兼职\n阿姨\n薇薇\nabc\n中文\nzed")], "file string, text string")
    assert [r.word for r in wordlists.lexicon(files).collect()] == ["阿姨", "兼职", "薇薇", "中文", "abc", "zed"]


def test_console_tables(spark):
    from guildward import schemas
    from guildward.functions import text

    console = Console(Config(guild_ids=("g",)))
    lists = spark.createDataFrame([(2, "g", "u2", "blacklist", "r", "b", None), (1, "g", "u1", "blacklist", "", "b", None), (3, "h", "u", "blacklist", "", "b", None)], schemas.ACCESS)
    assert [r.id for r in console.access_list(lists, "g", "blacklist").collect()] == [1, 2]
    kept = [(1, "g", "u", "c", 3, "spam_flood", "p", "mute", None, None), (2, "g", "v", "c", 1, "x", "p", "ban", None, None)]
    table = spark.createDataFrame(kept, schemas.OFFENSES)
    shown = console.records(table, "offense").orderBy("id").collect()
    assert [(r.last_signal_code_label, r.last_action_label) for r in shown] == [("刷屏", "禁言"), ("x", "ban")]
    assert [r.user_id for r in console.clear_offense(table, "g", "u").where("offense_count > 0").collect()] == ["v"]
    events = spark.createDataFrame([(3, "t", "decision", "c", "hit", "", "", None), (1, "t", "keyword", "c", "hit", "", "", None)], schemas.AUDIT_EVENTS)
    audits = spark.createDataFrame([("t", "g")], "trace_id string, guild_id string")
    assert [r.id for r in console.audit_events(events, audits, "g", "t").collect()] == [1, 3]
    assert console.audit_events(events, audits.where("false"), "g", "t").count() == 0
    at = spark.createDataFrame([("2024-01-05T03:04:05.678Z",), ("never",)], "t string")
    got = at.select(text.local_time(F.col("t")), text.parse_time(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("2024/1/5 03:04:05", 1704423845678), ("never", 0)]
    signals = spark.createDataFrame([(1, 2, "b"), (1, 0, "a")], "message_id long, seq int, code string")
    from guildward.operators import signals as sig

    assert {tuple(r) for r in sig.codes(signals, spark.createDataFrame([(1,), (2,)], "message_id long")).collect()} == {(1, "a,b"), (2, "none")}
