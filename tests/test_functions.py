import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from guildward.config import Config, clamp_integer, flatten, ladder
from guildward.functions import review_json, text


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_violation_type(spark):
    rows = [("content", "欺诈"), ("content", "普通广告"), ("content", None), ("behavior", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, l string")
    got = [r[0] for r in df.orderBy("i").select(text.violation_type(F.col("s"), F.col("l"))).collect()]
    assert got == ["内容违规：疑似欺诈内容", "内容违规：疑似普通广告内容，请仔细甄别", "内容违规", "行为违规"]


def test_normalize(spark):
    given = ["Ｖ Ｘ", "v.x", "dev x", "aaa", "aab", "😀😀😀😀", "a​b", "企鹅号!", "加V信", None, "", "Ａ－Ｂ", "微　信"]
    want = ["微信", "vx", "de微信", "aa", "aab", "", "ab", "qq", "加微信", None, "", "ab", "微信"]
    assert column(spark, given, text.normalize) == want
    assert column(spark, ["a⁠b"], lambda x: text.normalize(x, False)) == ["a⁠b"]


def test_nfkc_of_all_characters(spark):
    """Alone, and between marks whose order and composition depend on the neighbours; no Python worker takes part."""
    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in known] + [(f"a{c}\u0327\u0301e{c}",) for c in known] + [(None,), ("",)], "x string").select(
        "x", text.nfkc(F.col("x")).alias("y")
    )
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    assert len(got) == 2 * len(known) + 2
    assert [r for r in got if r.y != (None if r.x is None else unicodedata.normalize("NFKC", r.x))] == []


def test_plain_text(spark):
    given = ["<p>a</p><p>b &amp; c</p>", '<img src="x"/>', "1 < 2", "", "plain"]
    assert column(spark, given, text.plain_text) == ["a b & c", '<img src="x"/>', "1 < 2", "", "plain"]


def test_shortened_and_templates(spark):
    assert column(spark, ["x" * 161, " a \n b ", "x" * 160], text.shortened) == ["x" * 160 + "...", "a b", "x" * 160]
    assert column(spark, ["{a}"], lambda x: text.render(x, {"a": F.lit("{b}"), "b": F.lit("c")})) == ["c"]
    assert column(spark, ["{n} {n}"], lambda x: text.replace_first(x, "{n}", F.lit("$1"))) == ["$1 {n}"]
    assert column(spark, ["红线", "sensitive", "x", None], text.parse_scope) == ["redline", "sensitive", None, None]
    assert column(spark, ["2024-01-01T00:00:00.005Z", "no"], text.parse_time) == [1704067200005, 0]


def test_review_answers(spark):
    ok = '{"violation": true, "category": "欺诈", "reason": "r"}'
    given = [
        f"```json\n{ok}\n```", ok, f"so {ok} there", ok.replace("欺诈", "fraud"), ok.replace("true", "false"), ok.replace('"', "'"),
        '{"violation": true, "category": "欺诈", "reason": 5}', "[]", "", None, ok.replace('"r"', '"' + "长" * 90 + '"'), '{"violation": NaN}',
    ]
    got = column(spark, given, lambda x: review_json.parse(x))
    assert [bool(g) for g in got] == [True, True, True, False, False, False, False, False, False, False, True, False]
    assert got[0]["category"] == "欺诈" and len(got[10]["reason"]) == 80


def test_review_request(spark):
    df = spark.range(1).select(review_json.request(F.lit("m"), F.lit("hello"), F.array(F.lit("p")), F.array(F.lit("e1"), F.lit("e2"))).alias("r"))
    got = json.loads(df.first()["r"])
    assert got["model"] == "m" and [m["role"] for m in got["messages"]] == ["system", "user"]
    assert "hello" in got["messages"][1]["content"] and "e1；e2" in got["messages"][1]["content"]
    assert (got["max_tokens"], got["temperature"]) == (200, 0)


def test_config():
    assert clamp_integer(2.5, 1, 10) == 3 and clamp_integer(-2.5, -9, 9) == -2 and clamp_integer(99, 1, 10) == 10
    levels = ladder([{"offense_count": 5, "action": "kick"}, {"offense_count": 1, "action": "silent"}, {}])
    assert [(x.level, x.offense_count, x.action) for x in levels] == [(1, 1, "warn"), (2, 3, "warn"), (3, 5, "kick")]
    assert ladder([]) == () and len(ladder([{}] * 12)) == 10
    assert flatten({"a": {"enabled": False}, "b": {"enabled": True, "signal": "s"}}) == Config(signal="s")
    assert Config(governance_preset="strict").policy().rate == 12
    assert Config(governance_preset="custom", flood_rate_per_minute=999, offense_window_hours=0).policy().rate == 240
    with pytest.raises(ValueError):
        Config(governance_preset="other")
