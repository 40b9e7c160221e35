"""Signals in long form, one row each, and the one that decides a message.

seq keeps the order in which a message's signals arise: 0 access list, 1 flood,
2 and on keywords in match order, 99 classifier. The reasons and evidence texts
are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildward import config, schemas
from guildward.config import Policy
from guildward.functions import text
from guildward.operators.identity import carried, common_key, named, row_key

COLUMNS = [
    "message_id", "guild_id", "user_id", "t_ms", "seq", "code", "source", "public_reason", "evidence", "pattern", "action",
    "needs_ai", "rule_id", "counts_as_offense", "write_audit", "content_label",
]
KEY = ["message_id", "guild_id", "user_id", "t_ms"]
#: What stands for a pattern where only the classifier found something.
MODEL_PATTERN = "违规消息检测模型"


def _signal(df: DataFrame, **values: Column | str | bool | int | None) -> DataFrame:
    """Rows of df as signals; what values leaves out takes the constructor's default."""
    given = {"needs_ai": False, "rule_id": 0, "counts_as_offense": True, "write_audit": True, "content_label": None} | values
    given.setdefault("pattern", given["evidence"])
    kinds = {"seq": "int", "rule_id": "long", "needs_ai": "boolean", "counts_as_offense": "boolean", "write_audit": "boolean"}
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(*KEY, *named(df), *[column(given[c]).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS[len(KEY) :]])


def access_signals(flagged: DataFrame) -> DataFrame:
    """Of messages flagged as blacklisted."""
    hit = flagged.where("blacklisted")
    return _signal(hit, seq=0, code="blacklist_user", source="access", public_reason="账号受到群治理限制", evidence="黑名单用户发言", action="delete")


def flood_signals(limited: DataFrame, policy: Policy) -> DataFrame:
    """Of messages over the limit; only triggers count as offenses and are audited."""
    seconds = lambda ms: text.fixed(ms / 1000, 1)
    evidence = F.concat(
        F.lit(f"个人发送频率超过限制：允许长期 {policy.rate} 条/分钟、短时连续 {policy.burst} 条，虚拟积压 "),
        seconds(F.col("debt_ms")),
        F.lit(" 秒，超出容忍 "),
        seconds(F.greatest(F.lit(100), F.col("retry_after_ms"))),
        F.lit(" 秒，是否新增违规："),
        F.when(F.col("triggered"), "是").otherwise("否"),
    )
    over = limited.where("exceeded")
    return _signal(
        over, seq=1, code="spam_flood", source="behavior", public_reason="发送频率异常", evidence=evidence, action="delete",
        counts_as_offense=F.col("triggered"), write_audit=F.col("triggered"),
    )


def keyword_signals(hits: DataFrame) -> DataFrame:
    """Of keyword hits: redline rules delete, sensitive ones ask for a review."""
    sensitive = F.col("scope") == "sensitive"
    reason = F.concat(F.when(sensitive, "消息内容待复核，命中：").otherwise("消息内容违反群规，命中："), F.col("pattern"))
    evidence = F.concat(F.lit("命中"), text.scope_name(F.col("scope")), F.lit("关键词 #"), F.col("id").cast("string"), F.lit("("), F.col("pattern"), F.lit(")"))
    return _signal(
        hits, seq=F.col("match_seq") + 1, code=F.when(sensitive, "sensitive_keyword").otherwise("redline_keyword"), source="content",
        public_reason=reason, evidence=evidence, pattern=F.col("pattern"), action=F.when(sensitive, "silent").otherwise("delete"),
        needs_ai=sensitive, rule_id=F.col("id"),
    )


def at_once() -> Column:
    """Signals that need neither classifier nor review."""
    return F.col("code").isin("redline_keyword", "blacklist_user")


def immediate(signals: DataFrame, key: str | None = None) -> DataFrame:
    """Messages with a signal that needs neither classifier nor review."""
    return signals.where(at_once()).select(key or row_key(signals)).distinct()


def model_evidence(tail: Column | None = None) -> Column:
    body = F.concat(
        F.lit("该消息由模型分类为"), F.col("label"), F.lit("，分类置信度 "), text.percent(F.col("confidence")),
        F.lit("，总违规概率 "), text.percent(F.col("violation_probability")),
    )
    return F.concat(body, tail) if tail is not None else body


def route_scores(messages: DataFrame, signals: DataFrame, scores: DataFrame) -> DataFrame:
    """Classifier results as signals with column status (action, review or pass); skipped and missing results give none.

    messages: (KEY, and ROW_KEY if signals have it); immediate messages are never
    scored. scores name a message by ROW_KEY, or by message_id and, if they have
    it, guild_id. The rule of the first keyword candidate and the patterns of all
    are carried along.
    """
    return routed(scored(messages, scores), signals)


def scored(messages: DataFrame, scores: DataFrame) -> DataFrame:
    """messages with their results: status, label, confidence, violation_probability; a row for each result."""
    by = score_key(scores)
    known = scores.where(F.col("status").isin("action", "review", "pass"))
    return messages.join(known.select(*by, "status", "label", "confidence", "violation_probability"), by)


def routed(results: DataFrame, signals: DataFrame) -> DataFrame:
    """``route_scores`` of messages that have their results."""
    key = common_key(results, signals)
    waiting = results.join(immediate(signals, key), key, "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "pattern", "rule_id")))
    candidates = signals.where("needs_ai").groupBy(key).agg(ordered.alias("_c"))
    df = waiting.join(candidates, key, "left")
    patterns = F.left(F.coalesce(F.array_join(F.transform("_c", lambda c: c["pattern"]), "、"), F.lit("")), F.lit(config.PATTERN_LIMIT))
    df = df.withColumn("_p", patterns).withColumn("_r", F.coalesce(F.get("_c", 0)["rule_id"], F.lit(0)))
    tail = F.when(F.col("_p") != "", F.concat(F.lit("，候选词："), F.col("_p"))).otherwise("")
    status = F.col("status")
    signal = _signal(
        df.withColumn("seq", F.lit(99)), seq=99, code="spam_model", source="content",
        public_reason=F.when(status == "pass", "本地违规消息检测模型判定放行").when(status == "review", "消息疑似违规，等待复核").otherwise("消息疑似违规"),
        evidence=model_evidence(tail), pattern=F.when(F.col("_p") != "", F.col("_p")).otherwise(MODEL_PATTERN),
        action=F.when(status == "action", "delete").otherwise("silent"), needs_ai=status == "review", rule_id=F.col("_r"),
        counts_as_offense=status == "action", content_label=F.when(F.col("label") != schemas.LABELS[0], F.col("label")),
    )
    return signal.withColumn(
        "status", F.when(F.col("public_reason") == "消息疑似违规", "action").when(F.col("needs_ai"), "review").otherwise("pass")
    )


def score_key(scores: DataFrame) -> list[str]:
    """The columns by which a table of classifier results names a message."""
    return carried(scores) or [c for c in ("guild_id", "message_id") if c in scores.columns]


def top(signals: DataFrame) -> DataFrame:
    """The signal of each message that decides it, among those that need no review: action, then signal rank, then seq."""
    ranked = signals.where("not needs_ai").withColumn("_action", text.mapped(F.col("action"), schemas.ACTION_RANK, 0))
    ranked = ranked.withColumn("_code", text.mapped(F.col("code"), schemas.SIGNAL_RANK, 1))
    w = Window.partitionBy(row_key(signals)).orderBy(F.desc("_action"), F.desc("_code"), "seq")
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_action", "_code")


def codes(signals: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """(message_id, codes): the codes of a message's signals in order, joined by commas; messages is asked for to name those without any.

    Messages are told apart by ROW_KEY where signals have it, which is then a column too.
    """
    key = row_key(signals)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "code")))
    found = signals.groupBy(*dict.fromkeys(["message_id", key])).agg(F.array_join(F.transform(ordered, lambda s: s["code"]), ",").alias("codes"))
    if messages is None:
        return found
    return messages.select(*dict.fromkeys(["message_id", key])).join(found.select(key, "codes"), key, "left").withColumn("codes", F.coalesce("codes", F.lit("none")))
