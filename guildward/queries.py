"""The engine's queries over the driver's tables, with the SQL that DuckDB runs for each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guildward import schemas
from guildward.config import Config, Policy, ladder
from guildward.functions import review_json, text
from guildward.operators import audit, classifier, flood, flood_split, gates, identity, keywords, offenses, retention, review_queue
from guildward.operators import rules as rule_ops
from guildward.operators import signals as sig
from guildward.plans import console, decisions
from guildward.plans.console import Console
from guildward.sources import messages as message_source
from guildward.sources import wordlists
from guildward.tables import Work

GUILDS = ("click", "error", "purchase", "signup", "view")
REDLINE = ("idiot", "clown", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting", "trash")
SENSITIVE = ("ingor", "oution", "ntble")
#: Rules: (id, guild_id, scope, pattern, enabled, npat); one word in seven is disabled, some are written with punctuation.
RULES = [
    (g * 100 + w + 1, guild, "redline" if w < len(REDLINE) else "sensitive", ".".join(word).upper() if w % 5 == 0 else word, (g + w) % 7 != 3, word)
    for g, guild in enumerate(GUILDS)
    for w, word in enumerate(REDLINE + SENSITIVE)
]
CONFIG = Config(governance_preset="custom", flood_rate_per_minute=2, flood_burst_allowance=2, flood_cooldown_seconds=10, offense_window_hours=1)
NOW_MS = 200_000


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [r[:5] for r in RULES]
    return spark.createDataFrame(rows, "id long, guild_id string, scope string, pattern string, enabled boolean")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages; content_id is the document that a message quotes."""
    n = _read(spark, d, "documents").count()
    return message_source.from_events(_read(spark, d, "events")).withColumn("content_id", F.col("message_id") % n)


def contents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "documents")).select(F.col("doc_id").alias("content_id"), F.col("text").alias("content"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: small tables come as one file, in one partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def access_table(spark: SparkSession, d: str) -> DataFrame:
    users = message_source.from_events(_read(spark, d, "events")).select("guild_id", "user_id").distinct()
    kind = F.when(F.col("user_id").cast("long") % 41 == 0, "whitelist").when(F.col("user_id").cast("long") % 37 == 0, "blacklist")
    return users.withColumn("list_type", kind).where("list_type is not null")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Classifier results from labels, by document: toxic acts, poor quality asks for review, the rest passes."""
    labels = _read(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "action").when(F.col("quality") == 0, "review").otherwise("pass")
    label = F.when(F.col("toxic") == 1, "谩骂引战").when(F.col("quality") == 0, "普通广告").otherwise("不违规")
    p = F.when(F.col("toxic") == 1, 0.875).when(F.col("quality") == 0, 0.5).otherwise(0.125)
    return labels.select(F.col("doc_id").alias("content_id"), status.alias("status"), label.alias("label"), F.lit(0.75).alias("confidence"), p.alias("violation_probability"))


def message_scores(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("message_id", "content_id").join(scores(spark, d), "content_id").drop("content_id")


def outcome(spark: SparkSession, d: str, **more) -> decisions.Outcome:
    return decisions.decide(messages(spark, d), rules_table(spark), access_table(spark, d), CONFIG, contents=contents(spark, d), **more)


# ---- SQL building blocks -------------------------------------------------------------------------------------------

_SP = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def norm_cte(source: str, key: str, column: str, out: str, joiner: bool = True) -> str:
    """CTEs that end in ``out`` (key, s): the normal form of column."""
    zero = r"[\x{200B}-\x{200D}\x{FEFF}" + (r"\x{2060}" if joiner else "") + "]"
    return f"""
    {out}_1 AS (SELECT {key}, lower(regexp_replace(nfc_normalize({column}), '{zero}', '', 'g')) AS s FROM {source}),
    {out}_2 AS (SELECT {key}, regexp_replace(regexp_replace(s, '薇信|微{_SP}*信|v{_SP}*x|v{_SP}*信', '微信', 'g'), '扣扣|企鹅号', 'qq', 'g') AS s FROM {out}_1),
    {out}_3 AS (SELECT {key}, string_split(regexp_replace(regexp_replace(s, '{_SP}', '', 'g'), '[\\p{{P}}\\p{{S}}]', '', 'g'), '') AS c FROM {out}_2),
    {out} AS (SELECT {key}, array_to_string(list_filter(c, lambda x, i: i < 3 OR x <> c[i - 1] OR x <> c[i - 2]), '') AS s FROM {out}_3)"""


def plain_sql(x: str) -> str:
    joined = f"array_to_string(list_filter(regexp_split_to_array({x}, '<[!/?a-zA-Z][^>]*>'), lambda p: p <> ''), ' ')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        joined = f"replace({joined}, '{a}', '{b}')"
    return f"CASE WHEN regexp_replace({joined}, '{_SP}', '', 'g') = '' THEN {x} ELSE {joined} END"


MSG = """msg AS (
      SELECT event_id AS message_id, event_type AS guild_id, CAST(user_id AS VARCHAR) AS user_id,
             CAST((epoch_ms(ts) - 1704067200000) // 10000 + 1 AS BIGINT) AS t_ms,
             event_id % (SELECT count(*) FROM documents) AS content_id
      FROM events)"""
_ROWS = ",\n".join(f"({i}, '{g}', '{s}', '{p}', {str(e).lower()}, '{n}')" for i, g, s, p, e, n in RULES)
RULES_CTE = f"rules(id, guild_id, scope, pattern, enabled, npat) AS (VALUES {_ROWS})"
ACCESS = """access AS (
      SELECT DISTINCT event_type AS guild_id, CAST(user_id AS VARCHAR) AS user_id,
             CASE WHEN user_id % 41 = 0 THEN 'whitelist' ELSE 'blacklist' END AS list_type
      FROM events WHERE user_id % 41 = 0 OR user_id % 37 = 0)"""
KW = norm_cte(f"(SELECT doc_id, {plain_sql('text')} AS t FROM documents)", "doc_id", "t", "kw")
HITS = f"""{KW},
    hits_all AS (
      SELECT doc_id, r.guild_id, r.id, r.scope, r.pattern, r.npat, strpos(kw.s, r.npat) + length(r.npat) - 1 AS end_pos
      FROM kw JOIN rules r ON r.enabled AND contains(kw.s, r.npat)),
    hits AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, guild_id ORDER BY end_pos, length(npat) DESC, id) AS match_seq FROM hits_all)
      WHERE match_seq <= 20)"""


def gcra_cte(source: str, keys: str, policy: Policy, out: str = "gcra") -> str:
    """CTEs (recursive) that end in ``out``: the limiter's verdict on every row of source."""
    cd = policy.cooldown_ms
    i = f"(CAST(60000 AS DOUBLE) / {policy.rate})"  # a quotient of doubles: a decimal literal would be another number
    tol = f"({policy.burst - 1} * {i})"
    on = " AND ".join(f"r.{k} = x.{k}" for k in keys.split(", "))
    xs = ", ".join(f"x.{k}" for k in keys.split(", "))
    late = f"x.t_ms < r.tat - {tol}"
    fire = f"({late}) AND (r.last IS NULL OR x.t_ms - r.last >= {cd})"
    return f"""
    {out}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t_ms, message_id) AS n FROM {source}),
    {out} AS (
      SELECT {keys}, message_id, t_ms, n, CAST(t_ms + {i} AS DOUBLE) AS tat, CAST(NULL AS BIGINT) AS last, false AS exceeded, false AS triggered,
             CAST(0 AS BIGINT) AS retry_after_ms, CAST(0 AS BIGINT) AS debt_ms FROM {out}_n WHERE n = 1
      UNION ALL
      SELECT {xs}, x.message_id, x.t_ms, x.n, CASE WHEN {late} THEN r.tat ELSE greatest(x.t_ms, r.tat) + {i} END,
             CASE WHEN {fire} THEN x.t_ms ELSE r.last END, {late}, {fire},
             CASE WHEN {late} THEN CAST(ceil(r.tat - {tol} - x.t_ms) AS BIGINT) ELSE 0 END, CAST(greatest(0, ceil(r.tat - x.t_ms)) AS BIGINT)
      FROM {out} r JOIN {out}_n x ON {on} AND x.n = r.n + 1)"""


_P = CONFIG.policy()
#: All signals of the pipeline without classifier, and the deciding one of each message.
SIGNALS = f"""{MSG}, {RULES_CTE}, {ACCESS}, {HITS},
    gated AS (SELECT m.* FROM msg m ANTI JOIN (SELECT * FROM access WHERE list_type = 'whitelist') w ON m.guild_id = w.guild_id AND m.user_id = w.user_id),
    {gcra_cte("gated", "guild_id, user_id", _P)},
    signals AS (
      SELECT g.message_id, g.guild_id, g.user_id, g.t_ms, 0 AS seq, 'blacklist_user' AS code, 'access' AS source, 'delete' AS action, false AS needs_ai, 0 AS rule_id,
             true AS counts, '黑名单用户发言' AS evidence, '黑名单用户发言' AS pattern
      FROM gated g JOIN access a ON g.guild_id = a.guild_id AND g.user_id = a.user_id AND a.list_type = 'blacklist'
      UNION ALL
      SELECT message_id, guild_id, user_id, t_ms, 1, 'spam_flood', 'behavior', 'delete', false, 0, triggered, '', '' FROM gcra WHERE exceeded
      UNION ALL
      SELECT g.message_id, g.guild_id, g.user_id, g.t_ms, h.match_seq + 1, CASE h.scope WHEN 'sensitive' THEN 'sensitive_keyword' ELSE 'redline_keyword' END, 'content',
             CASE h.scope WHEN 'sensitive' THEN 'silent' ELSE 'delete' END, h.scope = 'sensitive', h.id, true,
             '命中' || CASE h.scope WHEN 'sensitive' THEN '敏感' ELSE '红线' END || '关键词 #' || h.id || '(' || h.pattern || ')', h.pattern
      FROM gated g JOIN hits h ON g.content_id = h.doc_id AND g.guild_id = h.guild_id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY
               CASE action WHEN 'kick' THEN 5 WHEN 'mute' THEN 4 WHEN 'delete' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END DESC,
               CASE code WHEN 'blacklist_user' THEN 9 WHEN 'redline_keyword' THEN 8 WHEN 'spam_flood' THEN 6 ELSE 7 END DESC, seq) AS rk
      FROM signals WHERE NOT needs_ai),
    selected AS (SELECT *, CASE source WHEN 'content' THEN '内容违规' WHEN 'behavior' THEN '行为违规' WHEN 'access' THEN '名单管控' END AS category FROM ranked WHERE rk = 1)"""


def count_cte(window_ms: int) -> str:
    return f"""
    gaps AS (
      SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY guild_id, user_id, category ORDER BY t_ms, message_id) <= {window_ms} THEN 0 ELSE 1 END AS fresh
      FROM selected WHERE counts),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY guild_id, user_id, category ORDER BY t_ms, message_id) AS island FROM gaps),
    counted AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY guild_id, user_id, category, island ORDER BY t_ms, message_id) AS INTEGER) AS offense_count FROM islands)"""


COUNTED = f"WITH RECURSIVE {SIGNALS}, {count_cte(20_000)}"
STATE = f"""{COUNTED},
    state AS (
      SELECT guild_id, user_id, category, arg_max(offense_count, (t_ms, message_id)) AS offense_count, arg_max(code, (t_ms, message_id)) AS last_signal_code,
             max(t_ms) AS updated_ms, min(t_ms) AS created_ms
      FROM counted GROUP BY ALL)"""
DECIDED = f"""WITH RECURSIVE {SIGNALS}, {count_cte(_P.window_ms)},
    all_rows AS (
      SELECT message_id, guild_id, user_id, t_ms, code, source, action, evidence, pattern, rule_id, counts, offense_count FROM counted
      UNION ALL SELECT message_id, guild_id, user_id, t_ms, code, source, action, evidence, pattern, rule_id, counts, 0 FROM selected WHERE NOT counts),
    decided AS (
      SELECT *, CASE WHEN offense_count >= 5 THEN 3 WHEN offense_count >= 3 THEN 2 WHEN offense_count >= 1 THEN 1 END AS level,
             CASE WHEN offense_count >= 3 THEN 'mute' ELSE action END AS final_action,
             CASE WHEN offense_count >= 5 THEN 60 WHEN offense_count >= 3 THEN 10 ELSE 0 END AS mute_minutes,
             CASE WHEN offense_count >= 3 THEN 'mute' WHEN offense_count >= 1 THEN 'warn' END AS notice_action FROM all_rows)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- keywords and text ---------------------------------------------------------------------------------------------


def _matched(spark, d, **more) -> DataFrame:
    """Hits of every document in every guild."""
    texts = contents(spark, d)
    posted = texts.select("content_id", F.explode(F.array(*map(F.lit, GUILDS))).alias("guild_id"))
    views = text.message_views(texts).select("content_id", "keyword_text")
    return keywords.match(posted, rules_table(spark), ["content_id", "guild_id"], views, **more)


@query(f"WITH {RULES_CTE}, {HITS} SELECT id AS rule_id, guild_id, scope, count(*) AS n_documents FROM hits GROUP BY ALL")
def keyword_hits(spark, d):
    return _matched(spark, d).groupBy(F.col("id").alias("rule_id"), "guild_id", "scope").agg(F.count("*").alias("n_documents"))


@query(f"WITH {RULES_CTE}, {HITS} SELECT doc_id, guild_id, id AS rule_id, match_seq FROM hits")
def keyword_top20(spark, d):
    return _matched(spark, d, method="automaton").select(F.col("content_id").alias("doc_id"), "guild_id", F.col("id").alias("rule_id"), "match_seq")


@query(f"WITH {RULES_CTE}, {HITS} SELECT doc_id, guild_id, id AS rule_id, match_seq FROM hits")
def keyword_grams(spark, d):
    """Candidates by an equi-join of grams, as for very many rules."""
    return _matched(spark, d, method="grams").select(F.col("content_id").alias("doc_id"), "guild_id", F.col("id").alias("rule_id"), "match_seq")


@query(f"WITH {norm_cte('documents', 'doc_id', 'text', 'kw')} SELECT doc_id, md5(s) AS digest, length(s) AS n_chars FROM kw")
def normalize_text(spark, d):
    kw = text.normalize(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", kw.alias("s")).select("doc_id", F.md5("s").alias("digest"), F.char_length("s").alias("n_chars"))


@query(
    f"""WITH {norm_cte("(SELECT doc_id, '1(株)fiパkg ' || text AS text FROM documents)", "doc_id", "text", "kw")}
    SELECT doc_id, md5(s) AS digest, length(s) AS n_chars FROM kw"""
)
def compatible_text(spark, d):
    """Full-width letters and digits, ligatures, half-width kana and square units have the normal form of the plain ones."""
    wide = F.translate("text", "aeiouAEIOU0123456789", "ａｅｉｏｕＡＥＩＯＵ０１２３４５６７８９")
    kw = text.normalize(F.concat(F.lit("①㈱ﬁﾊﾟ㎏\u3000"), wide))
    return _read(spark, d, "documents").select("doc_id", kw.alias("s")).select("doc_id", F.md5("s").alias("digest"), F.char_length("s").alias("n_chars"))


@query(f"SELECT page_id, md5({plain_sql('html')}) AS digest FROM pages")
def plain_text(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(text.plain_text(F.col("html"))).alias("digest"))


@query(
    f"""WITH t AS (SELECT doc_id, trim(regexp_replace({plain_sql('text')}, '{_SP}+', ' ', 'g'), ' ') AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 160 THEN s ELSE substr(s, 1, 160) || '...' END AS short FROM t"""
)
def notice_content(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.shortened(F.col("text")).alias("short"))


@query(
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN '内容违规' WHEN toxic = 1 THEN '内容违规：疑似谩骂引战内容' ELSE '内容违规：疑似普通广告内容，请仔细甄别' END AS content_type,
       '行为违规' AS behavior_type FROM labels"""
)
def violation_type(spark, d):
    label = F.when(F.col("toxic") == 1, "谩骂引战").when(F.col("quality") == 0, "普通广告")
    kinds = [text.violation_type(F.lit(s), label).alias(f"{s}_type") for s in ("content", "behavior")]
    return _read(spark, d, "labels").select("doc_id", *kinds)


@query(
    """SELECT conv_id, turn, role IN ('admin', 'owner', 'administrator') OR conv_id % 7 = 0 AS privileged FROM conversations"""
)
def privileged_senders(spark, d):
    rows = _read(spark, d, "conversations")
    role = F.array(F.struct(F.lit("x").alias("id"), F.col("role").alias("name")))
    rows = rows.withColumn("roles", role).withColumn("user_id", F.when(F.col("conv_id") % 7 == 0, "7").otherwise("1"))
    return rows.select("conv_id", "turn", gates.privileged(Config(admin_user_ids=("7",))).alias("privileged"))


# ---- gates and lists -----------------------------------------------------------------------------------------------


@query(f"WITH {MSG} SELECT guild_id, count(*) AS n FROM msg WHERE guild_id IN ('click', 'view') GROUP BY ALL")
def scope_filter(spark, d):
    return messages(spark, d).where(gates.in_scope(Config(guild_ids=("click", "view")))).groupBy("guild_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MSG}, {ACCESS}, g AS (SELECT m.*, EXISTS (SELECT 1 FROM access b WHERE b.guild_id = m.guild_id AND b.user_id = m.user_id AND list_type = 'blacklist') AS black
      FROM msg m WHERE NOT EXISTS (SELECT 1 FROM access w WHERE w.guild_id = m.guild_id AND w.user_id = m.user_id AND list_type = 'whitelist'))
    SELECT guild_id, black AS blacklisted, count(*) AS n FROM g GROUP BY ALL"""
)
def access_anti_semi(spark, d):
    access = access_table(spark, d)
    flagged = gates.flag_blacklisted(gates.drop_whitelisted(messages(spark, d), access), access)
    return flagged.groupBy("guild_id", "blacklisted").agg(F.count("*").alias("n"))


@query(
    """SELECT event_id AS message_id, CASE WHEN user_id % 37 = 0 AND user_id % 41 <> 0 THEN 'reject' WHEN contains(props, '7') THEN 'approve' ELSE 'reject' END AS decision
    FROM events WHERE event_type = 'signup'"""
)
def join_request_decision(spark, d):
    e = _read(spark, d, "events").where("event_type = 'signup'")
    requests = message_source.from_events(e).join(e.select(F.col("event_id").alias("message_id"), F.col("props").alias("content")), "message_id")
    return gates.join_requests(requests, access_table(spark, d), Config(signal="7")).select("message_id", "decision")


@query(
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'u' || user_id || '，欢迎 {username} bot<at id="' || user_id || '"/>' ELSE user_id || ' 退出 {userId}' END AS message
    FROM events WHERE event_type IN ('signup', 'error')"""
)
def member_notices(spark, d):
    e = _read(spark, d, "events").where("event_type in ('signup', 'error')")
    user = F.col("user_id").cast("string")
    members = e.select(
        F.col("event_id").cast("string").alias("guild_id"), user.alias("user_id"), F.concat(F.lit("u"), user).alias("username"),
        F.when(F.col("event_type") == "signup", "added").otherwise("removed").alias("kind"),
    )
    config = Config(bot_name="bot", welcome_message="{username}，欢迎 {username} {botName}", leave_message="{userId} 退出 {userId}")
    return gates.member_notices(members, config).select(F.col("guild_id").cast("long").alias("event_id"), "message")


# ---- flood ---------------------------------------------------------------------------------------------------------


def _limited(spark, d, preset: str) -> DataFrame:
    return flood.limit(messages(spark, d), Config(governance_preset=preset).policy(), ["user_id"], ["t_ms", "message_id"])


def _gcra(preset: str) -> str:
    return f"WITH RECURSIVE {MSG}, {gcra_cte('msg', 'user_id', Config(governance_preset=preset).policy())}"


@query(f"{_gcra('balanced')} SELECT user_id, count(*) AS n, count(*) FILTER (exceeded) AS n_exceeded, count(*) FILTER (triggered) AS n_triggered, max(debt_ms) AS max_debt_ms FROM gcra GROUP BY ALL")
def gcra_user_summary(spark, d):
    return _limited(spark, d, "balanced").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if("exceeded").alias("n_exceeded"), F.count_if("triggered").alias("n_triggered"), F.max("debt_ms").alias("max_debt_ms")
    )


@query(
    f"""WITH RECURSIVE {MSG}, {gcra_cte('msg', 'guild_id', Config(governance_preset='balanced').policy())}
    SELECT guild_id, message_id, exceeded, triggered, retry_after_ms, debt_ms, tat AS expected_ms FROM gcra"""
)
def gcra_hot_keys(spark, d):
    """One limiter for each guild: few keys with very long histories, each cut into chunks."""
    policy = Config(governance_preset="balanced").policy()
    out = flood_split.limit(messages(spark, d), policy, ["guild_id"], ["t_ms", "message_id"], hot_rows=150, chunk_rows=5000)
    return out.select("guild_id", "message_id", "exceeded", "triggered", "retry_after_ms", "debt_ms", "expected_ms")


@query(f"{_gcra('strict')} SELECT message_id, user_id, triggered, retry_after_ms, debt_ms FROM gcra WHERE exceeded")
def gcra_exceeded_rows(spark, d):
    return _limited(spark, d, "strict").where("exceeded").select("message_id", "user_id", "triggered", "retry_after_ms", "debt_ms")


@query(f"{_gcra('balanced')} SELECT message_id, user_id, t_ms FROM gcra WHERE triggered")
def flood_triggers(spark, d):
    return _limited(spark, d, "balanced").where("triggered").select("message_id", "user_id", "t_ms")


# ---- signals, offenses, decisions ------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {SIGNALS} SELECT message_id, code, category, action, rule_id, counts AS counts_as_offense FROM selected")
def signal_priority(spark, d):
    top = sig.top(outcome(spark, d).signals)
    return top.select("message_id", "code", offenses.category(F.col("source")).alias("category"), "action", "rule_id", "counts_as_offense")


@query(f"WITH RECURSIVE {SIGNALS} SELECT message_id, string_agg(code, ',' ORDER BY seq) AS codes FROM signals GROUP BY ALL")
def signal_codes(spark, d):
    return sig.codes(outcome(spark, d).signals).select("message_id", "codes")


def _counted(spark, d, clears=None) -> DataFrame:
    top = sig.top(outcome(spark, d).signals).where("counts_as_offense")
    return offenses.count(top.withColumn("category", offenses.category(F.col("source"))), 20_000, clears)


@query(f"{COUNTED} SELECT message_id, guild_id, user_id, category, offense_count FROM counted")
def offense_counter(spark, d):
    return _counted(spark, d).select("message_id", "guild_id", "user_id", "category", "offense_count")


@query(f"{STATE} SELECT guild_id, user_id, category, offense_count, last_signal_code, updated_ms, created_ms FROM state WHERE updated_ms >= {NOW_MS} - 20000")
def active_offenders(spark, d):
    state = offenses.state(_counted(spark, d))
    return offenses.active(state, NOW_MS, 20_000).select("guild_id", "user_id", "category", "offense_count", "last_signal_code", "updated_ms", "created_ms")


@query(
    f"""WITH RECURSIVE {SIGNALS},
    marks AS (SELECT guild_id, user_id, t_ms FROM msg WHERE message_id % 50 = 0),
    kinds AS (SELECT DISTINCT guild_id, user_id, category FROM selected WHERE counts),
    rows AS (
      SELECT guild_id, user_id, category, t_ms, message_id, 0 AS mark FROM selected WHERE counts
      UNION ALL SELECT m.guild_id, m.user_id, k.category, m.t_ms, NULL, 1 FROM marks m JOIN kinds k ON m.guild_id = k.guild_id AND m.user_id = k.user_id),
    gaps AS (
      SELECT *, CASE WHEN mark = 1 OR lag(mark) OVER w = 1 OR lag(t_ms) OVER w IS NULL OR t_ms - lag(t_ms) OVER w > 20000 THEN 1 ELSE 0 END AS fresh
      FROM rows WINDOW w AS (PARTITION BY guild_id, user_id, category ORDER BY t_ms, mark, message_id)),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY guild_id, user_id, category ORDER BY t_ms, mark, message_id ROWS UNBOUNDED PRECEDING) AS island FROM gaps)
    SELECT message_id, CAST(row_number() OVER (PARTITION BY guild_id, user_id, category, island ORDER BY t_ms, mark, message_id) AS INTEGER) AS offense_count
    FROM islands QUALIFY mark = 0"""
)
def offense_clears(spark, d):
    clears = messages(spark, d).where("message_id % 50 = 0").select("guild_id", "user_id", "t_ms")
    return _counted(spark, d, clears).select("message_id", "offense_count")


@query(f"{DECIDED} SELECT message_id, offense_count, level, final_action, mute_minutes, notice_action FROM decided")
def punishment_ladder(spark, d):
    got = outcome(spark, d).decisions
    return got.select("message_id", "offense_count", F.col("level.level").alias("level"), "final_action", "mute_minutes", "notice_action")


@query(f"{DECIDED} SELECT guild_id, user_id, t_ms, code, final_action, offense_count FROM decided")
def repeated_ids(spark, d):
    """Messages whose ids are given again and again, in their guild and in others, are decided one by one all the same."""
    m = messages(spark, d).withColumn("message_id", F.floor(F.col("message_id") / 5))
    got = decisions.decide(m, rules_table(spark), access_table(spark, d), CONFIG, contents=contents(spark, d))
    return got.decisions.select("guild_id", "user_id", "t_ms", "code", "final_action", "offense_count")


@query(f"{DECIDED} SELECT guild_id, user_id, t_ms, code, final_action, offense_count FROM decided")
def missing_ids(spark, d):
    """A third of the messages has no id, a third an empty one."""
    i = F.col("message_id")
    m = messages(spark, d).withColumn("message_id", F.when(i % 3 == 1, "").when(i % 3 == 2, F.lpad(i.cast("string"), 12, "0")))
    got = decisions.decide(m, rules_table(spark), access_table(spark, d), CONFIG, contents=contents(spark, d))
    return got.decisions.select("guild_id", "user_id", "t_ms", "code", "final_action", "offense_count")


@query(f"{DECIDED} SELECT guild_id, code, final_action, false AS passed, count(*) AS n, sum(mute_minutes) AS mute_minutes FROM decided GROUP BY ALL")
def decision_actions(spark, d):
    got = outcome(spark, d).decisions.groupBy("guild_id", "code", "final_action", "passed")
    return got.agg(F.count("*").alias("n"), F.sum("mute_minutes").alias("mute_minutes"))


@query(
    f"""{DECIDED} SELECT message_id, array_to_string(list_filter([CASE WHEN level IS NOT NULL THEN 'notice' END, 'delete', CASE WHEN final_action = 'mute' THEN 'mute' END],
      lambda x: x IS NOT NULL), ',') AS plan FROM decided"""
)
def action_plan(spark, d):
    return outcome(spark, d).decisions.select("message_id", F.array_join("plan", ",").alias("plan"))


@query(
    f"""{DECIDED}, short AS (SELECT doc_id, trim(regexp_replace({plain_sql('text')}, '{_SP}+', ' ', 'g'), ' ') AS s FROM documents)
    SELECT d.message_id, replace(replace(replace(replace(replace(replace(replace(
        CASE d.level WHEN 1 THEN '{ladder()[0].template}' WHEN 2 THEN '{ladder()[1].template}' ELSE '{ladder()[2].template}' END,
        '{{at}}', '<at id="' || d.user_id || '"/>'), '{{type}}', CASE d.source WHEN 'content' THEN '内容违规' ELSE '行为违规' END),
        '{{evidence}}', CASE d.source WHEN 'content' THEN d.evidence WHEN 'behavior' THEN '发送频率异常' ELSE '账号受到群治理限制' END),
        '{{content}}', CASE WHEN length(s) <= 160 THEN s ELSE substr(s, 1, 160) || '...' END),
        '{{muteMinutes}}', CASE d.level WHEN 1 THEN '0' WHEN 2 THEN '10' ELSE '60' END), '{{offenseCount}}', CAST(d.offense_count AS VARCHAR)), '{{level}}', CAST(d.level AS VARCHAR)) AS notice
    FROM decided d JOIN msg m USING (message_id) JOIN short ON short.doc_id = m.content_id WHERE d.level IS NOT NULL"""
)
def template_render(spark, d):
    return offenses.notices(outcome(spark, d).decisions).where("notice is not null").select("message_id", "notice")


ROUTED = f"""WITH RECURSIVE {SIGNALS},
    scores AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'action' WHEN quality = 0 THEN 'review' ELSE 'pass' END AS status,
      CASE WHEN toxic = 1 THEN '谩骂引战' WHEN quality = 0 THEN '普通广告' ELSE '不违规' END AS label,
      CASE WHEN toxic = 1 THEN '87.5%' WHEN quality = 0 THEN '50.0%' ELSE '12.5%' END AS p FROM labels),
    now AS (SELECT DISTINCT message_id FROM signals WHERE code IN ('redline_keyword', 'blacklist_user')),
    cand AS (SELECT message_id, string_agg(pattern, '、' ORDER BY seq) AS patterns, arg_min(rule_id, seq) AS rule_id FROM signals WHERE needs_ai GROUP BY ALL),
    routed AS (
      SELECT g.message_id, s.status, coalesce(c.rule_id, 0) AS rule_id, coalesce(c.patterns, '违规消息检测模型') AS pattern,
             '该消息由模型分类为' || s.label || '，分类置信度 75.0%，总违规概率 ' || s.p || CASE WHEN c.patterns IS NULL THEN '' ELSE '，候选词：' || c.patterns END AS evidence
      FROM gated g JOIN scores s ON g.content_id = s.doc_id LEFT JOIN cand c ON g.message_id = c.message_id
      WHERE g.message_id NOT IN (SELECT message_id FROM now))"""


@query(f"{ROUTED} SELECT message_id, status, rule_id, pattern, evidence FROM routed")
def model_routing(spark, d):
    m = gates.drop_whitelisted(messages(spark, d), access_table(spark, d))
    found = Work(spark).table(outcome(spark, d).signals)
    routed = sig.route_scores(m.select(*sig.KEY), found, message_scores(spark, d))
    return routed.select("message_id", "status", "rule_id", "pattern", "evidence")


@query(
    f"""{ROUTED}
    SELECT g.message_id FROM gated g LEFT JOIN routed r ON g.message_id = r.message_id
    WHERE g.message_id NOT IN (SELECT message_id FROM now)
      AND (r.status = 'review' OR (r.status IS NULL AND g.message_id IN (SELECT message_id FROM cand)))"""
)
def review_candidates(spark, d):
    return outcome(spark, d, scores=message_scores(spark, d), settle=Work(spark).settled).requests.select("message_id")


@query(
    f"""{ROUTED}
    SELECT g.message_id, 'pending' AS status, CASE WHEN c.message_id IS NULL THEN 1 ELSE len(string_split(c.patterns, '、')) END AS n_patterns,
      coalesce(r.status = 'review', false) AS scored
    FROM gated g LEFT JOIN routed r ON g.message_id = r.message_id LEFT JOIN cand c ON c.message_id = g.message_id
    WHERE g.message_id NOT IN (SELECT message_id FROM now) AND (r.status = 'review' OR (r.status IS NULL AND c.message_id IS NOT NULL))"""
)
def scored_reviews(spark, d):
    """Classifier and reviews at once: what the classifier sends to review, and candidates that it has no result for."""
    settings = replace(CONFIG, ai_review_enabled=True, api_key="k", model="m")
    m, texts = messages(spark, d), contents(spark, d)
    got = decisions.decide(m, rules_table(spark), access_table(spark, d), settings, scores=message_scores(spark, d), contents=texts, settle=Work(spark).settled)
    asked = F.get_json_object("request", "$.messages[1].content")
    patterns = F.split(F.substring_index(F.substring_index(asked, "\nEvidence: ", 1), "Patterns: ", -1), ", |、")
    return got.requests.select("message_id", "status", F.size(patterns).cast("long").alias("n_patterns"), F.contains(asked, F.lit("总违规概率")).alias("scored"))


# ---- audits --------------------------------------------------------------------------------------------------------


def _audits(spark, d) -> DataFrame:
    """Audits of the pipeline with ids in message order and times in milliseconds."""
    a = outcome(spark, d).audits.where("status = 'confirmed'")
    return a.withColumn("id", F.col("message_id")).withColumn("created_ms", F.col("t_ms")).withColumn("created_at", F.timestamp_millis("t_ms"))


AUDITED = f"{DECIDED}, audits AS (SELECT * FROM decided WHERE code <> 'spam_flood' OR counts)"


@query(f"{AUDITED} SELECT message_id, user_id, code AS signal_code, final_action AS action, offense_count FROM audits WHERE guild_id = 'click' ORDER BY t_ms DESC, message_id DESC LIMIT 25 OFFSET 25")
def audit_page(spark, d):
    listed = Console(Config()).audits(_audits(spark, d), "click", page=2)
    return listed.rows.select("message_id", "user_id", "signal_code", "action", "offense_count")


@query(
    f"""{AUDITED} SELECT message_id, pattern FROM audits
    WHERE guild_id = 'view' AND contains(lower(pattern), 'o') AND t_ms >= 50000 AND t_ms < 150000 ORDER BY t_ms DESC, message_id DESC LIMIT 100"""
)
def audit_search_range(spark, d):
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    listed = Console(Config()).audits(_audits(spark, d), "view", search="O", start=at(50_000), end=at(150_000), size=100)
    return listed.rows.select("message_id", "pattern")


@query("SELECT id, guild_id, place, total FROM (SELECT event_id AS id, event_type AS guild_id, row_number() OVER (ORDER BY epoch_ms(ts) DESC, event_id DESC) AS place, count(*) OVER () AS total FROM events WHERE event_type = 'view') WHERE place BETWEEN total // 30 * 29 + 1 AND total // 30 * 30")
def audit_deep_page(spark, d):
    """A page far down a long list, found by counts over its times: only the rows of its span are sorted."""
    e = _read(spark, d, "events").where("event_type = 'view'")
    many = e.count()
    table = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("guild_id"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("created_at"))
    size = many // 30
    low, high, before, total = console.span_of(table, F.unix_millis("created_at"), console.TIME_SPANS, True, 29 * size, size)
    inside = table.where(F.unix_millis("created_at") >= low).where(F.unix_millis("created_at") < high)
    page = inside.orderBy(F.desc("created_at"), F.desc("id")).offset(29 * size - before).limit(size)
    return _placed(page, 29 * size).select("id", "guild_id", "place", F.lit(total).cast("long").alias("total"))


@query(f"{AUDITED} SELECT message_id, code AS signal_code FROM audits WHERE guild_id = 'error' ORDER BY message_id DESC LIMIT 10")
def recent_audits(spark, d):
    return Console(Config()).recent_audits(_audits(spark, d), "error").select("message_id", "signal_code")


@query(f"{STATE} SELECT user_id, category, offense_count FROM state WHERE guild_id = 'click' AND updated_ms >= {NOW_MS} - 3600000 ORDER BY offense_count DESC, updated_ms DESC, user_id, category LIMIT 10")
def top_offenders(spark, d):
    return Console(CONFIG).top_offenders(offenses.state(_counted(spark, d)), "click", NOW_MS).select("user_id", "category", "offense_count")


@query(
    f"""WITH RECURSIVE {SIGNALS} SELECT guild_id, CASE source WHEN 'behavior' THEN 'behavior' WHEN 'access' THEN 'access' ELSE 'keyword' END AS stage, code AS signal_code,
      count(*) AS n FROM signals GROUP BY ALL"""
)
def detection_events(spark, d):
    got = outcome(spark, d, settle=Work(spark).table)
    per = audit.trace(got.signals.select("message_id", "guild_id").distinct())
    return got.events.where("result = 'hit'").join(per, "trace_id").groupBy("guild_id", "stage", "signal_code").agg(F.count("*").alias("n"))


@query(
    f"""{AUDITED}, c AS (SELECT g.message_id FROM gated g WHERE g.message_id IN (SELECT message_id FROM signals WHERE needs_ai)
      AND g.message_id NOT IN (SELECT message_id FROM signals WHERE code IN ('redline_keyword', 'blacklist_user')))
    SELECT 'confirmed' AS status, code AS signal_code, count(*) AS n FROM audits GROUP BY ALL
    UNION ALL SELECT 'skipped', 'ai_review', count(*) FROM c HAVING count(*) > 0"""
)
def audit_statuses(spark, d):
    return outcome(spark, d, settle=Work(spark).table).audits.groupBy("status", "signal_code").agg(F.count("*").alias("n"))


@query(
    f"""{AUDITED}, t AS (SELECT max(message_id) AS m FROM audits WHERE guild_id = 'signup')
    SELECT message_id, seq, code AS signal_code FROM signals WHERE message_id = (SELECT m FROM t)"""
)
def trace_events(spark, d):
    """Events of the trace of the guild's last audit."""
    got = outcome(spark, d, settle=Work(spark).table)
    audits = got.audits.withColumn("id", F.col("message_id"))
    last = audits.where("guild_id = 'signup' and status = 'confirmed'").agg(F.max_by("trace_id", "message_id").alias("t"), F.max("message_id").alias("m")).first()
    events = got.events.withColumn("created_at", F.timestamp_millis("t_ms")).withColumn("id", F.col("seq")).where("result = 'hit'")
    if last["t"] is None:
        return spark.createDataFrame([], "message_id long, seq int, signal_code string")
    found = Console(Config()).audit_events(events, audits, "signup", last["t"])
    return found.select(F.lit(last["m"]).alias("message_id"), "seq", "signal_code")


@query(
    """WITH c AS (SELECT doc_id % 100 AS audit_id, doc_id AS updated_ms, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 3 = 1 THEN 'confirmed' ELSE 'dismissed' END AS status FROM documents)
    SELECT audit_id, max(updated_ms) AS updated_ms, arg_max(status, updated_ms) AS status FROM c GROUP BY ALL"""
)
def review_status_latest(spark, d):
    r = F.col("doc_id") % 3
    log = _read(spark, d, "documents").select(
        (F.col("doc_id") % 100).alias("audit_id"), F.col("doc_id").alias("updated_ms"), F.lit(0).alias("seq"),
        F.when(r == 0, "pending").when(r == 1, "confirmed").otherwise("dismissed").alias("status"),
    )
    return audit.latest(log).select("audit_id", "updated_ms", "status")


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 5 THEN true END AS violation,
       CASE doc_id % 6 WHEN 0 THEN '欺诈' WHEN 1 THEN '不违规' WHEN 5 THEN '博彩' END AS category,
       CASE WHEN doc_id % 6 IN (0, 1) THEN 'r' || doc_id WHEN doc_id % 6 = 5 THEN repeat('长', 80) END AS reason FROM documents"""
)
def json_review_parse(spark, d):
    i = F.col("doc_id").cast("string")
    body = lambda v, c, r: F.concat(F.lit(f'{{"violation": {v}, "category": "{c}", "reason": "'), r, F.lit('"}'))
    raw = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("```json\n"), body("true", "欺诈", F.concat(F.lit("r"), i)), F.lit("\n```")))
        .when(F.col("doc_id") % 6 == 1, body("false", "不违规", F.concat(F.lit("r"), i)))
        .when(F.col("doc_id") % 6 == 2, body("true", "不违规", i))
        .when(F.col("doc_id") % 6 == 3, F.lit("{'violation': true, 'category': '欺诈', 'reason': ''}"))
        .when(F.col("doc_id") % 6 == 4, body("true", "fraud", i))
        .otherwise(F.concat(F.lit("so: "), body("true", "博彩", F.lit("长" * 90)), F.lit(" done")))
    )
    got = _read(spark, d, "documents").select("doc_id", review_json.parse(raw).alias("r"))
    return got.select("doc_id", "r.violation", "r.category", "r.reason")


@query(
    f"""WITH RECURSIVE {MSG}, n AS (SELECT message_id, guild_id || ':' || user_id AS k, t_ms, row_number() OVER (PARTITION BY guild_id, user_id ORDER BY t_ms, message_id) AS n FROM msg),
    r AS (
      SELECT message_id, k, n, t_ms AS last, false AS duplicate FROM n WHERE n = 1
      UNION ALL SELECT x.message_id, x.k, x.n, CASE WHEN x.t_ms - r.last >= 15000 THEN x.t_ms ELSE r.last END, x.t_ms - r.last < 15000 FROM r JOIN n x ON r.k = x.k AND x.n = r.n + 1)
    SELECT message_id, duplicate FROM r"""
)
def duplicate_review_window(spark, d):
    m = messages(spark, d).withColumn("review_key", F.concat_ws(":", "guild_id", "user_id"))
    return audit.deduplicated(m, 15_000).select("message_id", "duplicate")


# ---- rules, wordlists, retention -------------------------------------------------------------------------------------


@query(f"WITH {RULES_CTE} SELECT guild_id, count(*) AS rule_count, count(*) FILTER (enabled) AS enabled_count FROM rules GROUP BY ALL")
def guild_rule_counts(spark, d):
    return Console(Config()).groups(rules_table(spark))


@query(
    f"""WITH {RULES_CTE}, g(guild_id) AS (VALUES ('click'), ('view'), ('empty'))
    SELECT g.guild_id, count(id) AS rule_count, count(id) FILTER (enabled) AS enabled_count FROM g LEFT JOIN rules USING (guild_id) GROUP BY ALL"""
)
def guild_zero_fill(spark, d):
    return Console(Config(guild_ids=("click", "view", "empty"))).groups(rules_table(spark))


@query(f"WITH {RULES_CTE} SELECT id, scope, pattern, enabled FROM rules WHERE guild_id = 'view' AND contains(lower(pattern), 'o') ORDER BY id LIMIT 3 OFFSET 3")
def rule_page(spark, d):
    listed = Console(Config()).rules(rules_table(spark), "view", search="O", page=2, size=3)
    return listed.rows.select("id", "scope", "pattern", "enabled")


@query(
    f"""WITH l AS (SELECT item_id * 2 + k AS line_no, CASE k WHEN 0 THEN text ELSE '>> ' || text || '!' END AS p FROM benchmark, range(2) t(k)),
    {norm_cte('l', 'line_no', 'p', 'nn')}
    SELECT line_no, p AS pattern FROM l JOIN nn USING (line_no)
    WHERE length(trim(p)) <= 200 AND nn.s <> '' AND NOT starts_with(trim(p), '#') QUALIFY row_number() OVER (PARTITION BY nn.s ORDER BY line_no) = 1"""
)
def wordlist_dedupe(spark, d):
    b = _read(spark, d, "benchmark").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    line = F.when(F.col("k") == 0, F.col("text")).otherwise(F.concat(F.lit(">> "), F.col("text"), F.lit("!")))
    return wordlists.patterns(b.select((F.col("item_id") * 2 + F.col("k")).alias("line_no"), line.alias("line")))


#: Lines of a list made of the benchmark's texts: as they are, marked up, doubled letters, comments, marks only, too long, empty.
_LINE = """CASE k WHEN 0 THEN {t} WHEN 1 THEN ' >> ' || {t} || '! ' WHEN 2 THEN {upper} || '…' WHEN 3 THEN '# ' || {t} WHEN 4 THEN '!?!' WHEN 5 THEN repeat({t} || ' ', 12)
    WHEN 6 THEN '' ELSE {head} || '微 信' END"""
_KINDS_OF_LINE = 8


def _list_lines(spark, d) -> DataFrame:
    """(line_no, line) of the list."""
    b = _read(spark, d, "benchmark").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_KINDS_OF_LINE - 1))))
    line = F.expr(_LINE.format(t="text", upper="upper(replace(text, 'ß', 'ss'))", head="substr(text, 1, 40)"))
    return b.select((F.col("item_id") * _KINDS_OF_LINE + F.col("k")).alias("line_no"), line.alias("line"))


_LISTED = f"""l AS (SELECT item_id * {_KINDS_OF_LINE} + k AS line_no, trim({_LINE.format(t="text", upper="upper(replace(text, 'ß', 'ss'))", head="substr(text, 1, 40)")}) AS p FROM benchmark, range({_KINDS_OF_LINE}) t(k)),
    {norm_cte("l", "line_no", "p", "nn")},
    held AS (SELECT line_no, p AS pattern, nn.s AS n, length(p) <= 200 AND nn.s <> '' AS valid FROM l JOIN nn USING (line_no) WHERE p <> '' AND NOT starts_with(p, '#')),
    news AS (SELECT line_no, pattern, n FROM held WHERE valid QUALIFY row_number() OVER (PARTITION BY n ORDER BY line_no) = 1)"""


@query(
    f"""WITH {_LISTED} SELECT (SELECT count(*) FROM held) AS read_count, (SELECT count(*) FROM news) AS pattern_count,
      (SELECT count(*) FROM held WHERE valid) - (SELECT count(*) FROM news) AS duplicate_count, (SELECT count(*) FROM held WHERE NOT valid) AS invalid_count"""
)
def wordlist_counters(spark, d):
    return wordlists.counters(_list_lines(spark, d))


def _known_rules(spark, d) -> DataFrame:
    """Rules of every third text of the benchmark, in two guilds and both scopes."""
    b = _read(spark, d, "benchmark").where("item_id % 3 = 0")
    guild = F.when(F.col("item_id") % 2 == 0, "click").otherwise("view")
    return b.select(
        (F.col("item_id") + 1).alias("id"), guild.alias("guild_id"), F.when(F.col("item_id") % 4 < 3, "redline").otherwise("sensitive").alias("scope"),
        F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("pattern"), (F.col("item_id") % 5 != 0).alias("enabled"), F.lit("b").alias("created_by"), F.timestamp_millis(F.lit(0)).alias("created_at"),
    )


_KNOWN = f"""known AS (SELECT item_id + 1 AS id, CASE WHEN item_id % 2 = 0 THEN 'click' ELSE 'view' END AS guild_id, CASE WHEN item_id % 4 < 3 THEN 'redline' ELSE 'sensitive' END AS scope,
      upper(replace(text, 'ß', 'ss')) AS pattern, item_id % 5 <> 0 AS enabled FROM benchmark WHERE item_id % 3 = 0),
    {norm_cte("known", "id", "pattern", "kn")}"""
_UNKNOWN = f"""{_LISTED}, {_KNOWN}, fresh AS (SELECT line_no, pattern FROM news
      WHERE n NOT IN (SELECT kn.s FROM known JOIN kn USING (id) WHERE guild_id = 'click' AND scope = 'redline'))"""


@query(f"WITH {_UNKNOWN} SELECT line_no, pattern FROM fresh")
def wordlist_anti_existing(spark, d):
    return rule_ops.new_patterns(wordlists.patterns(_list_lines(spark, d)), _known_rules(spark, d), "click", "redline").select("line_no", "pattern")


@query(
    f"""WITH {_UNKNOWN}, top AS (SELECT max(id) AS m FROM known)
    SELECT id, guild_id, scope, pattern, enabled FROM known
    UNION ALL SELECT m + row_number() OVER (ORDER BY line_no), 'click', 'redline', pattern, true FROM fresh, top"""
)
def rule_import(spark, d):
    after = rule_ops.insert(_known_rules(spark, d), wordlists.patterns(_list_lines(spark, d)), "click", "redline", "me", F.timestamp_millis(F.lit(1)))
    return after.select("id", "guild_id", "scope", "pattern", "enabled")


@query(
    f"""WITH {_KNOWN}, first AS (SELECT min(id) AS id FROM known WHERE guild_id = 'view')
    SELECT id, guild_id, CASE WHEN id = (SELECT id FROM first) THEN 'sensitive' ELSE scope END AS scope, CASE WHEN id = (SELECT id FROM first) THEN 'Other Words' ELSE pattern END AS pattern,
      CASE WHEN id = (SELECT id FROM first) THEN false ELSE enabled END AS enabled
    FROM known WHERE id <> (SELECT min(id) FROM known WHERE guild_id = 'click')"""
)
def rule_edits(spark, d):
    """One rule changed and one deleted, through the console."""
    table = _known_rules(spark, d)
    least = {r["guild_id"]: r["id"] for r in table.groupBy("guild_id").agg(F.min("id").alias("id")).collect()}
    edits = Console(Config())
    after = edits.update_rule(table, "view", least["view"], "sensitive", "Other Words", False)
    return edits.delete_rule(after, "click", least["click"]).select("id", "guild_id", "scope", "pattern", "enabled")


@query(f"WITH {_KNOWN} SELECT id, scope, pattern FROM known WHERE guild_id = 'view'")
def rules_of_guild_deleted(spark, d):
    after, _ = Console(Config()).delete_group(_known_rules(spark, d), "click")
    return after.select("id", "scope", "pattern")


@query(
    f"""WITH {_KNOWN} SELECT guild_id, count(*) AS rule_count, count(*) FILTER (enabled) AS enabled_count FROM known GROUP BY ALL"""
)
def imported_rule_counts(spark, d):
    return Console(Config()).groups(_known_rules(spark, d))


@query(
    f"""WITH {_KNOWN}, g AS (SELECT DISTINCT event_type AS guild_id FROM events WHERE event_type <> 'error' UNION SELECT 'nobody')
    SELECT g.guild_id, count(k.id) AS rule_count, count(k.id) FILTER (k.enabled) AS enabled_count, row_number() OVER (ORDER BY g.guild_id) AS place
    FROM g LEFT JOIN known k ON k.guild_id = g.guild_id GROUP BY g.guild_id"""
)
def known_rule_counts(spark, d):
    """Counts of all guilds of the settings, with zeros for those without rules; place tells the order of the list."""
    guilds = tuple(g for g in GUILDS if g != "error") + ("nobody",)
    return _placed(Console(Config(guild_ids=guilds)).groups(_known_rules(spark, d)))


@query(f"WITH {_KNOWN} SELECT id, scope, pattern, enabled, place FROM (SELECT *, row_number() OVER (ORDER BY id) AS place FROM known WHERE guild_id = 'view' AND scope = 'redline') WHERE place BETWEEN 3 AND 4")
def known_rule_page(spark, d):
    """The second page of a guild's rules of one scope, with each row's place in the list."""
    listed = Console(Config()).rules(_known_rules(spark, d), "view", scope="redline", page=2, size=2)
    return _placed(listed.rows, 2).select("id", "scope", "pattern", "enabled", "place")


def _placed(page: DataFrame, before: int = 0) -> DataFrame:
    """A page (of a few rows) with the place of each row in its list, from the order in which the rows come."""
    return page.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1 + before)


#: Files of a lexicon: three of the benchmark's texts, with links and short lines among them, and an excluded one.
_FILE_LINE = """CASE k WHEN 0 THEN {t} WHEN 1 THEN upper(replace({t}, 'ß', 'ss')) || '.' WHEN 2 THEN 'see http://example.com/' || item_id WHEN 3 THEN 'a' WHEN 4 THEN '// ' || {t} WHEN 5 THEN '---' ELSE '' END"""


def _lexicon_files(spark, d) -> DataFrame:
    b = _read(spark, d, "benchmark").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    name = F.when(F.col("item_id") % 4 == 3, wordlists.EXCLUDED_FILES[0]).otherwise(F.concat(F.lit("f"), (F.col("item_id") % 4).cast("string"), F.lit(".txt")))
    lines = b.select(name.alias("file"), (F.col("item_id") * 7 + F.col("k")).alias("n"), F.expr(_FILE_LINE.format(t="replace(text, chr(10), ' ')")).alias("line"))
    return lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


_LEXICON = f"""f AS (SELECT item_id * 7 + k AS line_no, item_id % 4 AS file, trim({_FILE_LINE.format(t="replace(text, chr(10), ' ')")}) AS p FROM benchmark, range(7) t(k) WHERE item_id % 4 <> 3),
    {norm_cte("f", "line_no", "p", "fn", joiner=False)},
    kinds AS (SELECT line_no, file, fn.s AS n, CASE WHEN p = '' OR starts_with(p, '//') OR starts_with(p, '#') OR p = '---' THEN 'skipped' WHEN contains(p, 'http://') THEN 'url'
      WHEN length(fn.s) < 2 THEN 'short' ELSE 'word' END AS kind FROM f JOIN fn USING (line_no))"""


@query(f"WITH {_LEXICON} SELECT DISTINCT n AS word FROM kinds WHERE kind = 'word'")
def lexicon_words(spark, d):
    return wordlists.lexicon(_lexicon_files(spark, d))


@query(
    f"""WITH {_LEXICON}, w AS (SELECT DISTINCT n FROM kinds WHERE kind = 'word')
    SELECT (SELECT count(DISTINCT file) FROM f) AS source_files, 1 AS skipped_files, count(*) AS source_lines, count(*) FILTER (kind = 'skipped') AS skipped_lines,
      count(*) FILTER (kind = 'url') AS skipped_urls, count(*) FILTER (kind = 'short') AS skipped_short, count(*) FILTER (kind = 'word') - (SELECT count(*) FROM w) AS duplicate_lines,
      (SELECT count(*) FROM w) AS output_words, (SELECT CAST(sum(octet_length(encode(n)) + 1) AS BIGINT) FROM w) AS output_bytes FROM kinds"""
)
def lexicon_stats(spark, d):
    return wordlists.lexicon_stats(_lexicon_files(spark, d))


@query(
    """WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT n, greatest(100, CAST(ceil(n / 10 / 100) AS BIGINT) * 100) AS step FROM t)
    SELECT n.done, CAST(floor(100 * n.done / n.total + 0.5) AS BIGINT) AS percent FROM (
      SELECT CAST(least(k * step, n) AS BIGINT) AS done, n AS total FROM s, range(1, 12) r(k) WHERE (k - 1) * step < n) n"""
)
def import_progress(spark, d):
    rows = wordlists.progress(_read(spark, d, "documents").count())
    return spark.createDataFrame([r[:2] for r in rows], "done long, percent long")


# ---- gates, policies, ladders and reviews at large ------------------------------------------------------------------

_BLANK = "CASE WHEN doc_id % 5 = 0 THEN chr(9) || ' ' || chr(12288) WHEN doc_id % 5 = 1 THEN NULL ELSE text END"


@query(
    f"""WITH {MSG}, c AS (SELECT doc_id, {_BLANK} AS t FROM documents)
    SELECT m.guild_id, count(*) AS n FROM msg m JOIN c ON m.content_id = c.doc_id
    WHERE c.t IS NOT NULL AND regexp_replace(c.t, '{_SP}', '', 'g') <> '' AND m.guild_id <> 'error' AND CAST(m.user_id AS BIGINT) NOT IN (1, 2, 3) AND CAST(m.user_id AS BIGINT) % 7 <> 0
    GROUP BY ALL"""
)
def content_gates(spark, d):
    """Blank and missing texts, administrators by id and by plain role, guilds out of scope."""
    blank = _read(spark, d, "documents").select(F.col("doc_id").alias("content_id"), F.expr(_BLANK.replace("chr(12288)", "'\u3000'")).alias("content"))
    role = F.when(F.col("user_id").cast("long") % 7 == 0, F.array(F.lit("member"), F.lit("owner"))).otherwise(F.array(F.lit("Owner")))
    settings = Config(guild_ids=("click", "view", "purchase", "signup"), admin_user_ids=("1", "2", "3"))
    return gates.gate(messages(spark, d).withColumn("roles", role), settings, blank).groupBy("guild_id").agg(F.count("*").alias("n"))


_ODD = Policy(7, 2, 30_000), Policy(52, 1, 10_000)


@query(
    f"""WITH RECURSIVE {MSG}, {gcra_cte("msg", "user_id", _ODD[0], "a")}, {gcra_cte("msg", "guild_id, user_id", _ODD[1], "b")}
    SELECT 7 AS rate, message_id, exceeded, triggered, retry_after_ms, debt_ms, tat AS expected_ms FROM a
    UNION ALL SELECT 52, message_id, exceeded, triggered, retry_after_ms, debt_ms, tat FROM b"""
)
def gcra_inexact_rates(spark, d):
    """Rates whose interval is no whole number of milliseconds, all rows."""
    m = messages(spark, d)
    runs = [flood.limit(m, p, keys, ["t_ms", "message_id"]).withColumn("rate", F.lit(p.rate)) for p, keys in zip(_ODD, (["user_id"], ["guild_id", "user_id"]), strict=True)]
    return runs[0].unionByName(runs[1]).select("rate", "message_id", "exceeded", "triggered", "retry_after_ms", "debt_ms", "expected_ms")


@query(
    f"""WITH RECURSIVE {MSG}, {gcra_cte("msg", "guild_id, user_id", CONFIG.policy())},
    s AS (SELECT message_id, debt_ms AS d, greatest(100, retry_after_ms) AS r, triggered FROM gcra WHERE exceeded)
    SELECT message_id, '个人发送频率超过限制：允许长期 2 条/分钟、短时连续 2 条，虚拟积压 ' || CASE WHEN d % 1000 = 250 THEN (d // 1000) || '.3' ELSE printf('%.1f', CAST(d AS DOUBLE) / 1000) END
      || ' 秒，超出容忍 ' || CASE WHEN r % 1000 = 250 THEN (r // 1000) || '.3' ELSE printf('%.1f', CAST(r AS DOUBLE) / 1000) END
      || ' 秒，是否新增违规：' || CASE WHEN triggered THEN '是' ELSE '否' END AS evidence FROM s"""
)
def flood_evidence(spark, d):
    policy = CONFIG.policy()
    over = flood.limit(messages(spark, d), policy, ["guild_id", "user_id"], ["t_ms", "message_id"])
    return sig.flood_signals(over, policy).select("message_id", "evidence")


_PER_GUILD = (
    Config(guild_ids=("click", "view"), governance_preset="strict", content_detection_enabled=False),
    Config(guild_ids=("view", "signup"), governance_preset="custom", flood_rate_per_minute=52, flood_burst_allowance=1, content_detection_enabled=False),
    Config(guild_ids=("error",), enabled=False),
    Config(governance_preset="custom", flood_rate_per_minute=2, flood_burst_allowance=2, flood_cooldown_seconds=10, content_detection_enabled=False),
)


@query(
    f"""WITH RECURSIVE {MSG}, x AS (SELECT * FROM msg WHERE guild_id IN ('click', 'view')), y AS (SELECT * FROM msg WHERE guild_id = 'signup'),
    z AS (SELECT * FROM msg WHERE guild_id NOT IN ('click', 'view', 'signup', 'error')),
    {gcra_cte("x", "guild_id, user_id", _PER_GUILD[0].policy(), "gx")}, {gcra_cte("y", "guild_id, user_id", _PER_GUILD[1].policy(), "gy")},
    {gcra_cte("z", "guild_id, user_id", _PER_GUILD[3].policy(), "gz")},
    a AS (SELECT * FROM gx UNION ALL SELECT * FROM gy UNION ALL SELECT * FROM gz)
    SELECT message_id, guild_id, triggered AS counts_as_offense FROM a WHERE exceeded"""
)
def policies_per_guild(spark, d):
    m = messages(spark, d).withColumn("content", F.lit("x"))
    none = access_table(spark, d).where("false")
    got = decisions.decide_each(m, rules_table(spark), none, _PER_GUILD).signals
    return got.select("message_id", "guild_id", "counts_as_offense")


_TWO = ["th", "er", "on", "an", "in", "re", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "he"]
_MANY = ",\n".join(f"({i + 1}, 'click', '{'redline' if i % 2 else 'sensitive'}', '{p}', true, '{p}')" for i, p in enumerate(_TWO))


@query(
    f"""WITH rules(id, guild_id, scope, pattern, enabled, npat) AS (VALUES {_MANY}), {HITS} SELECT doc_id, id AS rule_id, match_seq, CAST(end_pos AS BIGINT) AS end_pos FROM hits"""
)
def keyword_signal_limit(spark, d):
    """Thirty frequent pairs of letters: the limit of twenty signals cuts most texts."""
    rows = [(i + 1, "click", "redline" if i % 2 else "sensitive", p, True) for i, p in enumerate(_TWO)]
    table = spark.createDataFrame(rows, "id long, guild_id string, scope string, pattern string, enabled boolean")
    texts = contents(spark, d)
    views = text.message_views(texts).select("content_id", "keyword_text")
    posted = texts.select("content_id", F.lit("click").alias("guild_id"))
    hits = keywords.match(posted, table, ["content_id", "guild_id"], views)
    return hits.select(F.col("content_id").alias("doc_id"), F.col("id").alias("rule_id"), "match_seq", "end_pos")


_STEEP = [{"offense_count": 2, "action": "warn", "template": "w{offenseCount}"}, {"offense_count": 3, "action": "mute", "mute_minutes": 5}, {"offense_count": 4, "action": "kick", "template": "k{action}{level}"}]


@query(
    """WITH e AS (SELECT event_id AS message_id, event_type AS guild_id, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t_ms, event_id % 10 = 0 AS warned,
        CASE event_id % 5 WHEN 0 THEN 'warn' WHEN 1 THEN 'silent' WHEN 2 THEN 'delete' WHEN 3 THEN 'mute' ELSE 'kick' END AS action FROM events),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY guild_id, user_id ORDER BY t_ms, message_id) AS INTEGER) AS offense_count FROM e WHERE action <> 'silent'),
    l AS (SELECT *, CASE WHEN warned THEN NULL WHEN offense_count >= 4 THEN 3 WHEN offense_count >= 3 THEN 2 WHEN offense_count >= 2 THEN 1 END AS level FROM n),
    f AS (SELECT *, CASE WHEN warned THEN 'warn' WHEN level = 3 OR action = 'kick' THEN 'kick' WHEN level = 2 OR action = 'mute' THEN 'mute' ELSE action END AS final_action FROM l)
    SELECT message_id, offense_count, level, final_action, CASE WHEN final_action = 'mute' THEN greatest(CASE WHEN action = 'mute' THEN 10 ELSE 0 END, CASE WHEN level = 2 THEN 5 ELSE 0 END) ELSE 0 END AS mute_minutes,
      CASE WHEN level = 1 THEN 'w' || offense_count WHEN level = 3 THEN 'k踢出3' END AS notice, final_action = 'warn' AS passed,
      array_to_string(list_filter([CASE WHEN level IN (1, 3) THEN 'notice' END, CASE WHEN final_action = 'warn' AND level IS NULL THEN 'warn' END,
        CASE WHEN final_action IN ('mute', 'kick') THEN final_action END], lambda x: x IS NOT NULL), ',') AS plan,
      CASE WHEN final_action = 'warn' AND level IS NULL THEN '<at id="' || user_id || '"/> 管理员警告：r' END AS warning FROM f"""
)
def manual_actions(spark, d):
    """Every kind of manual action against a ladder with warn, mute and kick; silent ones are refused."""
    policy = Policy(window_ms=10**15, levels=ladder(_STEEP))
    e = _read(spark, d, "events")
    kinds = F.element_at(F.array(*map(F.lit, ("warn", "silent", "delete", "mute", "kick"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = e.select(
        F.col("event_id").alias("message_id"), F.col("event_type").alias("guild_id"), F.col("user_id").cast("string").alias("user_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), kinds.alias("action"), F.lit(schemas.MANUAL_CATEGORY).alias("category"),
        F.lit("manual").alias("source"), F.lit("e").alias("evidence"), F.lit("r").alias("public_reason"), F.lit(None).cast("string").alias("content_label"), F.lit("c").alias("content"),
    )
    counted = offenses.count(rows.where("action <> 'silent'"), policy.window_ms)
    asked = rows.select("message_id", "action", (F.col("message_id") % 10 == 0).alias("warned"))
    got = offenses.notices(offenses.manual(asked, counted, policy))
    columns = ["final_action", "mute_minutes", "notice", "passed", F.array_join("plan", ",").alias("plan"), "warning"]
    return got.select("message_id", "offense_count", F.col("level.level").alias("level"), *columns)


_REVIEWS = Config(governance_preset="custom", ai_review_enabled=True, api_key="k", model="m", behavior_detection_enabled=False)


def _reviews(spark, d, capacity: int | None = None, answered: bool = True, **more) -> decisions.Outcome:
    """Texts of three words from the sensitive list, posted as messages, with answers to most requests."""
    m = messages(spark, d)
    words = F.element_at(F.array(*map(F.lit, SENSITIVE)), (F.col("message_id") % 3 + 1).cast("int"))
    texts = F.when(F.col("message_id") % 4 < 2, F.concat(F.lit("say "), words)).otherwise("nothing")
    rule_rows = [(i + 1, g, "sensitive", w, True) for i, (g, w) in enumerate((g, w) for g in GUILDS for w in SENSITIVE)]
    table = spark.createDataFrame(rule_rows, "id long, guild_id string, scope string, pattern string, enabled boolean")
    i = F.col("message_id")
    raw = (
        F.when(i % 8 == 0, '{"violation": true, "category": "欺诈", "reason": "R"}').when(i % 8 == 1, '{"violation": false, "category": "不违规", "reason": ""}')
        .when(i % 8 == 4, "no json")
    )
    answers = m.where("message_id % 8 <> 5").select(F.concat_ws(":", "guild_id", i.cast("string")).alias("review_key"), raw.alias("raw"), (F.col("t_ms") + 7).alias("done_ms"))
    none = access_table(spark, d).where("false")
    return decisions.decide(m.withColumn("content", texts), table, none, _REVIEWS, answers=answers if answered else None, capacity=capacity, **more)


@query(
    f"""WITH {MSG} SELECT message_id, CASE message_id % 8 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 4 THEN 'failed' ELSE 'pending' END AS status,
      CASE message_id % 8 WHEN 0 THEN 'R' WHEN 1 THEN 'AI 判定为不违规' ELSE '等待 AI 复核' END AS evidence FROM msg WHERE message_id % 4 < 2"""
)
def review_answers(spark, d):
    return _reviews(spark, d).requests.select("message_id", "status", "evidence")


@query(
    f"""WITH {MSG}, r AS (SELECT message_id, guild_id, user_id, t_ms + 7 AS t_ms FROM msg WHERE message_id % 8 = 0)
    SELECT message_id, CAST(row_number() OVER (PARTITION BY guild_id, user_id ORDER BY t_ms, message_id) AS INTEGER) AS offense_count, 'ai_review' AS code FROM r"""
)
def review_offenses(spark, d):
    """Confirmed reviews count as offenses at the time of their answer."""
    return _reviews(spark, d).decisions.select("message_id", "offense_count", "code")


@query(
    f"""WITH {MSG}, q AS (SELECT message_id, row_number() OVER (ORDER BY t_ms, message_id) AS n FROM msg WHERE message_id % 4 < 2)
    SELECT CASE WHEN n <= 100 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN n <= 100 THEN '等待 AI 复核' ELSE 'AI 复核队列已满' END AS evidence, count(*) AS n, max(message_id) AS last FROM q GROUP BY 1, 2"""
)
def review_queue_full(spark, d):
    got = _reviews(spark, d, capacity=100, answered=False).requests
    return got.groupBy("status", "evidence").agg(F.count("*").alias("n"), F.max("message_id").alias("last"))


@query(
    f"""WITH RECURSIVE {MSG}, n AS (SELECT *, t_ms + (message_id % 97) * 40 AS done, row_number() OVER (PARTITION BY guild_id ORDER BY t_ms, message_id) AS n FROM msg),
    q AS (
      SELECT guild_id, n, message_id, [done] AS held, 0 AS queued, false AS is_full FROM n WHERE n = 1
      UNION ALL
      SELECT guild_id, n, message_id, CASE WHEN len(l) < 6 THEN list_append(l, done) ELSE l END, len(l), len(l) >= 6 FROM (
        SELECT x.guild_id, x.n, x.message_id, x.done, list_filter(q.held, lambda t: t > x.t_ms) AS l FROM q JOIN n AS x ON x.guild_id = q.guild_id AND x.n = q.n + 1))
    SELECT message_id, CAST(queued AS INTEGER) AS queued, CAST(least(queued, 2) AS INTEGER) AS running, is_full AS "full" FROM q"""
)
def review_queue_occupancy(spark, d):
    """A queue of six for each guild, and answers that take up to four seconds."""
    m = messages(spark, d).withColumn("done_ms", F.col("t_ms") + F.col("message_id") % 97 * 40)
    return review_queue.occupancy(m, 6, by=["guild_id"], span_ms=5_000).select("message_id", "queued", "running", "full")


@query(
    f"""WITH RECURSIVE {MSG}, asked AS (SELECT *, CASE WHEN message_id % 8 <> 5 THEN t_ms + 7 END AS done, row_number() OVER (ORDER BY t_ms, message_id) AS n FROM msg WHERE message_id % 4 < 2),
    q AS (
      SELECT n, message_id, [coalesce(done, 9223372036854775807)] AS held, false AS is_full FROM asked WHERE n = 1
      UNION ALL
      SELECT n, message_id, CASE WHEN len(l) < 40 THEN list_append(l, coalesce(done, 9223372036854775807)) ELSE l END, len(l) >= 40 FROM (
        SELECT x.n, x.message_id, x.done, list_filter(q.held, lambda t: t > x.t_ms) AS l FROM q JOIN asked AS x ON x.n = q.n + 1))
    SELECT CASE WHEN is_full THEN 'failed' ELSE CASE message_id % 8 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 4 THEN 'failed' ELSE 'pending' END END AS status,
      CASE WHEN is_full THEN 'AI 复核队列已满' ELSE CASE message_id % 8 WHEN 0 THEN 'R' WHEN 1 THEN 'AI 判定为不违规' ELSE '等待 AI 复核' END END AS evidence, count(*) AS n, max(message_id) AS last
    FROM q GROUP BY 1, 2"""
)
def review_queue_answers(spark, d):
    """A queue of forty for all, in which requests without an answer stay."""
    got = _reviews(spark, d, capacity=40, settle=Work(spark).table).requests
    return got.groupBy("status", "evidence").agg(F.count("*").alias("n"), F.max("message_id").alias("last"))


@query(
    f"""WITH {MSG}, c AS (SELECT message_id, row_number() OVER (PARTITION BY guild_id, user_id ORDER BY t_ms, message_id) AS n FROM msg WHERE message_id % 8 = 0)
    SELECT m.message_id, CASE m.message_id % 8 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 4 THEN 'failed' ELSE 'pending' END AS status,
      CASE WHEN c.n >= 3 THEN 'mute' WHEN c.n >= 1 THEN 'delete' ELSE 'silent' END AS action, CAST(coalesce(c.n, 0) AS INTEGER) AS offense_count, m.message_id % 8 < 2 AS reviewed_by_ai,
      CASE m.message_id % 8 WHEN 0 THEN 'R' WHEN 1 THEN 'AI 判定为不违规' ELSE '等待 AI 复核' END AS evidence, m.t_ms + CASE WHEN m.message_id % 8 = 5 THEN 0 ELSE 7 END AS updated_ms
    FROM msg m LEFT JOIN c USING (message_id) WHERE m.message_id % 4 < 2"""
)
def audits_after_answers(spark, d):
    """The stored audits of reviews, still pending, read with the log of states that the answers brought."""
    answered = _reviews(spark, d, settle=Work(spark).table)
    log, _ = audit.review_updates(answered.requests, answered.decisions)
    now = audit.current(audit.stored(_reviews(spark, d, answered=False).audits), Work(spark).table(log))
    return now.select(F.col("message_id").cast("long").alias("message_id"), "status", "action", "offense_count", "reviewed_by_ai", "evidence", F.unix_millis("updated_at").alias("updated_ms"))


@query(
    f"""WITH {MSG}, r AS (SELECT CASE message_id % 8 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 4 THEN 'failed' END AS status, t_ms + 7 AS t_ms FROM msg WHERE message_id % 8 IN (0, 1, 4))
    SELECT stage, status AS result, count(*) AS n, CAST(sum(t_ms) AS BIGINT) AS total_ms FROM r, (SELECT unnest(['ai_review', 'decision']) AS stage) GROUP BY 1, 2"""
)
def review_update_events(spark, d):
    _, events = audit.review_updates(_reviews(spark, d).requests)
    return events.groupBy("stage", "result").agg(F.count("*").alias("n"), F.sum("t_ms").alias("total_ms"))


_ASKED = "CASE message_id % 3 WHEN 0 THEN 'ingor' WHEN 1 THEN 'oution' ELSE 'ntble' END"
_RULE_NO = "CASE guild_id WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END * 3 + message_id % 3 + 1"


@query(
    f"""WITH {MSG} SELECT message_id, guild_id || ':' || message_id AS review_key, 'm' AS model, 200 AS max_tokens, 2 AS n_messages,
      'Patterns: ' || {_ASKED} || chr(10) || 'Evidence: 命中敏感关键词 #' || ({_RULE_NO}) || '(' || {_ASKED} || ')' || chr(10) || 'Message begins:' || chr(10) || 'say ' || {_ASKED}
        || chr(10) || 'Message ends.' AS asked FROM msg WHERE message_id % 4 < 2"""
)
def review_request_bodies(spark, d):
    body = lambda path: F.get_json_object("request", path)
    got = _reviews(spark, d, answered=False).requests
    return got.select(
        "message_id", "review_key", body("$.model").alias("model"), body("$.max_tokens").cast("int").alias("max_tokens"),
        F.json_array_length(body("$.messages")).alias("n_messages"), body("$.messages[1].content").alias("asked"),
    )


@query(
    f"""WITH {MSG} SELECT CASE WHEN message_id % 3 = 0 THEN guild_id || ':' || user_id || ':' || t_ms ELSE guild_id || ':' || message_id END AS review_key, count(*) AS n FROM msg GROUP BY ALL"""
)
def review_keys(spark, d):
    """Messages without an id are told apart by user and time."""
    m = messages(spark, d).withColumn("message_id", F.when(F.col("message_id") % 3 != 0, F.col("message_id").cast("string")).otherwise(""))
    return m.groupBy(identity.told_by().alias("review_key")).agg(F.count("*").alias("n"))


def _label_of(body: str, sensitive: bool) -> dict | None:
    """A stand-in for a classifier: by the length of the text, and whether a sensitive rule hit it."""
    n = len(body)
    if n % 7 == 0:
        raise RuntimeError("no answer")
    status = ("action", "review", "pass", "skipped")[n % 4]
    return {"status": status, "label": "欺诈" if sensitive else "不违规", "confidence": 0.5, "violation_probability": (n % 4) / 4, "probabilities": {"欺诈": 0.25}}


@query(
    f"""WITH {RULES_CTE}, {HITS}, first AS (SELECT doc_id, bool_or(scope = 'redline') AS red FROM hits WHERE guild_id = 'view' GROUP BY ALL),
    t AS (SELECT d.doc_id, length({plain_sql("text")}) AS n, f.doc_id IS NOT NULL AS sensitive FROM documents d LEFT JOIN first f USING (doc_id) WHERE NOT coalesce(f.red, false))
    SELECT doc_id, ['action', 'review', 'pass'][n % 4 + 1] AS status, CASE WHEN sensitive THEN '欺诈' ELSE '不违规' END AS label, CAST(n % 4 AS DOUBLE) / 4 AS violation_probability, 0.25::DOUBLE AS p
    FROM t WHERE n % 7 <> 0 AND n % 4 < 3"""
)
def classified_messages(spark, d):
    """Every document as a message of one guild; immediate ones are not asked about, failures and skips give no row."""
    texts = contents(spark, d).withColumn("plain_text", text.plain_text(F.col("content")))
    m = texts.select(F.col("content_id").alias("message_id"), F.lit("view").alias("guild_id"), F.lit("1").alias("user_id"), F.lit(0).cast("long").alias("t_ms"), "content_id", "plain_text")
    signals = sig.keyword_signals(decisions.keyword_hits(m, rules_table(spark), texts.select("content_id", "content")))
    got = classifier.classify(m, signals, _label_of)
    p = F.element_at("probabilities", "欺诈").alias("p")
    return got.select(F.col("message_id").alias("doc_id"), "status", "label", "violation_probability", p)


@query(
    f"""{AUDITED} SELECT message_id, pattern FROM audits WHERE guild_id = 'view' AND code = 'redline_keyword'
      AND user_id = (SELECT max(user_id) FROM audits WHERE guild_id = 'view' AND code = 'redline_keyword') ORDER BY t_ms DESC, message_id DESC LIMIT 25"""
)
def audit_filters(spark, d):
    rows = Work(spark).table(_audits(spark, d))
    user = rows.where("guild_id = 'view' and signal_code = 'redline_keyword'").agg(F.max("user_id")).first()[0]
    listed = Console(Config()).audits(rows, "view", user_id=user, signal_code="redline_keyword", status="confirmed")
    return listed.rows.select("message_id", "pattern")


@query(
    """WITH a AS (SELECT row_number() OVER (ORDER BY user_id) AS id, CAST(user_id AS VARCHAR) AS user_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 37 = 0)),
    b AS (SELECT id, user_id, CASE WHEN id % 2 = 0 THEN 'r' || id ELSE '' END AS reason FROM a UNION ALL SELECT max(id) + 1, 'new', 'why' FROM a)
    SELECT id, '#' || id || ' ' || user_id || CASE WHEN reason = '' THEN '' ELSE '，原因：' || reason END AS entry FROM b WHERE id <> 1"""
)
def access_edits(spark, d):
    """One entry added, one added again, one removed; then the list as the console shows it."""
    users = _read(spark, d, "events").where("user_id % 37 = 0").select("user_id").distinct()
    n = F.row_number().over(Window.orderBy("user_id"))
    table = users.select(n.cast("long").alias("id"), F.col("user_id").cast("string").alias("user_id")).select(
        "id", F.lit("g").alias("guild_id"), "user_id", F.lit("blacklist").alias("list_type"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), F.col("id").cast("string"))).otherwise("").alias("reason"),
        F.lit("b").alias("created_by"), F.timestamp_millis(F.lit(0)).alias("created_at"),
    )
    least = table.where("id = 1").first()["user_id"]
    now = F.timestamp_millis(F.lit(1))
    table, added = rule_ops.add_access(table, "g", "new", "blacklist", "why", "me", now)
    table, again = rule_ops.add_access(table, "g", "new", "blacklist", "other", "me", now)
    table, removed = rule_ops.remove_access(table, "g", least, "blacklist")
    rule_ops.require(added and not again and removed, "an edit was not made")
    return Console(Config()).access_list(table, "g", "blacklist")


@query(
    r"""SELECT doc_id, CAST(len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS BIGINT) AS n_lines, string_split(text, chr(10))[1] AS first FROM documents WHERE text IS NOT NULL"""
)
def text_lines(spark, d):
    """Lines of whole texts, a byte order mark before each."""
    texts = _read(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("\uFEFF"), F.col("text")).alias("text"))
    got = wordlists.lines(texts, by=["doc_id"])
    return got.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min_by("line", "line_no").alias("first"))


# ---- labels and formats ---------------------------------------------------------------------------------------------


def _labels_sql(x: str, kind: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schemas.LABELS_OF[kind].items()) + f" ELSE {x} END"


_CODES = [*schemas.LABELS_OF["signal"], "other"]
_AT = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"


@query(
    f"""WITH e AS (SELECT event_id AS id, {_AT}[event_id % {len(_CODES)} + 1] AS signal_code, CASE event_id % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'pass' ELSE 'action' END AS result,
        event_type AS stage FROM events)
    SELECT id, {_labels_sql("signal_code", "signal")} AS signal_code_label, {_labels_sql("result", "result")} AS result_label, {_labels_sql("stage", "stage")} AS stage_label FROM e"""
)
def event_records(spark, d):
    i = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, _CODES)), (i % len(_CODES) + 1).cast("int"))
    result = F.when(i % 3 == 0, "hit").when(i % 3 == 1, "pass").otherwise("action")
    rows = _read(spark, d, "events").select(
        i.alias("id"), F.lit("t").alias("trace_id"), F.col("event_type").alias("stage"), code.alias("signal_code"), result.alias("result"), F.lit("").alias("pattern"),
        F.lit("").alias("evidence"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("kept back").alias("secret"),
    )
    return Console(Config()).records(rows, "event").select("id", "signal_code_label", "result_label", "stage_label")


@query(
    """WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN doc_id * 977 ELSE doc_id * 99991 END AS n FROM documents),
    k AS (SELECT *, (n * 20 + 1024) // 2048 AS kb, (n * 200 + 1048576) // 2097152 AS mb FROM s)
    SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (kb // 10) || '.' || (kb % 10) || ' KB' ELSE (mb // 100) || '.' || lpad(CAST(mb % 100 AS VARCHAR), 2, '0') || ' MB' END AS size,
      ((n * 2 + 1048576) // 2097152) || ' MB' AS megabytes FROM k"""
)
def file_sizes(spark, d):
    i = F.col("doc_id")
    n = F.when(i % 3 == 0, i).when(i % 3 == 1, i * 977).otherwise(i * 99991)
    return _read(spark, d, "documents").select("doc_id", text.file_size(n).alias("size"), text.megabytes(n).alias("megabytes"))


@query(
    """SELECT event_id, strftime(ts, '%Y/%-m/%-d %H:%M:%S') AS shown, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events"""
)
def event_times(spark, d):
    """A time written, read back and shown; times are UTC, as the session's zone is."""
    at = F.col("ts").cast("timestamp")
    rows = _read(spark, d, "events").select("event_id", text.iso(at).alias("iso"))
    return rows.select("event_id", text.local_time(F.col("iso")).alias("shown"), text.parse_time(F.col("iso")).alias("ms"), "iso")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'redline' WHEN 1 THEN 'sensitive' END AS scope, CASE WHEN doc_id % 5 < 4 THEN ['warn', 'kick', 'mute', 'silent'][doc_id % 5 + 1] ELSE 'delete' END AS action,
      CASE doc_id % 5 WHEN 1 THEN 'kick' WHEN 2 THEN 'mute' ELSE 'warn' END AS punishment FROM documents"""
)
def coerced_values(spark, d):
    i = F.col("doc_id")
    scope = F.element_at(F.array(*map(F.lit, ("红线", "敏感", "both", ""))), (i % 4 + 1).cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("warn", "kick", "mute", "silent", "ban"))), (i % 5 + 1).cast("int"))
    return _read(spark, d, "documents").select(
        "doc_id", text.parse_scope(scope).alias("scope"), text.normalize_action(action, "delete").alias("action"), text.punishment_action(action).alias("punishment")
    )


_RET = Config(guild_ids=("click", "view"), audit_retention_days=10)
_RET_NOW = 1_706_659_200_000


@query(f"SELECT event_type AS guild_id, count(*) AS n FROM events WHERE NOT (event_type IN ('click', 'view') AND epoch_ms(ts) < {_RET_NOW - 10 * 86_400_000}) GROUP BY ALL")
def retention_prune(spark, d):
    rows = _read(spark, d, "events").select(F.col("event_type").alias("guild_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_ms"))
    return retention.kept_audits(rows, _RET, _RET_NOW).groupBy("guild_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH a AS (SELECT user_id AS trace_id, arg_max(event_type, event_id) AS g FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0 GROUP BY ALL)
    SELECT coalesce(a.g, '') AS guild_id, count(*) AS n FROM events e LEFT JOIN a ON e.user_id = a.trace_id
    WHERE NOT (coalesce(a.g, '') IN ('click', 'view') AND epoch_ms(e.ts) < {_RET_NOW - 10 * 86_400_000}) GROUP BY ALL"""
)
def orphan_event_retention(spark, d):
    rows = _read(spark, d, "events").select("event_id", F.col("user_id").alias("trace_id"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("created_ms"))
    audits = rows.where("event_id % 3 = 0 and trace_id % 2 = 0").select("trace_id", F.col("event_type").alias("guild_id"), F.col("event_id").alias("id"))
    kept = retention.kept_events(rows, audits, _RET, _RET_NOW)
    of = audits.groupBy("trace_id").agg(F.max_by("guild_id", "id").alias("g"))
    return kept.join(of, "trace_id", "left").groupBy(F.coalesce("g", F.lit("")).alias("guild_id")).agg(F.count("*").alias("n"))


@query(f"{STATE} SELECT guild_id, user_id, category FROM state WHERE NOT (updated_ms < 180000)")
def offense_retention(spark, d):
    state = offenses.state(_counted(spark, d))
    return retention.kept_offenses(state, CONFIG, 180_000 + CONFIG.policy().window_ms).select("guild_id", "user_id", "category")
