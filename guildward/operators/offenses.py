"""Offense counts in a sliding window, and the punishment that they unlock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildward import config, schemas
from guildward.config import Level, Policy
from guildward.functions import text
from guildward.operators.identity import carried


def category(source: Column) -> Column:
    return text.mapped(source, schemas.CATEGORY, schemas.MANUAL_CATEGORY)


def count(
    events: DataFrame, window_ms: int, clears: DataFrame | None = None, order: str = "message_id", only: str | None = None, carry: DataFrame | None = None
) -> DataFrame:
    """events (guild_id, user_id, category, t_ms, ...) with offense_count and first_ms.

    only: a boolean column; rows where it is false neither count nor are counted (0).

    The count starts anew when more than window_ms have gone by since the user's
    last offense of the category, or at a clear marker (guild_id, user_id, t_ms),
    which holds for all categories. carry is the state that earlier events left
    (guild_id, user_id, category, offense_count, created_ms, updated_ms).
    """
    keys = ["guild_id", "user_id", "category"]
    df = events.withColumn("_clear", F.lit(False))
    if only:
        keys.append(only)
    if clears is not None:
        kinds = events.select(*keys).distinct()
        marks = clears.select("guild_id", "user_id", "t_ms").join(kinds, ["guild_id", "user_id"])
        df = df.unionByName(marks.withColumn("_clear", F.lit(True)), allowMissingColumns=True)
    if carry is None:
        df = df.withColumns({"_had": F.lit(0), "_last": F.lit(None).cast("long"), "_made": F.lit(None).cast("long")})
    else:
        before = carry.select("guild_id", "user_id", "category", F.col("offense_count").alias("_had"), F.col("updated_ms").alias("_last"), F.col("created_ms").alias("_made"))
        df = df.join(before, ["guild_id", "user_id", "category"], "left")
    ties = [order, *carried(events)]
    w = Window.partitionBy(*keys).orderBy("t_ms", F.col("_clear").cast("int"), *ties)
    last, cleared = F.coalesce(F.lag("t_ms").over(w), F.col("_last")), F.coalesce(F.lag("_clear").over(w), F.lit(False))
    starts = last.isNull() | cleared | F.col("_clear") | (F.col("t_ms") - last > window_ms)
    df = df.withColumn("_starts", starts.cast("int")).withColumn("_island", F.sum("_starts").over(w))
    island = Window.partitionBy(*keys, "_island").orderBy("t_ms", F.col("_clear").cast("int"), *ties)
    had = F.when(F.col("_island") == 0, F.coalesce("_had", F.lit(0))).otherwise(0)
    df = df.withColumn("offense_count", (F.row_number().over(island) + had).cast("int")).where("not _clear")
    if only:
        df = df.withColumn("offense_count", F.when(F.col(only), F.col("offense_count")).otherwise(0))
    first = F.least(F.min("t_ms").over(Window.partitionBy(*keys)), F.col("_made"))
    return df.withColumn("first_ms", first).drop("_clear", "_starts", "_island", "_had", "_last", "_made")


def state(counted: DataFrame, actions: bool = False) -> DataFrame:
    """The last offense of each key: offense_count, last_*, created (first ever) and updated times."""
    latest = F.max_by(F.struct("offense_count", "code", "pattern", *(["action"] if actions else [])), F.struct("t_ms", "message_id", *carried(counted)))
    df = counted.groupBy("guild_id", "user_id", "category").agg(latest.alias("s"), F.min("first_ms").alias("created_ms"), F.max("t_ms").alias("updated_ms"))
    kept = [F.col("s.offense_count").alias("offense_count"), F.col("s.code").alias("last_signal_code"), F.col("s.pattern").alias("last_pattern")]
    kept += [F.col("s.action").alias("last_action")] if actions else []
    return df.select("guild_id", "user_id", "category", *kept, "created_ms", "updated_ms")


def active(offenses: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    return offenses.where(F.col("updated_ms") >= now_ms - window_ms)


def unlocked(levels: tuple[Level, ...], n: Column) -> Column:
    """The level that n offenses unlock: strongest action, then longest mute, then highest threshold; null if none."""
    order = lambda x: (schemas.ACTION_RANK[x.action], x.mute_minutes if x.action == "mute" else 0, x.offense_count, x.level)
    kind = "struct<level:int,offense_count:int,action:string,mute_minutes:int,template:string>"
    out = F.lit(None).cast(kind)
    for x in sorted(levels, key=order):
        level = F.struct(F.lit(x.level), F.lit(x.offense_count), F.lit(x.action), F.lit(x.mute_minutes), F.lit(x.template)).cast(kind)
        out = F.when(n >= x.offense_count, level).otherwise(out)
    return out


def decide(selected: DataFrame, policy: Policy) -> DataFrame:
    """selected signals with offense_count as decisions: level, final_action, mute_minutes, notice_action, passed, plan."""
    rank = lambda a: text.mapped(a, schemas.ACTION_RANK, 0)
    df = selected.withColumn("level", unlocked(policy.levels, F.col("offense_count")))
    stronger = rank(F.coalesce("level.action", F.lit("silent"))) > rank(F.col("action"))
    df = df.withColumn("final_action", F.when(stronger, F.col("level.action")).otherwise(F.col("action")))
    own = F.when(F.col("action") == "mute", config.DEFAULT_MUTE_MINUTES).otherwise(0)
    by_level = F.when(F.col("level.action") == "mute", F.col("level.mute_minutes")).otherwise(0)
    df = df.withColumn("mute_minutes", F.when(F.col("final_action") == "mute", F.greatest(own, by_level)).otherwise(0))
    df = df.withColumn("passed", rank(F.col("final_action")) <= schemas.ACTION_RANK["warn"])
    notice = text.trim(F.coalesce("level.template", F.lit(""))) != ""
    df = df.withColumn("notice_action", F.when(notice, F.col("level.action")))
    steps = F.array_compact(
        F.array(
            F.when(notice, F.lit("notice")),
            F.when(~F.col("final_action").isin("warn", "silent"), F.lit("delete")),
            F.when(F.col("final_action").isin("mute", "kick"), F.col("final_action")),
        )
    )
    return df.withColumn("plan", steps)


def notices(decisions: DataFrame) -> DataFrame:
    """decisions (with content) with the text of the notice, null where none is sent; it shows the level's action."""
    values = {
        "at": text.at(F.col("user_id")),
        "type": text.violation_type(F.col("source"), F.col("content_label")),
        "evidence": F.when(F.col("source") == "content", F.col("evidence")).otherwise(F.col("public_reason")),
        "content": F.coalesce("short", F.lit("")) if "short" in decisions.columns else text.shortened(F.coalesce("content", F.lit(""))),
        "action": text.action_name(F.col("level.action")),
        "muteMinutes": F.when(F.col("level.action") == "mute", F.col("level.mute_minutes")).otherwise(0).cast("string"),
        "offenseCount": F.col("offense_count").cast("string"),
        "level": F.col("level.level").cast("string"),
    }
    return decisions.withColumn("notice", F.when(F.col("notice_action").isNotNull(), text.render(F.col("level.template"), values)))


def manual(actions: DataFrame, counted: DataFrame, policy: Policy) -> DataFrame:
    """Decisions of counted manual actions (category MANUAL_CATEGORY), with warning, the text of a plain warning.

    actions: (message_id, action) and, where it is known, warned: whether the
    command to warn was given, else that to punish; without it a warn is the
    former's. A warning has no level. What is punished goes through the ladder;
    actions of the kind silent are refused, a delete is recorded only.
    """
    known = F.col("warned") if "warned" in actions.columns else F.col("action") == "warn"
    asked = actions.where("action <> 'silent'").select("message_id", known.alias("warned"))
    df = decide(counted.join(asked, "message_id"), policy)
    for c in ("level", "notice_action"):
        df = df.withColumn(c, F.when(~F.col("warned"), F.col(c)))
    df = df.withColumn("final_action", F.when(F.col("warned"), "warn").otherwise(F.col("final_action")))
    df = df.withColumn("mute_minutes", F.when(F.col("warned"), 0).otherwise(F.col("mute_minutes")))
    df = df.withColumn("passed", F.col("final_action") == "warn")
    plain = (F.col("final_action") == "warn") & F.col("level").isNull()
    steps = F.array(
        F.when(F.col("notice_action").isNotNull(), F.lit("notice")),
        F.when(plain, F.lit("warn")),
        F.when(F.col("final_action").isin("mute", "kick"), F.col("final_action")),
    )
    warning = F.when(plain, F.concat(text.at(F.col("user_id")), F.lit(" 管理员警告："), F.col("public_reason")))
    return df.withColumns({"plan": F.array_compact(steps), "warning": warning}).drop("warned")
