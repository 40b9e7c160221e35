"""What retention deletes, as filters over the tables, with times as they are stored (created_at) or in milliseconds (created_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guildward.config import Config
from guildward.operators.gates import in_scope

DAY_MS = 86_400_000


def audit_cutoff(now_ms: int, days: float) -> int:
    return int(now_ms - max(1, days) * DAY_MS)


def before(df: DataFrame, what: str, ms: int) -> Column:
    """Whether a row's time ``what`` (created or updated) is before ms; a stored time is compared as it is, so that files can be passed over."""
    if f"{what}_ms" in df.columns:
        return F.col(f"{what}_ms") < ms
    return F.col(f"{what}_at") < F.timestamp_millis(F.lit(int(ms)))


def old_audits(audits: DataFrame, config: Config, now_ms: int) -> Column:
    return in_scope(config) & before(audits, "created", audit_cutoff(now_ms, config.audit_retention_days))


def old_events(events: DataFrame, config: Config, now_ms: int, guild: str) -> Column:
    return in_scope(config, guild) & before(events, "created", audit_cutoff(now_ms, config.audit_retention_days))


def old_offenses(offenses: DataFrame, config: Config, now_ms: int) -> Column:
    return in_scope(config) & before(offenses, "updated", now_ms - config.policy().window_ms)


def without(df: DataFrame, old: Column) -> DataFrame:
    return df.where(~F.coalesce(old, F.lit(False)))


def kept_audits(audits: DataFrame, config: Config, now_ms: int) -> DataFrame:
    return without(audits, old_audits(audits, config, now_ms))


def with_guild(events: DataFrame, audits: DataFrame, name: str = "_guild") -> DataFrame:
    """Events take their guild from their trace's last audit; without one the guild is empty, in scope only of all guilds."""
    guilds = audits.groupBy("trace_id").agg(F.max_by("guild_id", "id").alias(name))
    return events.join(guilds, "trace_id", "left").withColumn(name, F.coalesce(name, F.lit("")))


def kept_events(events: DataFrame, audits: DataFrame, config: Config, now_ms: int) -> DataFrame:
    df = with_guild(events, audits)
    return without(df, old_events(df, config, now_ms, "_guild")).drop("_guild")


def kept_offenses(offenses: DataFrame, config: Config, now_ms: int) -> DataFrame:
    return without(offenses, old_offenses(offenses, config, now_ms))
