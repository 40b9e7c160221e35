"""Rule and access-list tables: inserts, updates and deletes as new versions of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildward import schemas
from guildward.functions import text


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def with_ids(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """new with ids after the greatest existing one, in order. New rows are few: one window over them."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return new.withColumn("id", F.row_number().over(Window.orderBy(order)) + F.lit(top).cast("long"))


def npattern(c: str | Column = "pattern") -> Column:
    return text.normalize(F.col(c) if isinstance(c, str) else c)


def new_patterns(patterns: DataFrame, rules: DataFrame, guild_id: str, scope: str) -> DataFrame:
    """Rows of patterns (pattern, ...) whose normal form no rule of the guild and scope has, enabled or not."""
    known = rules.where((F.col("guild_id") == guild_id) & (F.col("scope") == scope)).select(npattern().alias("_n")).distinct()
    return patterns.withColumn("_n", npattern()).where("_n <> ''").join(known, "_n", "left_anti").drop("_n")


def insert(rules: DataFrame, patterns: DataFrame, guild_id: str, scope: str, created_by: str, now: Column, order: str = "line_no") -> DataFrame:
    """rules and, enabled, those of patterns that are new."""
    require(bool(guild_id), "a guild is required")
    require(scope in schemas.SCOPES, f"unknown scope {scope!r}")
    rows = with_ids(new_patterns(patterns, rules, guild_id, scope), rules, order)
    rows = rows.select(
        F.col("id").cast("long").alias("id"), F.lit(guild_id).alias("guild_id"), F.lit(scope).alias("scope"), "pattern",
        F.lit(True).alias("enabled"), F.lit(created_by).alias("created_by"), now.alias("created_at"),
    )
    return rules.unionByName(rows)


def _own(rules: DataFrame, guild_id: str, rule_id: int) -> None:
    require(isinstance(rule_id, int) and rule_id > 0, "a rule id is a positive integer")
    require(bool(rules.where((F.col("id") == rule_id) & (F.col("guild_id") == guild_id)).limit(1).count()), f"no rule {rule_id} in this guild")


def update(rules: DataFrame, guild_id: str, rule_id: int, scope: str, pattern: str, enabled: bool) -> DataFrame:
    require(scope in schemas.SCOPES, f"unknown scope {scope!r}")
    _own(rules, guild_id, rule_id)
    others = rules.where((F.col("guild_id") == guild_id) & (F.col("scope") == scope) & (F.col("id") != rule_id))
    wanted = rules.sparkSession.createDataFrame([(pattern,)], "pattern string").select(npattern().alias("n"))
    n = wanted.first()["n"]
    require(bool(n), "the pattern is empty after normalization")
    require(not others.where(npattern() == n).limit(1).count(), "the guild has this rule already")
    hit = F.col("id") == rule_id
    new = {"scope": scope, "pattern": pattern, "enabled": enabled}
    return rules.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()})


def delete(rules: DataFrame, guild_id: str, rule_id: int) -> DataFrame:
    _own(rules, guild_id, rule_id)
    return rules.where(F.col("id") != rule_id)


def delete_guild(rules: DataFrame, guild_id: str) -> tuple[DataFrame, int]:
    mine = F.coalesce(F.col("guild_id") == guild_id, F.lit(False))
    return rules.where(~mine), rules.where(mine).count()


def add_access(access: DataFrame, guild_id: str, user_id: str, list_type: str, reason: str, created_by: str, now: Column) -> tuple[DataFrame, bool]:
    """The list with the entry, and whether it is new."""
    require(list_type in schemas.LIST_TYPES, f"unknown list {list_type!r}")
    same = (F.col("guild_id") == guild_id) & (F.col("user_id") == user_id) & (F.col("list_type") == list_type)
    if access.where(same).limit(1).count():
        return access, False
    row = access.sparkSession.createDataFrame([(guild_id, user_id, list_type, reason, created_by)], "guild_id string, user_id string, list_type string, reason string, created_by string")
    row = with_ids(row, access, "user_id").withColumn("id", F.col("id").cast("long")).withColumn("created_at", now)
    return access.unionByName(row.select(*access.columns)), True


def remove_access(access: DataFrame, guild_id: str, user_id: str, list_type: str) -> tuple[DataFrame, bool]:
    same = (F.col("guild_id") == guild_id) & (F.col("user_id") == user_id) & (F.col("list_type") == list_type)
    same = F.coalesce(same, F.lit(False))
    return access.where(~same), bool(access.where(same).limit(1).count())


def access_entry() -> Column:
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("，原因："), F.col("reason"))).otherwise("")
    return F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), F.col("user_id"), reason)


def clear_offenses(offenses: DataFrame, guild_id: str, user_id: str) -> DataFrame:
    """Without any category of the user's offenses."""
    return offenses.where(~F.coalesce((F.col("guild_id") == guild_id) & (F.col("user_id") == user_id), F.lit(False)))
