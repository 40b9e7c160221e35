"""Gates and access lists: which messages are looked at, and whose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward import schemas
from guildward.config import Config
from guildward.functions import text
from guildward.tables import unsettled

#: Rows and bytes of values that a side may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
ROLES = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())]))


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows, counted up to the bound, and the bytes of their texts stay below it."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes), F.lit(0))
    n, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df


def in_scope(config: Config, guild: str = "guild_id") -> Column:
    return F.col(guild).isin(*config.guild_ids) if config.guild_ids else F.lit(True)


def privileged(config: Config, roles: T.DataType | None = ROLES) -> Column:
    """Administrators by user id, or by a role whose id or name is one of the fixed role names.

    roles: type of column roles, an array of (id, name) or of plain names; null if there is no such column.
    """
    names = schemas.PRIVILEGED_ROLES
    by_id = F.coalesce(F.col("user_id").isin(*config.admin_user_ids), F.lit(False)) if config.admin_user_ids else F.lit(False)
    if roles is None:
        return by_id
    plain = isinstance(roles, T.ArrayType) and isinstance(roles.elementType, T.StringType)
    told = (lambda r: r.isin(*names)) if plain else (lambda r: r["id"].isin(*names) | r["name"].isin(*names))
    return by_id | F.coalesce(F.exists("roles", lambda r: F.coalesce(told(r), F.lit(False))), F.lit(False))


def has_text(content: str = "content") -> Column:
    return F.coalesce(F.col(content).rlike(text.NOT_SPACE), F.lit(False))


def gate(messages: DataFrame, config: Config, contents: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] = unsettled) -> DataFrame:
    """Messages of guilds in scope with text, not by privileged users; none if the engine is off.

    With contents (content_id, content) the text is that of the message's
    content_id; settle writes the ids of those with text and reads them back.
    """
    if not config.enabled:
        return messages.where(F.lit(False))
    roles = messages.schema["roles"].dataType if "roles" in messages.columns else None
    messages = messages.where((F.coalesce("guild_id", F.lit("")) != "") & in_scope(config) & ~privileged(config, roles))
    if contents is None:
        return messages.where(has_text())
    told = contents.where(has_text()).select("content_id")
    told = told if settle is unsettled else small(settle(told))
    return messages.join(told, "content_id", "left_semi").select(*messages.columns)


def members(access: DataFrame, list_type: str) -> DataFrame:
    """Distinct (guild_id, user_id) of a list; empty ids are never members."""
    on = access.where((F.col("list_type") == list_type) & (F.col("guild_id") != "") & (F.col("user_id") != ""))
    return on.select("guild_id", "user_id").distinct()


def drop_whitelisted(messages: DataFrame, access: DataFrame) -> DataFrame:
    return messages.join(small(members(access, "whitelist")), ["guild_id", "user_id"], "left_anti")


def flag_blacklisted(messages: DataFrame, access: DataFrame, name: str = "blacklisted") -> DataFrame:
    black = members(access, "blacklist").withColumn(name, F.lit(True))
    return messages.join(small(black), ["guild_id", "user_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def join_requests(requests: DataFrame, access: DataFrame, config: Config) -> DataFrame:
    """requests with decision: reject by blacklist, null without a password, else approve if the text contains it."""
    if not config.enabled:
        return requests.limit(0).withColumn("decision", F.lit(None).cast("string"))
    flagged = flag_blacklisted(requests.where(in_scope(config)), access)
    asked = F.when(F.coalesce("content", F.lit("")).contains(config.signal), "approve").otherwise("reject") if config.signal else F.lit(None).cast("string")
    return flagged.withColumn("decision", F.when(F.col("blacklisted"), "reject").otherwise(asked)).drop("blacklisted")


def member_notices(events: DataFrame, config: Config) -> DataFrame:
    """(guild_id, user_id, kind, message) for members that came (kind added) or went (removed)."""
    if not config.enabled:
        return events.limit(0).select("guild_id", "user_id", "kind", F.lit(None).cast("string").alias("message"))
    user = F.coalesce("user_id", F.lit(""))
    came = text.welcome(F.lit(config.welcome_message), user, F.col("username"), F.lit(config.bot_name))
    message = F.when(F.col("kind") == "added", came).when(F.col("kind") == "removed", text.leave(F.lit(config.leave_message), user))
    return events.where(in_scope(config) & F.col("kind").isin("added", "removed")).select("guild_id", "user_id", "kind", message.alias("message"))
