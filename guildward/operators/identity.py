"""What tells messages apart: guild and id, or guild, user and time where the id is missing, and a number among equal ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guildward.operators.gates import BROADCAST_ROWS
from guildward.tables import unsettled

#: Column that is unique per message row.
ROW_KEY = "message_key"
#: Column that names a message's text, where texts are a table of their own.
TEXT_KEY = "content_id"


def has_id() -> Column:
    return F.coalesce(F.col("message_id").cast("string"), F.lit("")) != ""


def told_by() -> Column:
    """Messages without an id are told apart by user and time."""
    message = F.col("message_id").cast("string")
    return F.when(has_id(), F.concat_ws(":", "guild_id", message)).otherwise(F.concat_ws(":", "guild_id", "user_id", F.col("t_ms").cast("string")))


def with_key(messages: DataFrame) -> DataFrame:
    """messages with ROW_KEY; rows that nothing else tells apart are numbered, so a row that comes twice is two messages.

    A table that has the column already is left as it is. The order of equal ones
    is by time, user and a hash of all columns, so each plan numbers them alike.
    """
    if ROW_KEY in messages.columns:
        return messages
    hashed = [c for c, t in messages.dtypes if not t.startswith("map")]
    w = Window.partitionBy("_told").orderBy("t_ms", "user_id", F.xxhash64(*hashed))
    df = messages.withColumn("_told", told_by())
    return df.withColumn(ROW_KEY, F.concat(F.col("_told"), F.lit("#"), F.row_number().over(w).cast("string"))).drop("_told")


def keyed(messages: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``with_key``, numbering only rows that others may equal: those whose hash of what tells them apart is there more than once.

    Hashes are counted first, so a count and a hash are dealt out, not the row. If
    none comes twice, which is the rule, no row is dealt; beyond BROADCAST_ROWS of
    them all rows are numbered. Rows that were dealt are settled, as every use
    would deal them again; without settle this is ``with_key``.
    """
    if ROW_KEY in messages.columns or settle is unsettled:
        return with_key(messages)
    single, several = split(messages, told_by(), settle)
    if single is None:
        return settle(with_key(messages))
    single = single.withColumn(ROW_KEY, F.concat(told_by(), F.lit("#1")))
    return single if several is None else settle(single.unionByName(with_key(several)))


def split(df: DataFrame, key: Column, settle: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of df whose key is surely theirs alone, and others, each None if there are none; all are others if more than BROADCAST_ROWS hashes of keys repeat."""
    hashed = F.xxhash64(key)
    again = settle(df.groupBy(hashed.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    n = again.count()
    if n > BROADCAST_ROWS:
        return None, df
    if not n:
        return df, None
    df, again = df.withColumn("_h", hashed), F.broadcast(again)
    return df.join(again, "_h", "left_anti").drop("_h"), df.join(again, "_h", "left_semi").drop("_h")


def row_key(df: DataFrame) -> str:
    """The column that tells df's messages apart: ROW_KEY, or the id in tables made without it."""
    return ROW_KEY if ROW_KEY in df.columns else "message_id"


def common_key(a: DataFrame, b: DataFrame) -> str:
    return ROW_KEY if ROW_KEY in a.columns and ROW_KEY in b.columns else "message_id"


def carried(df: DataFrame) -> list[str]:
    return [ROW_KEY] if ROW_KEY in df.columns else []


def named(df: DataFrame) -> list[str]:
    """``carried``, and the column that names the text of a row."""
    return [*carried(df), *([TEXT_KEY] if TEXT_KEY in df.columns else [])]


def trace_key(df: DataFrame) -> Column:
    """What a trace's id is made of, beside the guild: the id, or the key of messages that it doesn't tell apart."""
    message = F.col("message_id").cast("string")
    if ROW_KEY not in df.columns:
        return message
    return F.when(has_id() & (F.col(ROW_KEY) == F.concat(told_by(), F.lit("#1"))), message).otherwise(F.col(ROW_KEY))
