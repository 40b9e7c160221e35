"""The retention run as a job.

    python -m guildward.plans.retention_job <folder> [guild ...]
    python -m guildward.plans.retention_job --copy <in> <out> [guild ...]

The first form clears the folder of a running Moderation (streaming/moderation.py)
where it is. It looks for old rows by time, which passes over the files without any,
and only touches the batches that hold some: one whose rows are all old goes, of
others what is kept is written beside them and takes their place. What the queries
hand to one another goes by whole batches only, as a batch written anew would be
read again. A run that is broken off is finished by the next one.

The second form writes what is kept of the tables audits, events and offenses in
<in> to <out>, as for tables that were made otherwise. A scheduler runs either each
RETENTION_EVERY_S.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guildward import schemas, tables
from guildward.config import Config
from guildward.operators import retention
from guildward.plans.console import Console
from guildward.streaming.moderation import OFFENSE_LOG, typed

TABLES = ("audits", "events", "offenses")
_STORED = {"audits": schemas.AUDITS, "events": schemas.AUDIT_EVENTS, "changes": schemas.AUDIT_CHANGES, "offenses": OFFENSE_LOG}
#: What the queries hand on, or have decided; rows have guild_id and t_ms.
_HANDED_ON = ("chosen", "asked", "requests", "reviews", "confirmed", "decisions")


def _now(now_ms: int | None) -> int:
    return int(time.time() * 1000) if now_ms is None else now_ms


def run(spark: SparkSession, settings: Config, source: str, target: str, now_ms: int | None = None) -> dict[str, int]:
    """Rows that went, by table; source and target must be different folders, neither inside the other."""
    a, b = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath().rstrip("/") + "/" for p in (source, target))
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{source} and {target} must be apart: what is kept would be written over what is read")
    before = [spark.read.parquet(f"{source}/{t}") for t in TABLES]
    gone = {}
    for name, old, kept in zip(TABLES, before, Console(settings).retained(*before, _now(now_ms)), strict=True):
        kept.write.mode("overwrite").parquet(f"{target}/{name}")
        gone[name] = old.count() - spark.read.parquet(f"{target}/{name}").count()
    return gone


def _read(spark: SparkSession, folder: str, name: str, paths: list[str] | None = None) -> DataFrame:
    reader = spark.read.schema(_STORED[name]).option("recursiveFileLookup", "true")
    return reader.parquet(*(paths or [tables.make_folder(spark, f"{folder}/{name}")]))


def _old(df: DataFrame, name: str, settings: Config, now_ms: int) -> Column:
    if name == "audits":
        return retention.old_audits(df, settings, now_ms)
    if name == "events":
        return retention.old_events(df, settings, now_ms, "_guild")
    if name == "offenses":
        return retention.old_offenses(df, settings, now_ms)
    # a change of state is no older than its audit, and goes with it
    return retention.in_scope(settings, "_guild") & retention.before(df, "updated", retention.audit_cutoff(now_ms, settings.audit_retention_days))


def _with_guild(df: DataFrame, name: str, settings: Config, audits: DataFrame) -> DataFrame:
    """Events and changes with their guild, which is asked for only where the settings name guilds."""
    if name not in ("events", "changes"):
        return df
    return retention.with_guild(df, audits) if settings.guild_ids else df.withColumn("_guild", F.lit(""))


def finish(spark: SparkSession, folder: str) -> None:
    """Puts batches in their places that a broken run had written, but not moved."""
    staged = f"{folder}/_kept"
    for path in tables.folders(spark, staged, "batch="):
        if tables.exists(spark, f"{path}/_SUCCESS"):
            target = folder + path[path.index("/_kept/") + len("/_kept") :]
            tables.delete(spark, target)
            tables.move(spark, path, target)
    tables.delete(spark, staged)


def _passed(spark: SparkSession, settings: Config, folder: str, name: str, now_ms: int) -> list[str]:
    """Batches of which every row is old. Rows of audits that are kept for another guild keep their batch."""
    rows = spark.read.schema("guild_id string, t_ms long").option("recursiveFileLookup", "true").parquet(tables.make_folder(spark, f"{folder}/{name}"))
    old = retention.in_scope(settings) & (F.col("t_ms") < retention.audit_cutoff(now_ms, settings.audit_retention_days))
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*/batch=\d+)/", 1)
    batches = rows.select(batch.alias("_batch"), F.coalesce(old, F.lit(False)).alias("_old")).groupBy("_batch").agg(F.min("_old").alias("_old"))
    return [r[0] for r in batches.where("_old").select("_batch").collect()]


def prune(spark: SparkSession, settings: Config, folder: str, now_ms: int | None = None) -> dict[str, int]:
    """Clears the tables of a Moderation's folder; rows that went, by table. Events and changes go by the audits as they were."""
    now_ms = _now(now_ms)
    finish(spark, folder)
    audits = _read(spark, folder, "audits").select("trace_id", "guild_id", "id")
    gone, staged = {}, []
    for name, ddl in _STORED.items():
        batch = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*/batch=\d+)/", 1)
        df = _with_guild(_read(spark, folder, name).withColumn("_batch", batch), name, settings, audits)
        touched = [r[0] for r in df.where(_old(df, name, settings, now_ms)).select("_batch").distinct().collect()]
        gone[name] = 0
        for path in touched:
            rows = _with_guild(_read(spark, folder, name, [path]), name, settings, audits)
            rows = rows.withColumn("_old", F.coalesce(_old(rows, name, settings, now_ms), F.lit(False)))
            n, old = rows.agg(F.count("*"), F.count_if("_old")).first()
            gone[name] += old
            target = f"{folder}/_kept/{path[path.rindex('/' + name + '/') + 1 :]}"
            typed(rows.where("not _old"), ddl).write.mode("overwrite").parquet(target)
            staged.append((path, target, n == old))
    passed = [path for name in _HANDED_ON for path in _passed(spark, settings, folder, name, now_ms)]
    # all reads are done: only now are batches replaced
    for path in passed:
        tables.delete(spark, path)
    for path, target, empty in staged:
        tables.delete(spark, path)
        if empty:
            tables.delete(spark, target)
        else:
            tables.move(spark, target, path)
    tables.delete(spark, f"{folder}/_kept")
    return gone


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    if sys.argv[1] == "--copy":
        print(run(session, Config(guild_ids=tuple(sys.argv[4:])), sys.argv[2], sys.argv[3]))
    else:
        print(prune(session, Config(guild_ids=tuple(sys.argv[2:])), sys.argv[1]))
    session.stop()
