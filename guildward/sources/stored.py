"""Small tables that people edit (rules, access lists, offenses): versions in a folder, each committed in one step.

A version is a folder v=<number> of Parquet files. An edit is made from the version
that was read and becomes the next one by renaming a finished folder; if another
edit has become it meanwhile, the rename fails and the edit is made again from what
is there now. Readers see whole versions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildward import schemas, tables
from guildward.operators import rules
from guildward.sources import wordlists


class Conflict(Exception):
    """Another edit of the same version was committed first."""


class Stored:
    """The versions of one table. Listeners are called after each commit, as to drop what is kept of the table."""

    #: Times that an edit is made anew after a conflict, and versions that stay for those who read them.
    ATTEMPTS, KEPT = 5, 10

    def __init__(self, spark: SparkSession, folder: str, ddl: str, listeners: tuple[Callable[[], None], ...] = ()):
        self.spark, self.folder, self.ddl, self.listeners = spark, folder.rstrip("/"), ddl, listeners

    def versions(self) -> list[int]:
        return sorted(int(p.rpartition("=")[2]) for p in tables.folders(self.spark, self.folder, "v="))

    def _path(self, version: int) -> str:
        return f"{self.folder}/v={version}"

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last one if none is named; before the first the table is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(self._path(version))

    def commit(self, table: DataFrame, based_on: int) -> int:
        """Makes table the version after based_on; Conflict if there is one already."""
        if tables.exists(self.spark, self._path(based_on + 1)):
            raise Conflict(f"version {based_on + 1} of {self.folder} is another's")
        staged = f"{self.folder}/_staged/{uuid.uuid4().hex}"
        table.select(*self.read(0).columns).write.parquet(staged)
        try:
            tables.move(self.spark, staged, self._path(based_on + 1))
        except OSError as error:
            tables.delete(self.spark, staged)
            raise Conflict(f"version {based_on + 1} of {self.folder} is another's") from error
        for old in self.versions()[: -self.KEPT]:
            tables.delete(self.spark, self._path(old))
        for told in self.listeners:
            told()
        return based_on + 1

    def edit(self, change: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> int:
        """Commits change(table), made anew from the last version after a conflict; the version that it became."""
        for left in range(attempts - 1, -1, -1):
            version = max(self.versions(), default=0)
            try:
                return self.commit(change(self.read(version)), version)
            except Conflict:
                if not left:
                    raise
        raise ValueError("an edit needs an attempt at least")


def import_wordlist(store: Stored, guild_id: str, scope: str, content: str, created_by: str, now, attempts: int = Stored.ATTEMPTS) -> DataFrame:
    """Adds the list's new patterns to a stored rule table; one row of counters.

    Patterns that could not be stored, as others' edits came first each time, are counted as failed.
    """
    wordlists.check_text(content)
    numbered = wordlists.lines(store.spark.createDataFrame([(content,)], "text string"))
    patterns = wordlists.patterns(numbered)
    asked = 0

    def change(table: DataFrame) -> DataFrame:
        nonlocal asked
        after = rules.insert(table, patterns, guild_id, scope, created_by, now)
        asked = after.count() - table.count()
        return after

    try:
        store.edit(change, attempts)
        failed = 0
    except Conflict:
        failed = asked
    counted = wordlists.counters(numbered).withColumn("created_count", F.lit(asked - failed).cast("long"))
    return counted.withColumns({"known_count": F.col("pattern_count") - asked, "failed_count": F.lit(failed).cast("long")})


def rule_table(spark: SparkSession, folder: str, *listeners: Callable[[], None]) -> Stored:
    return Stored(spark, folder, schemas.RULES, listeners)


def access_table(spark: SparkSession, folder: str, *listeners: Callable[[], None]) -> Stored:
    return Stored(spark, folder, schemas.ACCESS, listeners)
