"""The console's queries and commands over the engine's tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward import schemas
from guildward.config import Config
from guildward.functions import text
from guildward.operators import audit, gates, offenses, retention, rules
from guildward.sources import wordlists


def page_of(page=None, size=None, default: int = 25) -> tuple[int, int]:
    """(page from 1, rows of a page at most 100)."""

    def whole(x):
        try:
            return math.floor(float(x))
        except (TypeError, ValueError, OverflowError):
            return 0

    return max(1, whole(page) or 1), min(100, max(1, whole(size) or default))


def last_of(n=None) -> int:
    """A row limit of the chat commands: 1 to 30, 10 if none is given."""
    try:
        return int(min(30, max(1, float(n) or 10)))
    except (TypeError, ValueError):
        return 10


def searched(column: str, search: str | None) -> Column:
    """Case-insensitive containment; a search is text, never a pattern."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(search))) if search else F.lit(True)


def between(column: str, start=None, end=None) -> Column:
    """start <= column < end, either open."""
    ok = F.lit(True)
    ok = ok & (F.col(column) >= F.lit(start)) if start is not None else ok
    return ok & (F.col(column) < F.lit(end)) if end is not None else ok


def days(column: str, first: str | None = None, last: str | None = None) -> Column:
    """Whole days of the session's time zone, the last one included."""
    start = F.to_timestamp(F.lit(first)) if first else None
    end = F.to_timestamp(F.date_add(F.to_date(F.lit(last)), 1)) if last else None
    ok = F.col(column) >= start if start is not None else F.lit(True)
    return ok & (F.col(column) < end) if end is not None else ok


def equal(**wanted) -> Column:
    """Equality for every value given."""
    ok = F.lit(True)
    for c, v in wanted.items():
        ok = ok & (F.col(c) == F.lit(v)) if v else ok
    return ok


RECORDS = {"rule": schemas.RULES, "audit": schemas.AUDITS, "event": schemas.AUDIT_EVENTS, "offense": schemas.OFFENSES}
#: Columns with closed values, and what their labels are of.
LABELLED = {"signal_code": "signal", "last_signal_code": "signal", "action": "action", "last_action": "action", "status": "status", "stage": "stage", "result": "result"}


#: Rows that are passed over by sorting; a page further down is found by counts over spans of its order.
SHALLOW_ROWS = 10_000
#: Widths of spans, from wide to narrow: of times in milliseconds, of ids. A span of more than SHALLOW_ROWS is counted by the next width.
TIME_SPANS, ID_SPANS = (86_400_000, 3_600_000, 60_000, 1_000), (1 << 24, 1 << 19, 1 << 14)


class Listing:
    """One page of a list; the total is counted when it is asked for, as by unpacking (rows, total), or comes with the rows by ``fetch``."""

    def __init__(self, rows: Callable[[DataFrame], DataFrame], whole: DataFrame, total: int | None = None):
        self._page, self.rows, self._whole, self._total = rows, rows(whole), whole, total

    def fetch(self) -> tuple[list, int]:
        """The page's rows and the total, by one job."""
        if self._total is not None:
            return self.rows.collect(), self._total
        seen = Observation()
        rows = self._page(self._whole.observe(seen, F.count(F.lit(1)).alias("n"))).collect()
        self._total = seen.get["n"]
        return rows, self._total

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self._whole.count()
        return self._total

    def __iter__(self):
        yield self.rows
        yield self.total


def span_of(df: DataFrame, place: Column, widths: tuple, down: bool, skip: int, n: int) -> tuple:
    """(low, high, rows before, total): the span of place that holds rows skip to skip + n of the order, found by counts; rows without a place come last."""
    found, total, edge = [], None, None
    for width in widths:
        part = df if edge is None else df.where((place >= edge[0]) & (place < edge[1]))
        counts = part.groupBy(F.floor(place / width).alias("s")).agg(F.count("*").alias("n")).collect()
        rows = [(r["s"] * width, (r["s"] + 1) * width, r["n"]) for r in counts if r["s"] is not None]
        if total is None:
            total, found = sum(r["n"] for r in counts), rows
        else:  # the span that was too large gives way to its parts
            found = [x for x in found if x[:2] != edge] + rows
        found.sort(reverse=down)
        before = 0
        for low, high, m in found:
            if before + m > skip:
                break
            before += m
        else:  # among those without a place, or beyond the end
            return None, None, 0, total
        if m <= SHALLOW_ROWS:
            break
        edge = (low, high)
    held, last = m, (low, high)
    for x in found[found.index((low, high, m)) + 1 :]:
        if before + held >= skip + n:
            break
        held, last = held + x[2], x[:2]
    if before + held < min(skip + n, total):  # the page goes on to rows without a place
        return None, None, 0, total
    return min(low, last[0]), max(high, last[1]), before, total


class Console:
    """Queries return DataFrames, lists a Listing; changes return new versions of a table."""

    def __init__(self, config: Config):
        self.config = config

    def _guild(self, guild_id: str) -> str:
        rules.require(bool(guild_id) and self.config.in_scope(guild_id), "the guild is missing or out of scope")
        return guild_id

    def _listed(self, df: DataFrame, order: list[Column], page, size, default: int, place: Column | None = None, spans: tuple = (), down: bool = False) -> Listing:
        """place: what leads the order, as a number, with the widths of its spans; down: the greatest first."""
        p, n = page_of(page, size, default)
        skip = (p - 1) * n
        if place is None or skip <= SHALLOW_ROWS:
            return Listing(lambda whole: whole.orderBy(*order).offset(skip).limit(n), df)
        low, high, before, total = span_of(df, place, spans, down, skip, n)
        inside = (place >= low) & (place < high) if low is not None else F.lit(True)
        return Listing(lambda whole: whole.where(inside).orderBy(*order).offset(skip - before).limit(n), df, total)

    def records(self, df: DataFrame, kind: str) -> DataFrame:
        """The columns that the console shows of rules, audits, events or offenses, in their order, with the labels of the closed ones."""
        df = df.select(*T.StructType.fromDDL(RECORDS[kind]).fieldNames())
        shown = {c: of for c, of in LABELLED.items() if c in df.columns}
        return df.withColumns({f"{c}_label": text.label(F.col(c), of) for c, of in shown.items()})

    def groups(self, table: DataFrame) -> DataFrame:
        """(guild_id, rule_count, enabled_count); configured guilds without rules are there with zeros."""
        counts = table.where((F.coalesce("guild_id", F.lit("")) != "") & gates.in_scope(self.config))
        counts = counts.groupBy("guild_id").agg(F.count("*").alias("rule_count"), F.count_if("enabled").alias("enabled_count"))
        if self.config.guild_ids:
            zero = table.sparkSession.createDataFrame([(g, 0, 0) for g in self.config.guild_ids], "guild_id string, rule_count long, enabled_count long")
            counts = counts.unionByName(zero).groupBy("guild_id").agg(F.sum("rule_count").alias("rule_count"), F.sum("enabled_count").alias("enabled_count"))
        return counts.orderBy("guild_id")

    def rules(self, table: DataFrame, guild_id: str, scope: str | None = None, search: str | None = None, page=None, size=None):
        df = table.where((F.col("guild_id") == self._guild(guild_id)) & equal(scope=scope) & searched("pattern", search))
        return self._listed(df.where(F.col("scope").isin(*schemas.SCOPES)), [F.col("id")], page, size, 50, F.col("id"), ID_SPANS)

    def audits(
        self, table: DataFrame, guild_id: str, user_id=None, signal_code=None, status=None, search=None, start=None, end=None, page=None, size=None,
        changes: DataFrame | None = None,
    ):
        """changes: the log of audit states (schemas.AUDIT_CHANGES), which is applied before anything is looked for."""
        if changes is not None:
            table = audit.current(table.where(F.col("guild_id") == self._guild(guild_id)), changes)
        ok = equal(user_id=user_id, signal_code=signal_code, status=status) & searched("pattern", search) & between("created_at", start, end)
        return self._listed(table.where((F.col("guild_id") == self._guild(guild_id)) & ok), [F.desc("created_at"), F.desc("id")], page, size, 25, F.unix_millis("created_at"), TIME_SPANS, down=True)

    def audit_events(self, events: DataFrame, table: DataFrame, guild_id: str, trace_id: str) -> DataFrame:
        """Events of a trace, in order, if an audit of the guild has it."""
        mine = table.where((F.col("guild_id") == self._guild(guild_id)) & (F.col("trace_id") == trace_id)).select("trace_id")
        return events.where(F.col("trace_id") == trace_id).join(mine, "trace_id", "left_semi").orderBy("created_at", "id")

    def offenses(self, table: DataFrame, guild_id: str, now_ms: int, user_id=None, page=None, size=None):
        mine = table.where((F.col("guild_id") == self._guild(guild_id)) & equal(user_id=user_id))
        df = offenses.active(mine, now_ms, self.config.policy().window_ms)
        return self._listed(df, [F.desc("offense_count"), F.desc("updated_ms"), F.col("user_id"), F.col("category")], page, size, 25)

    def recent_audits(self, table: DataFrame, guild_id: str, n=None) -> DataFrame:
        return table.where(F.col("guild_id") == guild_id).orderBy(F.desc("id")).limit(last_of(n))

    def top_offenders(self, table: DataFrame, guild_id: str, now_ms: int, n=None) -> DataFrame:
        df = offenses.active(table.where(F.col("guild_id") == guild_id), now_ms, self.config.policy().window_ms)
        return df.orderBy(F.desc("offense_count"), F.desc("updated_ms"), "user_id", "category").limit(last_of(n))

    def import_wordlist(self, table: DataFrame, guild_id: str, scope: str, content: str, created_by: str, now: Column) -> tuple[DataFrame, DataFrame]:
        """The rules with the list's new patterns, and one row of counters."""
        wordlists.check_text(content)
        spark = table.sparkSession
        numbered = wordlists.lines(spark.createDataFrame([(content,)], "text string"))
        patterns = wordlists.patterns(numbered)
        wanted = rules.new_patterns(patterns, table, self._guild(guild_id), scope)
        after = rules.insert(table, patterns, guild_id, scope, created_by, now)
        created, asked = after.count() - table.count(), wanted.count()
        counted = wordlists.counters(numbered).withColumn("created_count", F.lit(created))
        more = {"known_count": F.col("pattern_count") - asked, "failed_count": F.lit(asked - created)}
        return after, counted.withColumns(more)

    def create_rule(self, table: DataFrame, guild_id: str, scope: str, pattern: str, created_by: str, now: Column) -> DataFrame:
        new = table.sparkSession.createDataFrame([(0, pattern)], "line_no int, pattern string")
        after = rules.insert(table, new, self._guild(guild_id), scope, created_by, now)
        rules.require(after.count() > table.count(), "the pattern is empty after normalization, or the guild has it already")
        return after

    def update_rule(self, table: DataFrame, guild_id: str, rule_id: int, scope: str, pattern: str, enabled: bool) -> DataFrame:
        return rules.update(table, self._guild(guild_id), rule_id, scope, pattern, enabled)

    def delete_rule(self, table: DataFrame, guild_id: str, rule_id: int) -> DataFrame:
        return rules.delete(table, self._guild(guild_id), rule_id)

    def delete_group(self, table: DataFrame, guild_id: str) -> tuple[DataFrame, int]:
        return rules.delete_guild(table, self._guild(guild_id))

    def clear_offense(self, table: DataFrame, guild_id: str, user_id: str) -> DataFrame:
        return rules.clear_offenses(table, self._guild(guild_id), user_id)

    def access_list(self, table: DataFrame, guild_id: str, list_type: str) -> DataFrame:
        rows = table.where((F.col("guild_id") == guild_id) & (F.col("list_type") == list_type))
        return rows.orderBy("id").select("id", rules.access_entry().alias("entry"))

    def retained(self, audits: DataFrame, events: DataFrame, kept_offenses: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What a retention run leaves of the three tables; events go by the audits as they were."""
        c = self.config
        return retention.kept_audits(audits, c, now_ms), retention.kept_events(events, audits, c, now_ms), retention.kept_offenses(kept_offenses, c, now_ms)
