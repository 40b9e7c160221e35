"""The decision pipeline on streams of messages, answers and clear markers.

Four streaming queries, each of which reads what the one before has written:

1. ``detect``: the limiter, with its state in the state store; per micro-batch the
   gates and signals, with rules and lists read anew when they are older than
   RULES_TTL_S. Writes chosen (signals that decide a message), asked (reviews to
   make) and events.
2. ``review``: the keys of reviews of the last 24 hours in the state store. Writes
   requests, their audits and events.
3. ``answer``: pending requests joined with the stream of answers. Writes reviews and
   their offenses (confirmed).
4. ``conclude``: the offense counter in the state store, over chosen and confirmed
   offenses and clear markers, each at its own time. Writes decisions, audits,
   events, the log of audit states (changes) and of offense states (offenses).

Outputs are folder/<name>/batch=<number>, each written in one step, so that a
repeated batch writes nothing twice and the next query sees whole batches; two
queries that write one output have a folder each below it. What a batch writes
follows the batch's own keys. A user who is on the whitelist passes the limiter
like others, which concerns the state of that user alone, and is dropped then.
Rows are counted in the order of their coming, those of a micro-batch in order of
time. The three inputs of ``conclude`` have a watermark each, the least of which
holds, so a source that is idle delays the clearing of old states only.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from guildward import config, schemas, tables
from guildward.config import Config
from guildward.operators import audit, gates, identity, offenses
from guildward.plans import decisions
from guildward.streaming import stateful
from guildward.tables import Work

_LOG = logging.getLogger(__name__)
_LIMITER = ("exceeded", "triggered", "episode", "retry_after_ms", "debt_ms", "expected_ms", "_time", "_key")
_KEYS = "message_id string, guild_id string, user_id string, t_ms long, message_key string"
_TEXTS = "content string, stored string, short string, channel_id string"
CHOSEN = (
    f"{_KEYS}, seq int, code string, source string, public_reason string, evidence string, pattern string, action string, needs_ai boolean, rule_id long, "
    f"counts_as_offense boolean, write_audit boolean, content_label string, category string, {_TEXTS}"
)
ASKED = f"{_KEYS}, {_TEXTS}, review_key string, request string"
REQUESTS = f"{ASKED}, status string, evidence string"
ANSWERS = "review_key string, raw string, done_ms long"
CLEARS = "guild_id string, user_id string, t_ms long"

Source = Callable[[SparkSession], DataFrame]


class Refreshed:
    """A table that is read again when it is asked for after ttl_s seconds; ``drop`` makes the next use read it."""

    def __init__(self, source: Source, ttl_s: float = config.RULES_TTL_S, clock: Callable[[], float] = time.monotonic):
        self.source, self.ttl_s, self.clock, self.at, self.table = source, ttl_s, clock, None, None

    def __call__(self, spark: SparkSession) -> DataFrame:
        now = self.clock()
        if self.at is None or now - self.at >= self.ttl_s:
            self.table, self.at = self.source(spark), now
        return self.table

    def drop(self) -> None:
        self.at = None


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ddl, null where df lacks them."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl).fields])


class Moderation:
    """Decides messages of a stream; see the module for its outputs."""

    def __init__(self, settings: Config, rules: Source, access: Source, folder: str, capacity: int | None = config.REVIEW_CAPACITY, **more):
        self.settings, self.folder, self.capacity, self.more = settings, folder, capacity, more
        self.rules, self.access = Refreshed(rules), Refreshed(access)

    # ---- streams

    def read(self, spark: SparkSession, name: str, ddl: str, stream: bool = False) -> DataFrame:
        """An output, as a table or as a stream."""
        reader = spark.readStream if stream else spark.read
        path = tables.make_folder(spark, f"{self.folder}/{name}")
        return reader.schema(ddl).option("recursiveFileLookup", "true").parquet(path)

    def stages(self, messages: DataFrame, answers: DataFrame | None = None, clears: DataFrame | None = None, delay: str = "1 minute"):
        """(name, transformed stream, batch function) of the four queries, in their order; each is made when it is asked for."""
        spark = messages.sparkSession
        yield "detect", stateful.limit(gates.gate(messages, self.settings), self.settings.policy(), delay), self.detect
        asked = self.read(spark, "asked", ASKED, stream=True)
        yield "review", stateful.review_keys(asked, delay=delay), self.review
        if answers is not None:
            pending = self.read(spark, "requests", REQUESTS, stream=True).where("status = 'pending'")
            yield "answer", stateful.answered(pending, answers, delay=delay), self.answer
        timed = lambda df: typed(df, CHOSEN + ", clear boolean").withColumn("_time", F.timestamp_millis("t_ms")).withWatermark("_time", delay)
        rows = timed(self.read(spark, "chosen", CHOSEN, stream=True).withColumn("clear", F.lit(False)))
        if answers is not None:
            rows = rows.unionByName(timed(self.read(spark, "confirmed", CHOSEN, stream=True).withColumn("clear", F.lit(False))))
        if clears is not None:
            rows = rows.unionByName(timed(stateful.clear_marks(clears)))
        yield "conclude", stateful.count(rows, self.settings.policy().window_ms, None, tell_clears=True), self.conclude

    def start(
        self, messages: DataFrame, checkpoint: str, answers: DataFrame | None = None, clears: DataFrame | None = None, delay: str = "1 minute", **trigger
    ) -> list[StreamingQuery]:
        """The running queries. With availableNow each one ends before the next begins, so that all that is there goes through."""
        trigger, running = trigger or {"processingTime": "5 seconds"}, []
        for name, rows, batch in self.stages(messages, answers, clears, delay):
            query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger).start()
            if trigger.get("availableNow"):
                query.awaitTermination()
            running.append(query)
        return running

    # ---- micro-batches

    def detect(self, limited: DataFrame, number: int) -> None:
        work = Work(limited.sparkSession)
        try:
            held = work.table(identity.with_key(limited))
            names = [c for c in held.columns if c not in _LIMITER]
            spark = limited.sparkSession
            known = decisions.gather(held.select(*names), self.rules(spark), self.access(spark), self.settings, limited=held, settle=work.table, **self.more)
            chosen = known.told(decisions.selected(known.deterministic))
            self._write(typed(chosen, CHOSEN), "chosen", number)
            self._write(typed(known.worded(known.asked), ASKED), "asked", number)
            events = known.events
            if known.passed is not None:
                passed = work.table(decisions.passed_audits(known))
                self._write(audit.stored(passed, number, 0), "audits/passed", number)
                events = events.unionByName(audit.decision_events(passed))
            self._events(events, "hits", number, 0)
        finally:
            work.close()

    def review(self, asked: DataFrame, number: int) -> None:
        work = Work(asked.sparkSession)
        try:
            capacity = None if self.capacity is None else max(0, self.capacity - self.waiting(asked.sparkSession))
            requests = work.table(audit.queued(asked, decisions.reviews(self.settings), capacity))
            audits = audit.request_audits(requests)
            self._write(audit.stored(audits, number, 1), "audits/requests", number)
            self._events(audit.request_events(requests).unionByName(audit.decision_events(audits)), "requests", number, 1)
            self._write(typed(requests, REQUESTS), "requests", number)
        finally:
            work.close()

    def waiting(self, spark: SparkSession) -> int:
        """How many requests wait or run: queued ones of the last 24 hours without an answer."""
        queued = self.read(spark, "requests", REQUESTS).where("status = 'pending'")
        newest = queued.agg(F.max("t_ms")).first()[0]
        if newest is None:
            return 0
        recent = queued.where(F.col("t_ms") > newest - config.REVIEW_WINDOW_MS)
        return recent.join(self.read(spark, "reviews", f"{_KEYS}, status string").where("status <> 'pending'"), identity.ROW_KEY, "left_anti").count()

    def answer(self, joined: DataFrame, number: int) -> None:
        work = Work(joined.sparkSession)
        try:
            answers = joined.where("done_ms is not null").select("review_key", "raw", "done_ms")
            done = work.table(audit.reviewed(joined.drop("raw", "done_ms").dropDuplicates([identity.ROW_KEY]), answers))
            self._write(done, "reviews", number)
            confirmed = audit.confirmed_signals(done).withColumn("category", offenses.category(F.col("source")))
            texts = done.select(identity.ROW_KEY, *T.StructType.fromDDL(_TEXTS).names)
            self._write(typed(confirmed.join(texts, identity.ROW_KEY), CHOSEN), "confirmed", number)
            log, events = audit.review_updates(done.where("status <> 'confirmed'"))
            self._write(typed(log, schemas.AUDIT_CHANGES), "changes/answers", number)
            self._events(events, "answers", number, 2)
        finally:
            work.close()

    def conclude(self, counted: DataFrame, number: int) -> None:
        work = Work(counted.sparkSession)
        try:
            counted = work.table(counted)
            made = work.table(offenses.decide(counted.where("not clear").drop("clear"), self.settings.policy()))
            self._write(made.drop("first_ms"), "decisions", number)
            reviewed = F.col("code") == "ai_review"
            audits = audit.audits(made.where(~reviewed), F.lit("confirmed"))
            self._write(audit.stored(audits, number, 3), "audits/decisions", number)
            done = made.where(reviewed).withColumns({"status": F.lit("confirmed"), "done_ms": F.col("t_ms")})
            log, events = audit.review_updates(done)
            self._write(typed(log, schemas.AUDIT_CHANGES), "changes/decisions", number)
            self._events(audit.decision_events(audits).unionByName(events), "decisions", number, 3)
            # the last state of each key of the batch; a clear marker leaves one without offenses
            marks = counted.where("clear").groupBy("guild_id", "user_id", "category").agg(F.max("t_ms").alias("updated_ms")).withColumn("offense_count", F.lit(0))
            states = typed(offenses.state(made.where("offense_count > 0"), actions=True), OFFENSE_LOG).unionByName(typed(marks, OFFENSE_LOG))
            self._write(states, "offenses", number)
        finally:
            work.close()

    # ---- tables

    def audits(self, spark: SparkSession) -> DataFrame:
        """The audits as they are now: stored ones, with the log of their states."""
        return audit.current(self.read(spark, "audits", schemas.AUDITS), self.read(spark, "changes", schemas.AUDIT_CHANGES))

    def events(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, "events", schemas.AUDIT_EVENTS)

    def offenses(self, spark: SparkSession) -> DataFrame:
        """The last state of each user and category."""
        key = ["guild_id", "user_id", "category"]
        log = self.read(spark, "offenses", OFFENSE_LOG)
        rest = [c for c in log.columns if c not in key]
        # a marker comes after the offenses of its time
        last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("updated_ms", F.col("offense_count") == 0, "offense_count")).alias("s"))
        return last.select(*key, *[F.col(f"s.{c}").alias(c) for c in rest]).where("offense_count > 0")

    # ---- output

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        void = [F.col(c).cast("string").alias(c) if t == "void" else F.col(c) for c, t in df.dtypes]
        tables.write_once(df.select(*void), self.folder, name, f"batch={number}")

    def _events(self, events: DataFrame, name: str, number: int, writer: int) -> None:
        try:  # a lost event must not stop the decisions that it tells about
            self._write(audit.stored_events(events, number, writer), f"events/{name}", number)
        except Exception:  # noqa: BLE001
            _LOG.warning("the events of batch %s were not written", number, exc_info=True)


OFFENSE_LOG = (
    "guild_id string, user_id string, category string, offense_count int, last_signal_code string, last_pattern string, last_action string, created_ms long, updated_ms long"
)
