"""Audits and their events as append-only rows, reviews, and the latest state of each audit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward import config, schemas
from guildward.functions import review_json, text
from guildward.operators import signals as sig
from guildward.operators.identity import carried, named, row_key, split, told_by, trace_key
from guildward.operators.review_queue import occupancy
from guildward.tables import unsettled

STAGES = {"behavior": "behavior", "access": "access"}


def trace(df: DataFrame) -> DataFrame:
    return df.withColumn("trace_id", text.trace_id(F.col("guild_id"), trace_key(df)))


def hit_events(signals: DataFrame) -> DataFrame:
    """A hit event for each initial signal."""
    keyword = F.col("code").isin("redline_keyword", "sensitive_keyword")
    stage = text.mapped(F.col("source"), STAGES, F.when(keyword, "keyword").otherwise("detection"))
    return event(signals, stage, F.lit("hit"))


def event(signals: DataFrame, stage: Column, result: Column, evidence: Column | None = None) -> DataFrame:
    evidence = F.col("evidence") if evidence is None else evidence
    return trace(signals).select(
        "trace_id",
        stage.alias("stage"),
        F.col("code").alias("signal_code"),
        result.alias("result"),
        F.left("pattern", F.lit(config.PATTERN_LIMIT)).alias("pattern"),
        F.left(evidence, F.lit(config.EVIDENCE_LIMIT)).alias("evidence"),
        "t_ms",
        "seq",
    )


def audits(decisions: DataFrame, status: Column) -> DataFrame:
    """An audit for each decision that asks for one; content is cut."""
    if "stored" in decisions.columns:
        content = F.coalesce("stored", F.lit(""))
    else:
        content = F.left(F.coalesce("content", F.lit("")), F.lit(config.CONTENT_LIMIT)) if "content" in decisions.columns else F.lit("")
    return trace(decisions.where("write_audit")).select(
        "trace_id", "guild_id", "user_id", "message_id", "rule_id", F.col("code").alias("signal_code"), "source", "pattern", "evidence",
        F.col("final_action").alias("action"), status.alias("status"), "offense_count", (F.col("code") == "ai_review").alias("reviewed_by_ai"),
        content.alias("content"), "t_ms", *(["channel_id"] if "channel_id" in decisions.columns else []),
    )


def decision_events(audits: DataFrame) -> DataFrame:
    """The event that goes with each audit."""
    return audits.select(
        "trace_id", F.lit("decision").alias("stage"), "signal_code", F.col("status").alias("result"),
        F.left("pattern", F.lit(config.PATTERN_LIMIT)).alias("pattern"), F.left("evidence", F.lit(config.EVIDENCE_LIMIT)).alias("evidence"),
        "t_ms", F.lit(101).alias("seq"),
    )


def request_audits(requests: DataFrame) -> DataFrame:
    """Audits of reviews that are skipped, wait, or end without offense; confirmed ones are audited as decisions."""
    silent = requests.where("status <> 'confirmed'").select(
        "message_id", "guild_id", "user_id", "t_ms", F.lit("ai_review").alias("code"), F.lit("content").alias("source"), F.lit("").alias("pattern"),
        "evidence", F.lit("silent").alias("final_action"), F.lit(0).cast("long").alias("rule_id"), F.lit(0).alias("offense_count"),
        F.lit(True).alias("write_audit"), "content", "status", *(c for c in ("stored", "channel_id") if c in requests.columns), *carried(requests),
    )
    return audits(silent, F.col("status")).withColumn("reviewed_by_ai", F.col("status") == "dismissed")


def request_events(requests: DataFrame) -> DataFrame:
    """The review's event of each request, with its present status."""
    return trace(requests).select(
        "trace_id", F.lit("ai_review").alias("stage"), F.lit("ai_review").alias("signal_code"), F.col("status").alias("result"),
        F.lit("").alias("pattern"), F.left("evidence", F.lit(config.EVIDENCE_LIMIT)).alias("evidence"), "t_ms", F.lit(100).alias("seq"),
    )


def review_requests(
    candidates: DataFrame, enabled: bool, model: str = "", prompt: str = review_json.PROMPT, capacity: int | None = None, answers: DataFrame | None = None
) -> DataFrame:
    """A request per message with candidate signals (and content): status, request JSON.

    Disabled reviews are skipped; a key that was queued within 24 hours before is
    a duplicate, whether or not it failed. capacity bounds the queue: a request
    that finds so many waiting or running fails. A request leaves the queue with
    its answer; without answers none does, so the first ones in time fill it.
    """
    return queued(asked(candidates, model, prompt), enabled, capacity, answers)


def asked(candidates: DataFrame, model: str = "", prompt: str = review_json.PROMPT) -> DataFrame:
    """A row per message with candidate signals: review_key, and the request as JSON."""
    return worded(grouped(candidates), model, prompt)


def grouped(candidates: DataFrame) -> DataFrame:
    """``asked`` without the request, which ``worded`` adds. Candidates may lack the texts till then, so these need not be dealt with the rows."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "pattern", "evidence")))
    texts = [F.first(c).alias(c) for c in ("content", "stored", "short", "channel_id") if c in candidates.columns]
    df = candidates.groupBy(*sig.KEY, *named(candidates)).agg(ordered.alias("_s"), *texts)
    return df.withColumn("review_key", told_by())


def judged(signals: DataFrame, results: DataFrame) -> DataFrame:
    """``grouped`` where the classifier was asked, of all signals and of messages with their results (``signals.scored``).

    A review asks about a message's candidates, with the results that send it to
    review, or about these alone if there are none. Other results ask nothing;
    without any the candidates are asked about as they are. Signals and results of
    a message meet in one group, so each is dealt out once.
    """
    key, at = [*sig.KEY, *named(signals)], "struct<seq:int,pattern:string,evidence:string>"
    candidate = F.when(F.col("needs_ai"), F.struct("seq", "pattern", "evidence").cast(at))
    own = signals.where(F.col("needs_ai") | sig.at_once()).select(*key, candidate.alias("_c"), sig.at_once().alias("_now"))
    said = F.struct("status", F.when(F.col("status") == "review", sig.model_evidence()).alias("said"))
    told = results.select(*key, F.lit(None).cast(at).alias("_c"), F.lit(False).alias("_now"), said.alias("_r"))
    # dealt as rows, which are shorter than the lists that a sum before the shuffle would make of them
    df = own.unionByName(told, allowMissingColumns=True).repartition(row_key(signals)).groupBy(*key)
    df = df.agg(F.collect_list("_c").alias("_c"), F.collect_list("_r").alias("_r"), F.max("_now").alias("_now")).where("not _now")
    asks = F.filter("_r", lambda r: r["status"] == "review")
    part = lambda seq, pattern, evidence: F.struct(seq.alias("seq"), pattern.alias("pattern"), evidence.alias("evidence"))
    both = lambda r: F.transform("_c", lambda c: part(c["seq"], c["pattern"], F.concat(c["evidence"], F.lit("；"), r["said"])))
    alone = F.transform(asks, lambda r: part(F.lit(99), F.lit(sig.MODEL_PATTERN), r["said"]))
    asked_ = F.when(F.size("_r") == 0, F.col("_c")).when(F.size("_c") == 0, alone.cast(f"array<{at}>")).otherwise(F.flatten(F.transform(asks, both)).cast(f"array<{at}>"))
    df = df.withColumn("_s", F.array_sort(asked_)).where(F.size("_s") > 0)
    return df.select(*key, "_s").withColumn("review_key", told_by())


def worded(df: DataFrame, model: str = "", prompt: str = review_json.PROMPT) -> DataFrame:
    """Rows that ``grouped`` made, with the content of their messages: the request as JSON."""
    patterns = F.filter(F.transform("_s", lambda s: s["pattern"]), lambda p: p != "")
    body = review_json.request(F.lit(model), F.col("content"), patterns, F.transform("_s", lambda s: s["evidence"]), prompt)
    return df.withColumn("request", body).drop("_s")


def queued(
    df: DataFrame, enabled: bool, capacity: int | None = None, answers: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] = unsettled
) -> DataFrame:
    """Rows that ``asked`` or ``grouped`` made, with status and evidence. Column duplicate, if it is there, tells what is known to be one; it goes.

    settle writes a table and reads it back, as the queue is swept several times.
    With it only keys that are there more than once are dealt out to find duplicates.
    """
    if not enabled:
        return df.drop("duplicate").withColumn("status", F.lit("skipped")).withColumn("evidence", F.lit("AI 复核未启用或未配置 API Key"))
    if "duplicate" not in df.columns and settle is unsettled:
        df = deduplicated(df)
    elif "duplicate" not in df.columns:
        df = settle(df)
        single, several = split(df, F.col("review_key"), settle)
        parts = [] if single is None else [single.withColumn("duplicate", F.lit(False))]
        df = reduce(DataFrame.unionByName, parts if several is None else [*parts, deduplicated(several)])
    status = F.when(F.col("duplicate"), "duplicate").otherwise("pending")
    df = df.withColumn("status", status).withColumn("evidence", F.when(F.col("duplicate"), "重复消息复核任务").otherwise("等待 AI 复核")).drop("duplicate")
    if capacity is None:
        return df
    if answers is not None:
        df = settle(df)
        done = answers.groupBy("review_key").agg(F.min("done_ms").alias("done_ms"))
        held = occupancy(df.where("status = 'pending'").join(done, "review_key", "left"), capacity).drop("done_ms", "queued", "running")
        refused = {"status": F.when(F.col("full"), "failed").otherwise(F.col("status")), "evidence": F.when(F.col("full"), "AI 复核队列已满").otherwise(F.col("evidence"))}
        return held.withColumns(refused).drop("full").unionByName(df.where("status <> 'pending'"))
    taken = df.where("status = 'pending'").orderBy("t_ms", "message_id").limit(capacity).select(row_key(df), F.lit(True).alias("_taken"))
    df = df.join(F.broadcast(taken), row_key(df), "left")
    full = (F.col("status") == "pending") & F.col("_taken").isNull()
    return df.withColumns({"evidence": F.when(full, "AI 复核队列已满").otherwise(F.col("evidence")), "status": F.when(full, "failed").otherwise(F.col("status"))}).drop("_taken")


def deduplicated(requests: DataFrame, window_ms: int = config.REVIEW_WINDOW_MS, key: str = "review_key") -> DataFrame:
    """requests with duplicate: true within window_ms of the key's last one that was queued.

    Which one was queued last depends on all before it in its run, so runs that
    are longer than the window go through a fold, which reads its sorted partition
    as a stream and remembers one time.
    """
    order = ["t_ms", "message_id", *carried(requests)]
    w = Window.partitionBy(key).orderBy(*order)
    close = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) < window_ms, F.lit(False))
    df = requests.withColumn("_close", close)
    # a request no earlier than window_ms after its forerunner starts anew, whatever came before
    df = df.withColumn("_run", F.sum((~F.col("_close")).cast("int")).over(w))
    run = Window.partitionBy(key, "_run")
    df = df.withColumn("_span", F.max("t_ms").over(run) - F.min("t_ms").over(run))
    # in a run shorter than the window only its first request is queued
    first = F.row_number().over(run.orderBy(*order)) == 1
    short = df.withColumn("duplicate", ~first).where(F.col("_span") < window_ms).drop("_close", "_run", "_span")
    names = requests.columns
    schema = T.StructType([*requests.schema.fields, T.StructField("duplicate", T.BooleanType())])

    def fold(batches):
        of, last = None, None
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            out = []
            for k, r, t in zip(column(key), column("_run"), column("t_ms"), strict=True):
                if (k, r) != of or t - last >= window_ms:
                    of, last = (k, r), t
                    out.append(False)
                else:
                    out.append(True)
            own = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.bool_())], names=schema.names)

    long = df.where(F.col("_span") >= window_ms).select(*names, "_run")
    long = long.repartition(key, "_run").sortWithinPartitions(key, "_run", *order)
    return short.select(*names, "duplicate").unionByName(long.mapInArrow(fold, schema))


def reviewed(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Pending requests with their answers (review_key, raw, done_ms): status, reason, category; idempotent by key.

    A valid answer dismisses or confirms; an invalid one fails; without answer the
    request stays pending.
    """
    once = answers.groupBy("review_key").agg(F.min_by(F.struct("raw", "done_ms"), "done_ms").alias("a"))
    df = requests.where("status = 'pending'").join(once, "review_key", "left").withColumn("r", review_json.parse(F.col("a.raw")))
    status = F.when(F.col("a").isNull(), "pending").when(F.col("r").isNull(), "failed").when(F.col("r.violation"), "confirmed").otherwise("dismissed")
    reason = F.when(F.coalesce("r.reason", F.lit("")) != "", F.col("r.reason"))
    evidence = F.when(F.col("r.violation"), F.coalesce(reason, F.col("r.category"))).otherwise(F.coalesce(reason, F.lit("AI 判定为不违规")))
    return df.select(
        *[c for c in requests.columns if c not in ("status", "evidence")],
        status.alias("status"),
        F.when(F.col("r").isNotNull(), evidence).otherwise(F.col("evidence")).alias("evidence"),
        F.col("r.category").alias("category_label"),
        F.col("a.done_ms").alias("done_ms"),
    )


def confirmed_signals(reviews: DataFrame) -> DataFrame:
    """Offenses of confirmed reviews, at the time of their completion."""
    return reviews.where("status = 'confirmed'").select(
        "message_id", "guild_id", "user_id", F.col("done_ms").alias("t_ms"), F.lit(0).alias("seq"), F.lit("ai_review").alias("code"),
        F.lit("content").alias("source"), F.lit("消息内容经 AI 复核确认违规").alias("public_reason"), "evidence", F.lit("").alias("pattern"),
        F.lit("delete").alias("action"), F.lit(False).alias("needs_ai"), F.lit(0).cast("long").alias("rule_id"),
        F.lit(True).alias("counts_as_offense"), F.lit(True).alias("write_audit"), F.col("category_label").alias("content_label"), *named(reviews),
    )


def batch_ids(number: int, writer: int = 0) -> Column:
    """Ids of the rows of batch ``number``: greater than those of the writer's earlier batches, without a shuffle.

    24 bits tell the batch, 2 which of several queries writes the table, 13 the partition, 24 the row in it.
    """
    place = F.monotonically_increasing_id()
    return F.lit((number << 39) + (writer << 37)) + F.shiftright(place, 33) * F.lit(1 << 24) + place.bitwiseAND(F.lit((1 << 33) - 1))


def stored(audits: DataFrame, number: int = 0, writer: int = 0) -> DataFrame:
    """Audits as rows to append to the audit table (schemas.AUDITS)."""
    at = F.timestamp_millis("t_ms")
    channel = F.coalesce("channel_id", F.lit("")) if "channel_id" in audits.columns else F.lit("")
    df = audits.withColumns({"id": batch_ids(number, writer), "channel_id": channel, "created_at": at, "updated_at": at})
    return _typed(df, schemas.AUDITS)


def stored_events(events: DataFrame, number: int = 0, writer: int = 0) -> DataFrame:
    """Events as rows to append to the event table (schemas.AUDIT_EVENTS), in a trace's order; those without a trace are left out."""
    df = events.where(F.coalesce("trace_id", F.lit("")) != "").withColumn("created_at", F.timestamp_millis("t_ms"))
    return _typed(df.sortWithinPartitions("t_ms", "seq").withColumn("id", batch_ids(number, writer)), schemas.AUDIT_EVENTS)


def _typed(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl).fields])


def review_updates(done: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of answered reviews: rows for the append-only log of audit states (schemas.AUDIT_CHANGES), and their events.

    decisions, or columns of done, tell the action and the offense count of those
    confirmed; without them the action is the signal's own. Each change makes an event of the review,
    and one of the decision unless it is pending still.
    """
    changed = trace(done.where("status <> 'pending'"))
    confirmed, own = F.col("status") == "confirmed", row_key(done)
    if decisions is not None:
        made = decisions.where("code = 'ai_review'").select(own, "final_action", "offense_count")
        changed = changed.drop("final_action", "offense_count").join(made, own, "left")
    elif "final_action" not in changed.columns:
        changed = changed.withColumns({"final_action": F.lit(None).cast("string"), "offense_count": F.lit(None).cast("int")})
    action = F.when(confirmed, F.coalesce("final_action", F.lit("delete"))).otherwise("silent")
    count = F.when(confirmed, F.coalesce("offense_count", F.lit(0))).otherwise(0)
    log = changed.select(
        "trace_id", "status", action.alias("action"), count.alias("offense_count"), (confirmed | (F.col("status") == "dismissed")).alias("reviewed_by_ai"), "evidence",
        F.coalesce("done_ms", "t_ms").alias("updated_ms"),
    )
    evidence = F.left("evidence", F.lit(config.EVIDENCE_LIMIT))
    event_ = lambda stage, seq: log.select(
        "trace_id", F.lit(stage).alias("stage"), F.lit("ai_review").alias("signal_code"), F.col("status").alias("result"), F.lit("").alias("pattern"),
        evidence.alias("evidence"), F.col("updated_ms").alias("t_ms"), F.lit(seq).alias("seq"),
    )
    return log, event_("ai_review", 102).unionByName(event_("decision", 103))


def current(audits: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored audits (schemas.AUDITS) as they are after the log of their states: a review's audit shows its trace's last one.

    Other audits of the trace, as that of a flood, are as they were.
    """
    patched = ("status", "action", "offense_count", "reviewed_by_ai", "evidence")
    last = latest(changes.select("trace_id", "updated_ms", *patched), "trace_id", "updated_ms", "status")
    last = last.select(F.col("trace_id").alias("_trace"), F.struct("updated_ms", *patched).alias("_new"))
    df = audits.join(last, (F.col("trace_id") == F.col("_trace")) & (F.col("signal_code") == "ai_review"), "left")
    new = {c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in patched}
    if "updated_at" in audits.columns:
        new["updated_at"] = F.coalesce(F.timestamp_millis("_new.updated_ms"), "updated_at")
    return df.withColumns(new).select(*audits.columns)


def latest(changes: DataFrame, key: str = "audit_id", time: str = "updated_ms", tie: str = "seq") -> DataFrame:
    """The last row of each audit in an append-only log of its states."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("s"))
    return last.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])
