"""Flood limiter, offense counter and review deduplication on streams.

State is one small record per key. Within a micro-batch a key's rows are taken
in time order; a row that is older than the key's last one counts as coming at
that time. A key idle for two hours of event time is dropped, which changes
nothing: the limiter has recovered and any cooldown is over by then.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guildward import config, schemas
from guildward.config import Policy
from guildward.operators.flood import State, step
from guildward.operators.identity import ROW_KEY

_FLOOD_RESULTS = "exceeded boolean, triggered boolean, episode boolean, retry_after_ms long, debt_ms long, expected_ms double"
_FLOOD_STATE = "expected double, episode boolean, triggered_at long, policy_key string, last_ms long"


def _with_time(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("_time", F.timestamp_millis("t_ms")).withWatermark("_time", delay)


def limit(messages: DataFrame, policy: Policy, delay: str = "1 minute") -> DataFrame:
    """A stream of messages (message_id, guild_id, user_id, t_ms, any others) with the limiter's results. A change of policy resets the keys."""
    names = [c for c in messages.columns if c not in ("message_id", "t_ms")]
    given = messages.select(F.col("message_id").cast("string").alias("message_id"), "t_ms", *names)
    schema = T.StructType([*given.schema.fields, *T.StructType.fromDDL(_FLOOD_RESULTS).fields])

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s, last = State(), 0
        if state.exists:
            expected, episode, triggered_at, policy_key, last = state.get
            s = State(expected, episode, triggered_at) if policy_key == policy.key else s
        rows = pd.concat(frames).sort_values(["t_ms", "message_id"], kind="stable")
        out = []
        for t in rows["t_ms"]:
            last = max(last, int(t))
            s, exceeded, triggered, wait, debt = step(s, last, policy)
            out.append((exceeded, triggered, s.episode, wait, debt, s.expected))
        state.update((s.expected, s.episode, s.triggered_at, policy.key, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + config.STATE_IDLE_MS)
        found = pd.DataFrame(out, columns=schema.names[-6:])
        yield pd.concat([rows[schema.names[:-6]].reset_index(drop=True), found], axis=1)

    user = F.coalesce(F.when(F.col("user_id") != "", F.col("user_id")), F.lit("unknown"))
    keyed = _with_time(given.withColumn("_key", user), delay)
    return keyed.groupBy("guild_id", "_key").applyInPandasWithState(fold, schema, _FLOOD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of a key in a micro-batch; nullable integers would come as floats, so columns go as objects."""
    return pd.concat([f.astype(object) for f in frames]).sort_values(order, kind="stable", na_position="first").reset_index(drop=True)


def count(offenses: DataFrame, window_ms: int, delay: str | None = "1 minute", tell_clears: bool = False) -> DataFrame:
    """A stream of (message_id, guild_id, user_id, category, t_ms, any others) with offense_count and first_ms.

    A row with clear=true resets its key; it is dropped, or with tell_clears goes
    on with 0 and column clear, which others have false. A row with
    counts_as_offense=false passes with 0 and leaves the state as it is. delay None:
    the stream has its watermark on column _time already.
    """
    df = offenses if "clear" in offenses.columns else offenses.withColumn("clear", F.lit(False))
    df = df if "counts_as_offense" in df.columns else df.withColumn("counts_as_offense", F.lit(True))
    df = df.withColumn("message_id", F.col("message_id").cast("string"))
    names = [c for c in df.columns if c != "_time" and (tell_clears or c != "clear")]
    schema = T.StructType([*(df.schema[c] for c in names), *T.StructType.fromDDL("offense_count int, first_ms long").fields])
    ties = ["message_id", *(c for c in (ROW_KEY,) if c in names)]

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, first = state.get if state.exists else (0, 0, None)
        rows = _rows(frames, ["t_ms", "clear", *ties])
        counts, firsts, kept = [], [], []
        for i, (t, clear, counted) in enumerate(zip(rows["t_ms"], rows["clear"], rows["counts_as_offense"], strict=True)):
            now = max(last, int(t))
            if clear:
                n, first = 0, None
                if not tell_clears:
                    continue
            elif counted:
                n = n + 1 if n and now - last <= window_ms else 1
                last, first = now, int(t) if first is None else min(first, int(t))
            kept.append(i)
            counts.append(n if counted or clear else 0)
            firsts.append(first)
        state.update((n, last, first))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + window_ms + 1)
        yield rows.iloc[kept][names].assign(offense_count=counts, first_ms=firsts)

    df = _with_time(df, delay) if delay is not None else df
    return df.groupBy("guild_id", "user_id", "category").applyInPandasWithState(fold, schema, "n int, last_ms long, first_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def clear_marks(clears: DataFrame) -> DataFrame:
    """A stream of clear markers (guild_id, user_id, t_ms) as rows for ``count``: one for each category of offenses."""
    kinds = F.explode(F.array(*map(F.lit, (*schemas.CATEGORY.values(), schemas.MANUAL_CATEGORY))))
    return clears.select("guild_id", "user_id", "t_ms", kinds.alias("category"), F.lit(True).alias("clear"))


def review_keys(requests: DataFrame, window_ms: int = config.REVIEW_WINDOW_MS, delay: str = "1 minute") -> DataFrame:
    """A stream of requests (review_key, message_id, t_ms, any others) with duplicate: true within window_ms of the key's last one that was queued."""
    schema = T.StructType([*requests.schema.fields, T.StructField("duplicate", T.BooleanType())])
    names = requests.columns
    order = ["t_ms", "message_id", *(c for c in (ROW_KEY,) if c in names)]

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows, found = _rows(frames, order), []
        for t in rows["t_ms"]:
            found.append(last is not None and int(t) - last < window_ms)
            if not found[-1]:
                last = int(t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + window_ms)
        yield rows[names].assign(duplicate=found)

    return _with_time(requests, delay).groupBy("review_key").applyInPandasWithState(fold, schema, "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def answered(requests: DataFrame, answers: DataFrame, within_: str = "24 hours", delay: str = "1 minute") -> DataFrame:
    """Streams of pending requests and of answers (review_key, raw, done_ms) joined: requests with raw and done_ms.

    An answer belongs to the request of its key within whose time it comes; the
    first one of a key counts. A request that none has come to within that time is
    told with nulls, once the watermark of both streams has passed it.
    """
    left = requests.withColumn("_asked", F.timestamp_millis("t_ms")).withWatermark("_asked", delay)
    # a key is known as answered as long as its request may be
    right = answers.select(F.col("review_key").alias("_key"), "raw", "done_ms", F.timestamp_millis("done_ms").alias("_done")).withWatermark("_done", within_)
    right = right.dropDuplicatesWithinWatermark(["_key"])
    on = (F.col("review_key") == F.col("_key")) & (F.col("_done") >= F.col("_asked")) & (F.col("_done") <= F.col("_asked") + F.expr(f"interval {within_}"))
    return left.join(right, on, "left_outer").drop("_key", "_done", "_asked")


def each_batch(decide: Callable[[DataFrame], DataFrame], folder: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the batch transform's rows, in a folder of the batch's own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").format(fmt).save(f"{folder}/batch={number}")

    return write


def within(seconds: float, call: Callable, *args):
    """call(*args), or TimeoutError after so many seconds. The call goes on in a thread that ends with the worker."""
    box: list = []

    def run() -> None:
        try:
            box.append((True, call(*args)))
        except Exception as error:  # noqa: BLE001  told to the caller
            box.append((False, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError(f"no answer within {seconds} s")
    ok, value = box[0]
    if not ok:
        raise value
    return value


def review(requests: DataFrame, reviewer: Callable[[str], str], timeout_s: float = config.REVIEW_TIMEOUT_S) -> DataFrame:
    """(review_key, raw, done_ms): answers of a pluggable reviewer, three attempts each within timeout_s and with growing pauses; null raw if all fail."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, body in zip(f["review_key"], f["request"], strict=True):
                raw = None
                for attempt in range(config.REVIEW_ATTEMPTS):
                    try:
                        raw = within(timeout_s, reviewer, body)
                        break
                    except Exception:  # noqa: BLE001  a reviewer may fail in any way; the attempt counts
                        if attempt + 1 < config.REVIEW_ATTEMPTS:
                            time.sleep(config.REVIEW_BACKOFF_MS * (attempt + 1) / 1000)
                rows.append((key, raw, int(time.time() * 1000)))
            yield pd.DataFrame(rows, columns=["review_key", "raw", "done_ms"])

    return requests.where("status = 'pending'").mapInPandas(run, "review_key string, raw string, done_ms long")
