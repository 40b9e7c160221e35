"""Flood detection: a GCRA limiter per key over ordered messages.

If all messages were accepted, the arrival time that the limiter expects before
message n would be (n-1)*I + max over k<n of (t_k - (k-1)*I), a running maximum.
The true time is never later, so where a message comes at or after it the limiter
has recovered: an island begins. Islands in which no message comes too early need
no fold at all; the others go through one that reads its sorted partition as a
stream and keeps a few numbers per key, however long a key's history is.

The limiter adds I message by message in doubles. Where I is a multiple of 1/4096
ms all sums are exact and the window has the same values. Where it isn't, an
island must begin later than any rounding could reach, and all islands of more
than one message go through the fold, so that results equal ``step`` bit by bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward.config import Policy


#: Intervals that are multiples of 1/EXACT_STEPS ms add up without rounding for times of this age and the next.
EXACT_STEPS = 4096


@dataclass
class State:
    """What the limiter remembers of a key."""

    expected: float = 0.0
    episode: bool = False
    triggered_at: int | None = None


def step(state: State, now: int, policy: Policy) -> tuple[State, bool, bool, int, int]:
    """(state after, exceeded, triggered, wait ms, debt ms) for a message at now."""
    due = state.expected or now
    over = due - policy.tolerance_ms - now
    if over > 0:
        triggered = state.triggered_at is None or now - state.triggered_at >= policy.cooldown_ms
        after = State(state.expected, True, now if triggered else state.triggered_at)
        return after, True, triggered, math.ceil(over), math.ceil(due - now)
    after = State(max(now, due) + policy.interval_ms, state.episode and now < due, state.triggered_at)
    return after, False, False, 0, max(0, math.ceil(due - now))


RESULTS = [
    T.StructField("exceeded", T.BooleanType()),
    T.StructField("triggered", T.BooleanType()),
    T.StructField("episode", T.BooleanType()),
    T.StructField("retry_after_ms", T.LongType()),
    T.StructField("debt_ms", T.LongType()),
    T.StructField("expected_ms", T.DoubleType()),
]


def limit(messages: DataFrame, policy: Policy, keys: list[str], order: list[str], t_ms: str = "t_ms") -> DataFrame:
    """messages with RESULTS, keys' histories in the order of ``order`` (whose first column is the time)."""
    interval, tolerance = policy.interval_ms, policy.tolerance_ms
    by_key = Window.partitionBy(*keys).orderBy(*order)
    df = messages.withColumn("_n", F.row_number().over(by_key))
    lead = F.col(t_ms) - (F.col("_n") - 1) * F.lit(interval)
    earlier = F.max(lead).over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_due", (F.col("_n") - 1) * F.lit(interval) + earlier)
    exact = (interval * EXACT_STEPS).is_integer()
    rounding = F.lit(0.0) if exact else F.lit(1.0) + F.col("_n") * F.lit(1 / 2048)
    df = df.withColumn("_begins", F.coalesce(F.col(t_ms) >= F.col("_due") + rounding, F.lit(True)))
    df = df.withColumn("_early", F.coalesce(F.col(t_ms) < F.col("_due") - tolerance, F.lit(False)))
    df = df.withColumn("_island", F.sum(F.col("_begins").cast("long")).over(by_key))
    island = Window.partitionBy(*keys, "_island")
    df = df.withColumn("_dirty", F.max("_early").over(island) if exact else F.count("*").over(island) > 1)
    due = F.when(F.col("_begins"), F.col(t_ms)).otherwise(F.col("_due"))
    clean = df.where("not _dirty").select(
        *messages.columns,
        F.lit(False).alias("exceeded"),
        F.lit(False).alias("triggered"),
        F.lit(False).alias("episode"),
        F.lit(0).cast("long").alias("retry_after_ms"),
        F.greatest(F.lit(0), F.ceil(due - F.col(t_ms))).cast("long").alias("debt_ms"),
        (F.greatest(F.col(t_ms), due) + interval).cast("double").alias("expected_ms"),
    )
    names = messages.columns
    schema = T.StructType([*messages.schema.fields, *RESULTS])

    def fold(batches):
        key, island, state = None, None, State()
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            rows = []
            for *k, i, now in zip(*(column(c) for c in keys), column("_island"), column(t_ms), strict=True):
                if k != key:
                    key, island, state = k, i, State()
                elif i != island:
                    island, state = i, State(0.0, False, state.triggered_at)
                state, exceeded, triggered, wait, debt = step(state, now, policy)
                rows.append((exceeded, triggered, state.episode, wait, debt, state.expected))
            out = [b.column(b.schema.get_field_index(c)) for c in names]
            if rows:
                out += [pa.array(v, to) for v, to in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    dirty = df.where("_dirty").select(*names, "_island")
    dirty = dirty.repartition(*keys).sortWithinPartitions(*keys, *order)
    return clean.unionByName(dirty.mapInArrow(fold, schema))


KINDS = [pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
