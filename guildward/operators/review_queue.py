"""How full the review queue is when a request comes, and which requests it refuses.

A request waits or runs from its arrival until its answer. If none were refused,
the number in the queue would be arrivals less answers so far: a running sum, made
over spans of time first, so that no task sorts all requests. Where that number
stays below the limit it is the true one. Only busy periods in which it reaches the
limit go through a fold, as a refused request takes no place and so bears on what
comes after; the fold reads its sorted partition as a stream and holds at most
``limit`` times. A period that never empties is one task by nature.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward import config
from guildward.operators.gates import small
from guildward.operators.identity import carried

#: Span of time over which sums are made before they are added up.
SPAN_MS = 600_000


def _running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its queue up to each, made by spans."""
    df = df.withColumn("_v", value)
    spans = df.groupBy("_queue", "_span").agg(F.sum("_v").alias("_of"))
    earlier = Window.partitionBy("_queue").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select("_queue", "_span", F.coalesce(F.sum("_of").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy("_queue", "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, own).join(small(before), ["_queue", "_span"]).withColumn(name, F.col(name) + F.col("_before")).drop("_v", "_before")


def occupancy(
    requests: DataFrame, limit: int = config.REVIEW_CAPACITY, running: int = config.REVIEW_CONCURRENCY, by: list[str] | None = None, span_ms: int = SPAN_MS
) -> DataFrame:
    """requests (message_id, t_ms, done_ms) with queued (how many wait or run as one comes), running of these, and full.

    done_ms is when a request's answer came; without one it stays in the queue. An
    answer at the time of an arrival makes room for it; of requests at one time the
    smaller id comes first. by: columns of independent queues. Requests without a
    time never reach the queue: 0, 0, false.
    """
    names, tie = requests.columns, ["message_id", *carried(requests)]
    queue = F.to_json(F.struct(*by)) if by else F.lit("")
    timed = requests.where("t_ms is not null").withColumns({"_queue": queue, "_at": F.col("t_ms"), "_in": F.lit(1)})
    gone = timed.where("done_ms is not null").withColumns({"_at": F.greatest("done_ms", "t_ms"), "_in": F.lit(-1)})
    both = timed.unionByName(gone).withColumn("_span", F.floor(F.col("_at") / span_ms))
    # an answer at the time of its own request comes right after it, others come before
    late = (F.col("_in") == 1) | (F.col("_at") == F.col("t_ms"))
    order = [F.col("_at"), late.cast("int"), *map(F.col, tie), F.desc("_in")]
    summed = _running(both, order, F.col("_in"), "_n").withColumn("_n", F.col("_n") - F.col("_in"))
    # a busy period is numbered by the requests so far that found the queue empty
    summed = _running(summed, order, ((F.col("_n") == 0) & (F.col("_in") == 1)).cast("int"), "_period").where("_in = 1")
    key = ["_queue", "_period"]
    full = small(summed.groupBy(*key).agg(F.max("_n").alias("_most")).where(F.col("_most") >= limit).select(*key))
    results = [F.col("_n").cast("int").alias("queued"), F.least(F.col("_n"), F.lit(running)).cast("int").alias("running"), F.lit(False).alias("full")]
    easy = summed.join(full, key, "left_anti").select(*names, *results)
    schema = T.StructType([*requests.schema.fields, *T.StructType.fromDDL("queued int, running int, full boolean").fields])

    def fold(batches):
        of, held = None, []
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            out = []
            for period, t, done in zip(zip(*map(column, key), strict=True), column("t_ms"), column("done_ms"), strict=True):
                if period != of:
                    of, held = period, []
                while held and held[0] <= t:
                    heapq.heappop(held)
                n = len(held)
                if n < limit:
                    heapq.heappush(held, math.inf if done is None else max(done, t))
                out.append((n, min(n, running), n >= limit))
            found = zip(*out, strict=True) if out else ((), (), ())
            own = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, type=k) for v, k in zip(found, (pa.int32(), pa.int32(), pa.bool_()), strict=True))], names=schema.names)

    busy = summed.join(full, key, "left_semi").select(*names, *key)
    folded = busy.repartition(*key).sortWithinPartitions(*key, "t_ms", *tie).mapInArrow(fold, schema)
    never = requests.where("t_ms is null").select("*", F.lit(0).alias("queued"), F.lit(0).alias("running"), F.lit(False).alias("full"))
    return easy.unionByName(folded).unionByName(never)
