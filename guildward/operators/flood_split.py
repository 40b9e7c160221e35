"""The flood limiter on keys with very many messages: a key's history is cut into chunks that different tasks go through.

A chunk maps the time that the limiter expects before it to the one after it.
A message at t takes e to max(t, e) + I where e <= t + tolerance and leaves it
otherwise, so a composed map consists of pieces that are constant or e plus a
multiple of I. Their number does not grow with the chunk: two times less than I
apart stay less than I apart (or meet), as the one that is ahead is refused
first. So the images of an interval of length I fill no more than such an
interval, whose constants are whole milliseconds apart, and what may be expected
before a chunk lies within tolerance + I of its first message: at most some 2 I
pieces (I in ms) for each of burst + 1 intervals, in floods a few for each.

Three passes over the rows and two over the chunks: maps of the chunks; the time
expected before each; with it, who exceeds, and how each chunk moves the last
trigger (pieces again, as many as the cooldown has milliseconds at most) and the
episode; what is remembered before each chunk; the rows' results by ``flood.step``.

Defined cases: null keys are a key; rows that are equal in keys and order stay in
one chunk; an empty table gives no rows; rates whose sums of doubles round
(``flood.limit``) can't be composed exactly and go through its fold.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guildward.config import Policy
from guildward.operators import flood
from guildward.tables import Work

#: Messages from which on a key is split, and messages of a chunk, about.
HOT_ROWS = 4_000_000
CHUNK_ROWS = 1_000_000
_MAP = "_part int, _first long, _ends array<double>, _moves array<boolean>, _by array<double>"
_EXPECTED = "_part int, _expected double"
_MARKS = "_part int, _expected double, _until array<long>, _last array<long>, _calm boolean, _stirred boolean"
_BEFORE = "_part int, _expected double, _triggered long, _episode boolean"


def composed(times: Iterable[int], interval: float, tolerance: float) -> list[tuple[float, bool, float]]:
    """Pieces (end, moves, by) of the map of these messages: up to end, and above the piece before, e becomes e + by if it moves, else by."""
    pieces, shift, low, high = [], 0.0, 0.0, 0.0
    for t in times:
        limit = t + tolerance
        if not pieces:  # what is expected at or before the first message is as the message itself
            pieces = [(float(t), False, float(t)), (limit + interval, True, 0.0)]
            low, high = float(t), limit + interval
        if low > limit:
            continue
        if low >= t and high <= limit:
            shift, low, high = shift + interval, low + interval, high + interval
            continue
        after: list[tuple[float, bool, float]] = []

        def add(end: float, moves: bool, by: float) -> None:
            if after and after[-1][1:] == (moves, by):  # noqa: B023
                after.pop()  # noqa: B023
            after.append((end, moves, by))  # noqa: B023

        start = -math.inf
        for end, moves, by in pieces:
            by += shift
            if not moves:
                add(end, False, max(t, by) + interval if by <= limit else by)
            else:
                idle, due = t - by, limit - by
                if start < idle:
                    add(min(end, idle), False, t + interval)
                if max(start, idle) < min(end, due):
                    add(min(end, due), True, by + interval)
                if end > due:
                    add(end, True, by)
            start = end
        pieces, shift = after, 0.0
        starts = [-math.inf, *(p[0] for p in pieces)]
        low = min(s + by if moves else by for s, (_, moves, by) in zip(starts, pieces, strict=False))
        high = max(end + by if moves else by for end, moves, by in pieces)
    return [(end, moves, by + shift) for end, moves, by in pieces]


def applied(pieces: list[tuple[float, bool, float]], expected: float) -> float:
    end, moves, by = pieces[bisect_left(pieces, expected, key=lambda p: p[0])]
    return expected + by if moves else by


def triggers(exceeded: list[int], first: int, cooldown: int) -> tuple[list[int], list[int]]:
    """(until, last): where the last trigger before plus the cooldown is at most until, the last trigger after is last; beyond, it stays."""
    last = list(exceeded)
    k = len(exceeded)
    for j in range(len(exceeded) - 1, -1, -1):
        while k > j + 1 and exceeded[k - 1] - exceeded[j] >= cooldown:
            k -= 1
        if k < len(exceeded) and exceeded[k] - exceeded[j] >= cooldown:
            last[j] = last[k]
    until, out = [], []
    for j, x in enumerate(exceeded):
        if j and exceeded[j - 1] >= first + cooldown:
            break
        if out and out[-1] == last[j]:
            until[-1] = x
        else:
            until.append(x)
            out.append(last[j])
    return until, out


def _runs(batches, by: list[str], names: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """(values of by, columns of names) of each run of rows that are equal in by; a run is a chunk, so of bounded size."""
    key, held = None, [[] for _ in names]
    for b in batches:
        column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
        ids, values, at = list(zip(*map(column, by), strict=True)), [column(c) for c in names], 0
        while at < len(ids):
            if ids[at] != key:
                if key is not None:
                    yield key, held
                key, held = ids[at], [[] for _ in names]
            end = at
            while end < len(ids) and ids[end] == key:
                end += 1
            for into, v in zip(held, values, strict=True):
                into += v[at:end]
            at = end
    if key is not None:
        yield key, held


def _emit(rows: Iterable[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    kinds = to_arrow_schema(schema)
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds, strict=True)], schema=kinds)


def _split(rows: DataFrame, policy: Policy, keys: list[str], order: list[str], t_ms: str, work: Work, parts: int) -> DataFrame:
    """limit for rows of hot keys."""
    interval, tolerance, cooldown = policy.interval_ms, policy.tolerance_ms, policy.cooldown_ms
    chunk, names = [*keys, "_part"], rows.columns
    key_fields = [rows.schema[k] for k in keys]
    # written once, so that all passes see the same chunks
    ranged = rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    rows = work.table(ranged, "flood-chunks")

    def typed(ddl: str) -> T.StructType:
        return T.StructType([*key_fields, *T.StructType.fromDDL(ddl).fields])

    def over_rows(df: DataFrame, run, schema: T.StructType) -> DataFrame:
        return df.repartition(*chunk).sortWithinPartitions(*chunk, *order).mapInArrow(run, schema)

    def over_chunks(df: DataFrame, run, schema: T.StructType) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*chunk).mapInArrow(run, schema)

    def known(df: DataFrame, of_chunks: DataFrame) -> DataFrame:
        other = of_chunks.toDF(*(f"_k{i}" if i < len(chunk) else c for i, c in enumerate(of_chunks.columns)))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(chunk)))
        return df.join(other, same).drop(*(f"_k{i}" for i in range(len(chunk))))

    maps, expected, marks, before = map(typed, (_MAP, _EXPECTED, _MARKS, _BEFORE))

    def compose(batches):
        found = ((key, times[0], composed(times, interval, tolerance)) for key, (times,) in _runs(batches, chunk, [t_ms]))
        yield from _emit(((*key, first, *map(list, zip(*pieces, strict=True))) for key, first, pieces in found), maps)

    def expect(batches):
        def rows_():
            key, due = None, 0.0
            for b in batches:
                for r in b.to_pylist():
                    if (k := [r[c] for c in keys]) != key:
                        key, due = k, 0.0
                    yield *k, r["_part"], due
                    due = applied(list(zip(r["_ends"], r["_moves"], r["_by"], strict=True)), due)

        yield from _emit(rows_(), expected)

    def mark(batches):
        def rows_():
            for key, (times, due) in _runs(batches, chunk, [t_ms, "_expected"]):
                calm, stirred, over = flood.State(due[0]), flood.State(due[0], True), []
                for t in times:
                    calm, exceeded, *_ = flood.step(calm, t, policy)
                    stirred, *_ = flood.step(stirred, t, policy)
                    if exceeded:
                        over.append(t)
                yield *key, due[0], *triggers(over, times[0], cooldown), calm.episode, stirred.episode

        yield from _emit(rows_(), marks)

    def remember(batches):
        def rows_():
            key, last, episode = None, None, False
            for b in batches:
                for r in b.to_pylist():
                    if (k := [r[c] for c in keys]) != key:
                        key, last, episode = k, None, False
                    yield *k, r["_part"], r["_expected"], last, episode
                    at = 0 if last is None else bisect_left(r["_until"], last + cooldown)
                    last = r["_last"][at] if at < len(r["_last"]) else last
                    episode = r["_stirred"] if episode else r["_calm"]

        yield from _emit(rows_(), before)

    schema = T.StructType([*rows.schema.fields[: len(names)], *flood.RESULTS])

    def finish(batches):
        key, state = None, flood.State()
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            out = []
            for *k, due, episode, last, now in zip(*map(column, [*chunk, "_expected", "_episode", "_triggered", t_ms]), strict=True):
                if k != key:
                    key, state = k, flood.State(due, episode, last)
                state, exceeded, triggered, wait, debt = flood.step(state, now, policy)
                out.append((exceeded, triggered, state.episode, wait, debt, state.expected))
            if out:
                given = [b.column(b.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(given + [pa.array(v, to) for v, to in zip(zip(*out, strict=True), flood.KINDS, strict=True)], names=schema.names)

    slim = rows.select(*dict.fromkeys([*chunk, *order, t_ms]))
    mapped = work.table(over_rows(slim, compose, maps), "flood-maps")
    due = over_chunks(mapped, expect, expected)
    marked = work.table(over_rows(known(slim, due), mark, marks), "flood-marks")
    return over_rows(known(rows, over_chunks(marked, remember, before)), finish, schema)


def limit(
    messages: DataFrame, policy: Policy, keys: list[str], order: list[str], t_ms: str = "t_ms", work: Work | None = None, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``flood.limit``, with keys of hot_rows messages or more split into chunks of about chunk_rows.

    Keys are counted first. There are at most rows / hot_rows hot ones, so their table is small.
    """
    if not (policy.interval_ms * flood.EXACT_STEPS).is_integer():
        return flood.limit(messages, policy, keys, order, t_ms)
    work = work or Work(messages.sparkSession)
    counted = messages.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= hot_rows)
    hot = work.table(counted.toDF(*(f"_h{i}" for i in range(len(keys))), "_rows"), "flood-keys")
    n = hot.agg(F.sum("_rows")).first()[0]
    if not n:
        return flood.limit(messages, policy, keys, order, t_ms)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(keys)))
    cold = flood.limit(messages.join(F.broadcast(hot), same, "left_anti"), policy, keys, order, t_ms)
    split = _split(messages.join(F.broadcast(hot), same, "left_semi"), policy, keys, order, t_ms, work, max(2, -(-n // chunk_rows)))
    return cold.unionByName(split)
