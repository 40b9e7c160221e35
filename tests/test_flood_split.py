import random
from bisect import bisect_left

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guildward.config import Policy
from guildward.operators import flood, flood_split

POLICIES = [Policy(15, 8, 60_000), Policy(60, 1, 10_000), Policy(12, 4, 0), Policy(600, 2, 1000), Policy(1, 12, 10_000)]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(POLICIES), st.lists(st.integers(0, 3000), min_size=1, max_size=80), st.randoms(use_true_random=False))
def test_maps_equal_steps(policy, gaps, rnd):
    times, t = [], 100_000
    for gap in gaps:
        t += gap
        times.append(t)
    span = policy.tolerance_ms + policy.interval_ms
    pieces = flood_split.composed(times, policy.interval_ms, policy.tolerance_ms)
    for before in (0.0, 99_999.0, 100_000.0, 100_000 + policy.tolerance_ms, 100_000 + span, *(100_000 + rnd.randrange(int(span * 4096)) / 4096 for _ in range(6))):
        last = rnd.choice([None, 100_000 - rnd.randrange(policy.cooldown_ms + 2)])
        state, over = flood.State(before, False, last), []
        for t in times:
            state, exceeded, *_ = flood.step(state, t, policy)
            over += [t] if exceeded else []
        assert flood_split.applied(pieces, before) == state.expected
        until, after = flood_split.triggers(over, times[0], policy.cooldown_ms)
        at = 0 if last is None else bisect_left(until, last + policy.cooldown_ms)
        assert (after[at] if at < len(after) else last) == state.triggered_at


def test_maps_stay_small():
    rnd = random.Random(3)
    for policy in POLICIES:
        most = []
        for n in (2000, 8000):
            times = sorted(1000 + rnd.randrange(n * 100) for _ in range(n))
            most.append(len(flood_split.composed(times, policy.interval_ms, policy.tolerance_ms)))
        assert max(most) <= 2 * (policy.burst + 1) * (policy.interval_ms / 10 + 2) and most[1] <= 2 * most[0] + 8


def brute(rows, policy):
    states, out = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        states[key], *rest = flood.step(states.get(key, flood.State()), t, policy)
        out[i] = (rest[0], rest[1], states[key].episode, rest[2], rest[3], states[key].expected)
    return out


def test_split_keys(spark):
    """A key with most rows, one with some, a null one and small ones; ties in time; columns that are called like inner ones stay."""
    rnd = random.Random(7)
    for policy in POLICIES[:3]:
        keys = [rnd.choice(["hot"] * 12 + ["warm"] * 4 + [None] * 2 + ["a", "b"]) for _ in range(1500)]
        rows = [(k, 10_000 + rnd.randrange(300_000) // 50 * 50, i) for i, k in enumerate(keys)]
        df = spark.createDataFrame([(k, t, i, "x") for k, t, i in rows], "user_id string, t_ms long, message_id long, first string")
        got = flood_split.limit(df, policy, ["user_id"], ["t_ms", "message_id"], hot_rows=120, chunk_rows=150)
        assert got.columns[:4] == df.columns
        found = {r.message_id: (r.exceeded, r.triggered, r.episode, r.retry_after_ms, r.debt_ms, r.expected_ms) for r in got.collect()}
        assert len(found) == 1500 and found == brute(rows, policy)


def test_nothing_to_split(spark):
    df = spark.createDataFrame([("u", 5, 1)], "user_id string, t_ms long, message_id long")
    for policy in (POLICIES[0], Policy(7, 2, 30_000)):
        assert flood_split.limit(df, policy, ["user_id"], ["t_ms", "message_id"]).count() == 1
        assert flood_split.limit(df.where(F.lit(False)), policy, ["user_id"], ["t_ms", "message_id"], hot_rows=1).count() == 0
