import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guildward.config import Config, Policy
from guildward.operators import flood, signals

POLICY = Policy(rate=12, burst=4, cooldown_ms=60_000)


def folded(times, policy=POLICY):
    state, out = flood.State(), []
    for t in times:
        state, *rest = flood.step(state, t, policy)
        out.append((*rest, state.expected))
    return out


def limited(spark, rows, policy):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "message_id long, guild_id string, user_id string, t_ms long")
    return flood.limit(df, policy, ["guild_id", "user_id"], ["t_ms", "message_id"])


def test_burst():
    got = folded([0, 0, 0, 0, 0, 1000])
    assert [g[0] for g in got] == [False] * 4 + [True, True]
    assert got[4][1] and got[4][2] == 5000 and not got[5][1] and got[5][4] == got[4][4]


def test_slow_flood():
    times = list(range(0, 80_001, 4000))
    assert next(t for t, g in zip(times, folded(times)) if g[0]) == 64_000


def test_steady_and_recovery_and_cooldown():
    assert not any(g[0] for g in folded([i * 5000 for i in range(100)]))
    got = folded([0] * 5 + [60_000] * 5)
    assert [g[0] for g in got] == [False] * 4 + [True] + [False] * 4 + [True] and got[9][1]
    assert sum(g[1] for g in folded(range(0, 130_001, 1000))) == 3


def test_keys_and_evidence(spark):
    policy = Config().policy()
    rows = [("g1", "u1", 0)] * 10 + [("g1", "u2", 0), ("g2", "u1", 0)]
    got = limited(spark, rows, policy).where("exceeded").orderBy("message_id")
    assert [(r.user_id, r.guild_id, r.message_id, r.debt_ms, r.retry_after_ms) for r in got.collect()][0] == ("u1", "g1", 8, 32000, 4000)
    evidence = signals.flood_signals(got, policy).orderBy("message_id").first()["evidence"]
    assert "32.0 秒" in evidence and "4.0 秒" in evidence and evidence.endswith("是")


def test_retrigger_after_cooldown(spark):
    policy = Policy(rate=60, burst=1, cooldown_ms=10_000)
    got = limited(spark, [("g", "u", t) for t in (0, 0, 0, 10_000, 10_000)], policy).orderBy("message_id").collect()
    assert [r.triggered for r in got] == [False, True, False, False, True]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=60), st.integers(1, 60), st.integers(1, 6))
def test_islands_bound_the_fold(gaps, rate, burst):
    """A row that comes no earlier than the all-accepted time finds the limiter recovered."""
    policy, t, times = Policy(rate=rate, burst=burst), 0, []
    for g in gaps:
        t += g
        times.append(t)
    run = None
    state = flood.State()
    for n, t in enumerate(times):
        due = n * policy.interval_ms + run if run is not None else t
        if t >= due:
            assert (state.expected or t) <= t + 1e-6
        state = flood.step(state, t, policy)[0]
        run = t - n * policy.interval_ms if run is None else max(run, t - n * policy.interval_ms)


def test_islands_equal_fold(spark):
    rng = random.Random(3)
    rows, policy = [], Policy(rate=30, burst=3, cooldown_ms=10_000)
    for u in range(60):
        t = 0
        for _ in range(rng.randrange(1, 50)):
            t += rng.choice([0, 1, 500, 2000, 2500, 20_000])
            rows.append(("g", str(u), t))
    got = {r.message_id: r for r in limited(spark, rows, policy).collect()}
    assert len(got) == len(rows)
    for u in range(60):
        ids = [i for i, r in enumerate(rows) if r[1] == str(u)]
        for i, want in zip(ids, folded([rows[i][2] for i in ids], policy)):
            r = got[i]
            assert (r.exceeded, r.triggered, r.retry_after_ms, r.debt_ms) == want[:4]
            assert abs(r.expected_ms - want[4]) < 1e-6


def test_any_rate_equals_fold(spark):
    """Bit by bit, whatever the rate: the limiter adds intervals that are no whole number of milliseconds."""
    rng = random.Random(17)
    for rate, burst, base in [(52, 3, 2966), (7, 2, 0), (13, 1, 1_704_067_200_123), (240, 5, 0), *((rng.randrange(1, 241), rng.randrange(1, 6), rng.choice([0, 1_704_067_200_000])) for _ in range(8))]:
        policy, rows = Policy(rate=rate, burst=burst, cooldown_ms=10_000), []
        for u in range(25):
            t = base
            for _ in range(rng.randrange(1, 60)):
                rows.append(("g", str(u), t))
                t += rng.choice([0, 0, 1, 7, int(policy.interval_ms), int(policy.interval_ms) + 1, rng.randrange(4 * int(policy.interval_ms) + 2)])
        got = {r.message_id: r for r in limited(spark, rows, policy).collect()}
        assert len(got) == len(rows)
        for u in range(25):
            ids = [i for i, r in enumerate(rows) if r[1] == str(u)]
            for i, want in zip(ids, folded([rows[i][2] for i in ids], policy)):
                r = got[i]
                assert (r.exceeded, r.triggered, r.retry_after_ms, r.debt_ms, r.expected_ms) == want, (rate, burst, i)
    policy = Policy(rate=52, burst=3)
    assert [r.exceeded for r in limited(spark, [("g", "u", 2966)] * 3, policy).orderBy("message_id").collect()] == [w[0] for w in folded([2966] * 3, policy)]


def test_empty(spark):
    assert limited(spark, [("g", "u", 1)], POLICY).where(F.lit(False)).count() == 0
