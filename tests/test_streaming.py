import random

from pyspark.sql import functions as F

from guildward import schemas
from guildward.config import Policy
from guildward.operators import flood, offenses
from guildward.streaming import stateful

POLICY = Policy(rate=30, burst=3, cooldown_ms=10_000)
SCHEMA = "message_id string, guild_id string, user_id string, t_ms long"


def rows():
    rng, out = random.Random(7), []
    t = 1
    for i in range(300):
        t += rng.choice([0, 10, 300, 900, 30_000])
        out.append((f"{i:04d}", "g", str(rng.randrange(4)), t))
    return out


def streamed(spark, tmp_path, frame, schema, transform):
    """The rows of transform over frame, fed as three files in order of time."""
    source = str(tmp_path / "in")
    parts = frame.orderBy("t_ms", "message_id").collect()
    for k in range(3):
        cut = parts[k * len(parts) // 3 : (k + 1) * len(parts) // 3]
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    sink = stateful.each_batch(lambda b: b, out)
    q = transform(stream).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(out)


def test_flood_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    batch = flood.limit(df, POLICY, ["guild_id", "user_id"], ["t_ms", "message_id"])
    got = streamed(spark, tmp_path, df, SCHEMA, lambda s: stateful.limit(s, POLICY))
    key = lambda d: {r.message_id: (r.exceeded, r.triggered, r.retry_after_ms, r.debt_ms) for r in d.collect()}
    assert key(got) == key(batch) and any(v[0] for v in key(batch).values())


def test_offense_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("category", F.lit("c"))
    batch = offenses.count(df, 20_000)
    got = streamed(spark, tmp_path, df, SCHEMA + ", category string", lambda s: stateful.count(s, 20_000))
    key = lambda d: {r.message_id: r.offense_count for r in d.collect()}
    assert key(got) == key(batch)


def test_reviewer_retries(spark):
    df = spark.createDataFrame([("k1", "ok", "pending"), ("k2", "bad", "pending"), ("k3", "ok", "skipped")], "review_key string, request string, status string")

    def reviewer(body):
        if body == "bad":
            raise RuntimeError("down")
        return "answer"

    assert {r.review_key: r.raw for r in stateful.review(df, reviewer).collect()} == {"k1": "answer", "k2": None}


def test_policy_change_resets_state(spark, tmp_path):
    def run(message_id, policy):
        spark.createDataFrame([(f"{message_id}{k}", "g", "u", 1000) for k in range(2)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.limit(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), policy)
        sink = stateful.each_batch(lambda b: b, str(tmp_path / "out"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    for name, policy in (("a", Policy(burst=2)), ("b", Policy(burst=2)), ("c", Policy(burst=3))):
        run(name, policy)
    got = {r.message_id: r.exceeded for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a0": False, "a1": False, "b0": True, "b1": True, "c0": False, "c1": False}


RULES = "id long, guild_id string, scope string, pattern string, enabled boolean"
ACCESS = "guild_id string, user_id string, list_type string"


def test_decisions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    from guildward.config import Config
    from guildward.plans import decisions
    from guildward.streaming.moderation import Moderation

    rng, messages, t = random.Random(9), [], 1
    for i in range(240):
        t += rng.choice([0, 10, 300, 900, 9_000])
        body = rng.choice(["hello there", "buy spam now", "some odd words", "", "hello"])
        messages.append((f"{i:04d}", "g", str(rng.randrange(5)), body, t))
    schema = "message_id string, guild_id string, user_id string, content string, t_ms long"
    df = spark.createDataFrame(messages, schema)
    rules = spark.createDataFrame([(1, "g", "redline", "spam", True), (2, "g", "sensitive", "odd", True)], RULES)
    access = spark.createDataFrame([("g", "3", "blacklist"), ("g", "4", "whitelist")], ACCESS)
    settings = Config(governance_preset="custom", flood_rate_per_minute=30, flood_burst_allowance=2, flood_cooldown_seconds=10, offense_window_hours=1)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(messages[k * 80 : (k + 1) * 80], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    made = Moderation(settings, lambda s: rules, lambda s: access, out)
    running = made.start(stream, str(tmp_path / "cp"), availableNow=True)
    assert not any(q.isActive or q.exception() for q in running)
    want = decisions.decide(df, rules, access, settings)
    key = ["message_id", "code", "final_action", "offense_count", "mute_minutes"]
    read = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{name}")
    got = read("decisions").select(*key).collect()
    assert sorted(got) == sorted(want.decisions.select(*key).collect()) and max(r.offense_count for r in got) > 3
    told = ["trace_id", "status", "signal_code"]
    assert sorted(made.audits(spark).select(*told).collect()) == sorted(want.audits.select(*told).collect())
    events = ["trace_id", "stage", "signal_code", "result", "evidence"]
    assert sorted(made.events(spark).select(*events).collect()) == sorted(want.events.where("trace_id <> ''").select(*events).collect())
    assert read("requests").count() == want.requests.count()
    for table in (made.audits(spark), made.events(spark)):
        assert table.select("id").distinct().count() == table.count()
    # a batch that is repeated writes nothing again
    before = sorted(map(repr, read("chosen").collect()))
    made._write(read("chosen").limit(1), "chosen", 0)
    assert before and sorted(map(repr, read("chosen").collect())) == before


def test_rules_are_read_again_after_their_time():
    from guildward.streaming.moderation import Refreshed

    now, reads = [0.0], []
    table = Refreshed(lambda spark: reads.append(spark) or len(reads), ttl_s=30, clock=lambda: now[0])
    assert [table("a"), table("a")] == [1, 1]
    now[0] = 29.9
    assert table("a") == 1
    now[0] = 30.0
    assert table("a") == 2
    table.drop()
    assert table("a") == 3


def test_a_reviewer_that_hangs_is_given_up(spark, monkeypatch):
    import time

    requests = spark.createDataFrame([("k", "body", "pending"), ("x", "body", "skipped")], "review_key string, request string, status string")

    def hangs(body):
        time.sleep(30)

    began = time.monotonic()
    got = stateful.review(requests, hangs, timeout_s=0.2).collect()
    assert [(r.review_key, r.raw) for r in got] == [("k", None)] and time.monotonic() - began < 20


def test_review_keys_of_a_stream(spark, tmp_path):
    """Keys over three micro-batches are told as duplicates as over one table."""
    from guildward.operators import audit

    rng, hour, t, rows = random.Random(4), 3_600_000, 1_704_067_200_000, []
    for i in range(120):
        t += rng.choice([0, 1, hour, 5 * hour, 24 * hour])
        rows.append((f"{i:04d}", rng.choice("abc"), t))
    df = spark.createDataFrame(rows, "message_id string, review_key string, t_ms long")
    got = streamed(spark, tmp_path, df, df.schema, stateful.review_keys)
    told = lambda d: sorted((r.message_id, r.duplicate) for r in d.collect())
    assert told(got) == told(audit.deduplicated(df)) and {d for _, d in told(got)} == {True, False}


def test_clear_markers_of_a_stream(spark, tmp_path):
    """A marker resets all categories of its user; counts over three micro-batches equal those over one table."""
    rng, t, rows, marks = random.Random(8), 1_704_067_200_000, [], []
    for i in range(200):
        t += rng.choice([0, 10, 4_000, 30_000])
        if rng.random() < 0.1:
            marks.append(("g", rng.choice("ab"), t))
        rows.append((f"{i:04d}", "g", rng.choice("ab"), rng.choice(["内容违规", "行为违规"]), t, rng.random() < 0.8))
    ddl = "message_id string, guild_id string, user_id string, category string, t_ms long, counts_as_offense boolean"
    df, clears = spark.createDataFrame(rows, ddl), spark.createDataFrame(marks, "guild_id string, user_id string, t_ms long")
    want = {r.message_id: r.offense_count for r in offenses.count(df, 20_000, clears, only="counts_as_offense").collect()}
    both = df.withColumn("clear", F.lit(False)).unionByName(stateful.clear_marks(clears), allowMissingColumns=True)
    got = streamed(spark, tmp_path, both, both.schema, lambda s: stateful.count(s, 20_000))
    assert {r.message_id: r.offense_count for r in got.collect()} == want and 0 in want.values() and max(want.values()) > 3


def test_reviews_of_a_stream(spark, tmp_path):
    """Requests and answers as streams of three files: statuses, offenses, audits and states as the batch plan has them."""
    from guildward.config import Config
    from guildward.plans import decisions
    from guildward.streaming.moderation import Moderation

    rng, t, rows, answers = random.Random(2), 1_704_067_200_000, [], []
    raws = ['{"violation": true, "category": "欺诈", "reason": "R"}', '{"violation": false, "category": "不违规", "reason": ""}', "no json", None]
    for i in range(90):
        t += rng.choice([500, 20_000, 400_000])
        message = rng.choice(["", f"{i:03d}", f"{i:03d}", f"{i:03d}"])
        rows.append((message, rng.choice("gh"), rng.choice("uvw"), f"c{i % 3}", rng.choice(["odd words", "an odd one", "spam", "fine"]), t))
        raw = rng.choice(raws)
        if raw:
            key = f"{rows[-1][1]}:{message}" if message else f"{rows[-1][1]}:{rows[-1][2]}:{t}"
            answers += [(key, raw, t + 300)] + [(key, raws[0], t + 900)] * (i % 4 == 0)
    schema = "message_id string, guild_id string, user_id string, channel_id string, content string, t_ms long"
    told = "review_key string, raw string, done_ms long"
    for k in range(3):
        part = slice(k * 30, (k + 1) * 30)
        last = rows[part][-1][-1]
        spark.createDataFrame(rows[part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        first = rows[part][0][-1]
        spark.createDataFrame([a for a in answers if first < a[2] <= last + 900], told).coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
    rules = spark.createDataFrame([(i, g, s, w, True) for i, (g, s, w) in enumerate([("g", "sensitive", "odd"), ("h", "sensitive", "odd"), ("g", "redline", "spam")])], RULES)
    access = spark.createDataFrame([], ACCESS)
    settings = Config(ai_review_enabled=True, api_key="k", behavior_detection_enabled=False)
    messages = spark.createDataFrame(rows, schema)
    want = decisions.decide(messages, rules, access, settings, answers=spark.createDataFrame(answers, told))
    read = lambda kind, path: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / path))
    made = Moderation(settings, lambda s: rules, lambda s: access, str(tmp_path / "out"), capacity=None)
    running = made.start(read(schema, "in"), str(tmp_path / "cp"), answers=read(told, "answers"), availableNow=True)
    assert not any(q.exception() for q in running)
    table = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / name))
    key = ["message_key", "status"]
    done = sorted(want.requests.select(*key).collect())
    assert len(done) > 30 and {r.status for r in done} == {"pending", "confirmed", "dismissed", "failed"}
    assert sorted(table("reviews").where("status <> 'pending'").select(*key).collect()) == [r for r in done if r.status != "pending"]
    made_of = ["message_key", "code", "final_action", "offense_count", "t_ms"]
    assert sorted(table("decisions").select(*made_of).collect()) == sorted(want.decisions.select(*made_of).collect())
    shown = ["trace_id", "channel_id", "signal_code", "status", "action", "offense_count", "evidence", "reviewed_by_ai"]
    assert sorted(made.audits(spark).select(*shown).collect()) == sorted(audit_rows(want.audits, shown))
    state = {(r.guild_id, r.user_id, r.category): (r.offense_count, r.last_signal_code) for r in made.offenses(spark).collect()}
    counted = want.decisions.where("offense_count > 0").collect()
    last = {}
    for r in sorted(counted, key=lambda r: (r.t_ms, r.message_id)):
        last[r.guild_id, r.user_id, "内容违规"] = (r.offense_count, r.code)
    assert state == last


def test_clear_markers_reach_the_decisions_of_a_stream(spark, tmp_path):
    from guildward.config import Config
    from guildward.plans import decisions
    from guildward.streaming.moderation import CLEARS, Moderation

    rng, t, rows, marks = random.Random(6), 1_704_067_200_000, [], []
    for i in range(60):
        t += rng.choice([0, 500, 30_000])
        rows.append((f"{i:03d}", "g", rng.choice("uv"), "spam" if rng.random() < 0.8 else "fine", t))
        if rng.random() < 0.15:
            marks.append(("g", rng.choice("uv"), t))
    schema = "message_id string, guild_id string, user_id string, content string, t_ms long"
    messages, clears = spark.createDataFrame(rows, schema), spark.createDataFrame(marks, CLEARS)
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    clears.coalesce(1).write.parquet(str(tmp_path / "clears"))
    rules, access = spark.createDataFrame([(1, "g", "redline", "spam", True)], RULES), spark.createDataFrame([], ACCESS)
    settings = Config(behavior_detection_enabled=False)
    made = Moderation(settings, lambda s: rules, lambda s: access, str(tmp_path / "out"))
    made.start(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), clears=spark.readStream.schema(CLEARS).parquet(str(tmp_path / "clears")), availableNow=True
    )
    want = decisions.decide(messages, rules, access, settings, clears=clears).decisions.select("message_id", "offense_count", "final_action").collect()
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / "decisions"))
    assert sorted(got.select("message_id", "offense_count", "final_action").collect()) == sorted(want)
    assert len(marks) > 4 and sum(r.offense_count == 1 for r in want) > 4  # counts began anew
    # a user whose last row is a marker has no offenses any more
    last = {}
    for r in rows:
        if r[3] == "spam":
            last[r[2]] = r[4]
    cleared = {u for _, u, at in marks if at >= last.get(u, 0)}
    assert {r.user_id for r in made.offenses(spark).collect()} == set(last) - cleared


def audit_rows(audits, shown):
    return audits.select(*shown).collect()


def test_waiting_requests_fill_the_queue_of_a_stream(spark, tmp_path):
    """The queue holds what earlier batches left in it, and answers make room."""
    from guildward.config import Config
    from guildward.streaming import moderation

    made = moderation.Moderation(Config(ai_review_enabled=True, api_key="k"), None, None, str(tmp_path), capacity=3)
    row = lambda i: (f"{i}", "g", "u", 1000 + i, f"g:{i}#1", "c", "c", "c", "", f"g:{i}", "{}")
    asked = lambda *ids: spark.createDataFrame([row(i) for i in ids], moderation.ASKED).withColumn("duplicate", F.lit(False))
    made.review(asked(1, 2), 0)
    made.review(asked(3, 4, 5), 1)
    assert made.waiting(spark) == 3
    pending = made.read(spark, "requests", moderation.REQUESTS).where("status = 'pending'")
    assert sorted(r.message_id for r in pending.collect()) == ["1", "2", "3"]
    raw = F.lit('{"violation": false, "category": "不违规", "reason": ""}')
    made.answer(pending.where("message_id <> '2'").withColumns({"raw": raw, "done_ms": F.lit(5000).cast("long")}), 0)
    made.review(asked(6, 7, 8), 2)
    assert made.waiting(spark) == 3 and made.audits(spark).groupBy("status").count().collect()
    got = {r.message_id: r.status for r in made.audits(spark).collect()}
    assert got == {"1": "dismissed", "2": "pending", "3": "dismissed", "4": "failed", "5": "failed", "6": "pending", "7": "pending", "8": "failed"}


def test_a_failing_event_sink_stops_nothing(spark, tmp_path, monkeypatch):
    from guildward.config import Config
    from guildward.operators import audit
    from guildward.streaming.moderation import CHOSEN, Moderation

    def broken(*args):
        raise RuntimeError("no sink")

    monkeypatch.setattr(audit, "stored_events", broken)
    schema = "message_id string, guild_id string, user_id string, content string, t_ms long"
    results = ", exceeded boolean, triggered boolean, episode boolean, retry_after_ms long, debt_ms long, expected_ms double"
    batch = spark.createDataFrame([("1", "g", "u", "spam", 5, False, False, False, 0, 0, 9.0)], schema + results)
    rules, access = spark.createDataFrame([(1, "g", "redline", "spam", True)], RULES), spark.createDataFrame([], ACCESS)
    made = Moderation(Config(), lambda s: rules, lambda s: access, str(tmp_path))
    for _ in range(2):  # the second time nothing is written again
        made.detect(batch, 0)
    chosen = made.read(spark, "chosen", CHOSEN)
    assert [(r.message_id, r.code, r.stored) for r in chosen.collect()] == [("1", "redline_keyword", "spam")]
    counted = chosen.withColumns({"clear": F.lit(False), "offense_count": F.lit(1), "first_ms": F.lit(5).cast("long")})
    for _ in range(2):
        made.conclude(counted, 0)
    assert spark.read.parquet(f"{tmp_path}/decisions").count() == 1 and made.audits(spark).count() == 1
    mark = counted.withColumns({"clear": F.lit(True), "offense_count": F.lit(0), "t_ms": F.lit(9).cast("long")})
    state = made.offenses(spark).first()
    assert (state.offense_count, state.created_ms, state.updated_ms) == (1, 5, 5)
    made.conclude(mark, 1)
    assert made.offenses(spark).count() == 0


def stored_tables(spark, folder, days):
    """A Moderation's audits, events, changes and offenses: a message on each of the days, a batch per two days."""
    from guildward.config import Config
    from guildward.streaming import moderation

    made = moderation.Moderation(Config(), None, None, folder)
    for number in range(0, len(days), 2):
        rows = []
        for i in range(number, min(number + 2, len(days))):
            t = days[i] * 86_400_000
            rows.append((f"{i}", "gh"[i % 2], "u", t, f"{'gh'[i % 2]}:{i}#1", 2, "redline_keyword", "content", "r", "e", "p", "delete", False, 1, True, True, None, "内容违规", "c", "c", "c", ""))
        counted = spark.createDataFrame(rows, moderation.CHOSEN).withColumns({"clear": F.lit(False), "offense_count": F.lit(1), "first_ms": F.col("t_ms")})
        made.conclude(counted, number // 2)
        reviewed = counted.withColumns({"code": F.lit("ai_review"), "message_id": F.concat(F.lit("r"), "message_id"), "message_key": F.concat(F.lit("r"), "message_key")})
        made.conclude(reviewed, 100 + number // 2)
    return made


def test_retention_of_a_running_folder(spark, tmp_path):
    """Only batches with old rows are touched; events and changes go by their audits' guild; a broken run is finished."""
    from guildward.config import Config
    from guildward.plans import retention_job

    day, now, folder = 86_400_000, 100 * 86_400_000, str(tmp_path / "t")
    made = stored_tables(spark, folder, [10, 20, 60, 80, 95, 99])
    stamp = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before, audits = stamp(), made.audits(spark).count()
    decided = lambda: sorted(r.t_ms // day for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/decisions").select("t_ms").distinct().collect())
    assert decided() == [10, 20, 60, 80, 95, 99]
    gone = retention_job.prune(spark, Config(audit_retention_days=30, offense_window_hours=24), folder, now)
    times = lambda df, c: sorted(int(r[0].timestamp() * 1000) // day for r in df.select(c).collect())
    assert audits == 6 and gone["audits"] == 3 and gone["changes"] == 3 and gone["offenses"] == 10
    assert times(made.audits(spark), "created_at") == [80, 95, 99] and set(times(made.events(spark), "created_at")) == {80, 95, 99}
    assert [r.updated_ms // day for r in made.offenses(spark).collect()] == [99]
    assert decided() == [60, 80, 95, 99]  # a batch with a row that is kept stays as it is
    after = stamp()
    young = {p for p in before if any(f"{t}/decisions/batch={n}/" in str(p) for t in ("audits", "events", "changes") for n in (2, 102))}
    assert young and all(after.get(p) == before[p] for p in young)
    assert retention_job.prune(spark, Config(audit_retention_days=30), folder, now) == dict.fromkeys(gone, 0)
    # of one guild only
    scoped = retention_job.prune(spark, Config(audit_retention_days=1, guild_ids=("g",)), folder, now)
    assert scoped["audits"] == 1 and times(made.audits(spark), "created_at") == [80, 99]
    # a run that ended between writing and moving
    kept = made.audits(spark).where("false")
    path = made.read(spark, "audits", schemas.AUDITS).select("_metadata.file_path").first()[0]
    kept.write.parquet(f"{folder}/_kept/{path[path.rindex('/audits/') + 1 :].rpartition('/')[0]}")
    retention_job.finish(spark, folder)
    assert made.audits(spark).count() < 2 and not (tmp_path / "t" / "_kept").exists()


def test_retention_copies_stored_tables(spark, tmp_path):
    import pytest
    from guildward.config import Config
    from guildward.operators import audit, offenses
    from guildward.plans import retention_job

    now = 100 * 86_400_000
    made = stored_tables(spark, str(tmp_path / "t"), [10, 99])
    source = str(tmp_path / "in")
    made.audits(spark).write.parquet(f"{source}/audits")
    made.events(spark).write.parquet(f"{source}/events")
    made.offenses(spark).write.parquet(f"{source}/offenses")
    gone = retention_job.run(spark, Config(), source, str(tmp_path / "kept"), now)
    assert gone["audits"] == 1 and gone["events"] >= 1 and gone["offenses"] >= 0
    for target in (source, f"{source}/", f"{source}/deeper", str(tmp_path)):
        with pytest.raises(ValueError):
            retention_job.run(spark, Config(), source, target, now)
    assert spark.read.parquet(f"{source}/audits").count() == 2
