"""Messages that nothing tells apart, stored tables and their edits, deep pages, the review queue, very many rules."""

import random
from datetime import datetime, timezone

import pytest
from guildward import schemas
from guildward.config import Config
from guildward.operators import audit, identity, keywords, review_queue
from guildward.operators import signals as sig
from guildward.plans import console, decisions
from guildward.sources import stored
from guildward.streaming.moderation import Refreshed
from pyspark.sql import functions as F

MESSAGES = "message_id string, guild_id string, user_id string, content string, t_ms long"
RULES = "id long, guild_id string, scope string, pattern string, enabled boolean"
ACCESS = "guild_id string, user_id string, list_type string"


def decided(spark, rows, settings=None, **more):
    rules = spark.createDataFrame([(1, "g", "redline", "spam", True), (2, "h", "redline", "spam", True), (3, "g", "sensitive", "odd", True)], RULES)
    return decisions.decide(spark.createDataFrame(rows, MESSAGES), rules, spark.createDataFrame([], ACCESS), settings or Config(), **more)


@pytest.mark.parametrize("message_id", ["1", "", None])
def test_messages_of_one_id_are_decided_one_by_one(spark, message_id):
    rows = [(message_id, "g", "u", "spam", 1), (message_id, "h", "v", "spam", 2), (message_id, "g", "w", "spam", 3), (message_id, "g", "x", "fine", 4)]
    got = decided(spark, rows)
    assert sorted((r.guild_id, r.user_id, r.offense_count, r.content) for r in got.decisions.collect()) == [("g", "u", 1, "spam"), ("g", "w", 1, "spam"), ("h", "v", 1, "spam")]
    traces = [r.trace_id for r in got.audits.collect()]
    assert len(set(traces)) == len(traces) == 3 and {r.trace_id for r in got.events.collect()} == set(traces)


def test_a_row_that_comes_twice_is_two_messages(spark):
    rows = [("1", "g", "u", "spam", 5)] * 3 + [(None, "g", "v", "spam", 5)] * 2
    got = decided(spark, rows).decisions.collect()
    assert sorted((r.user_id, r.offense_count) for r in got) == [("u", 1), ("u", 2), ("u", 3), ("v", 1), ("v", 2)]
    asked = decided(spark, [("1", "g", "u", "odd", 5)] * 2, Config(ai_review_enabled=True, api_key="k")).requests
    assert sorted((r.review_key, r.status) for r in asked.collect()) == [("g:1", "duplicate"), ("g:1", "pending")]


def test_floods_of_messages_without_ids(spark):
    settings = Config(governance_preset="custom", flood_rate_per_minute=1, flood_burst_allowance=1)
    for message_id in ("", None):
        found = decided(spark, [(message_id, "g", "u", "hi", 1000 + i) for i in range(4)], settings).signals
        assert sorted(r.t_ms for r in found.where("code = 'spam_flood'").collect()) == [1001, 1002, 1003]


def test_keys_and_traces(spark):
    df = spark.createDataFrame([("b:c", "a", "u", "x", 1), ("c", "a:b", "u", "x", 1), ("7", "g", "u", "x", 1), ("7", "g", "u", "x", 1)], MESSAGES)
    keyed = identity.with_key(df)
    assert identity.with_key(keyed) is keyed and keyed.select(identity.ROW_KEY).distinct().count() == 4
    traces = audit.trace(keyed).collect()
    assert len({r.trace_id for r in traces}) == 4
    plain = {r.trace_id for r in audit.trace(df).collect()}
    assert {r.trace_id for r in traces if r.message_key == "g:7#1"} <= plain


@pytest.mark.parametrize("columns", [["message_id"], ["guild_id", "message_id"], ["message_key"]])
def test_scores_name_messages(spark, columns):
    """Scores of a guild's message don't reach the other guild's, where they say whose they are."""
    rows = [("1", "g", "u", "odd", 1), ("1", "h", "v", "fine", 2)]
    given = {"message_id": "1", "guild_id": "g", "message_key": "g:1#1"}
    scores = spark.createDataFrame([(*[given[c] for c in columns], "action", "欺诈", 0.9, 0.9)], ", ".join(f"{c} string" for c in columns) + ", status string, label string, confidence double, violation_probability double")
    got = decided(spark, rows, scores=scores).decisions.select("guild_id", "code").collect()
    want = [("g", "spam_model")] + [("h", "spam_model")] * (columns == ["message_id"])
    assert sorted(map(tuple, got)) == want


def brute_queue(rows, limit):
    """rows: (id, queue, t, done) in order."""
    held, out = {}, {}
    for i, q, t, done in sorted(rows, key=lambda r: (r[2], r[0])):
        now = [d for d in held.get(q, []) if d is None or d > t]
        out[i] = (len(now), min(2, len(now)), len(now) >= limit)
        held[q] = now + [done] if len(now) < limit else now
    return out


@pytest.mark.parametrize("limit,by", [(4, ["q"]), (7, None)])
def test_review_queue(spark, limit, by):
    rng = random.Random(limit)
    t, rows = 0, []
    for i in range(400):
        t += rng.choice([0, 0, 1, 5, 40, 400])
        rows.append((i, rng.choice(["a", "b", None]), t, rng.choice([t, t + 3, t + 50, t + 90, t + 90, t - 5] + [None] * (i % 50 == 0))))
    df = spark.createDataFrame([*rows, (9999, "a", None, 5)], "message_id long, q string, t_ms long, done_ms long").repartition(3)
    got = {r.message_id: (r.queued, r.running, r.full) for r in review_queue.occupancy(df, limit, by=by, span_ms=50).collect()}
    assert got.pop(9999) == (0, 0, False)
    assert got == brute_queue([(i, q if by else "", t, done) for i, q, t, done in rows], limit)


def test_audits_after_their_reviews(spark):
    """The console shows a review's last state; other audits of the trace stay."""
    rows = [("1", "g", "u", "odd", 1), ("2", "g", "u", "odd", 2), ("3", "g", "u", "spam", 3)]
    settings = Config(ai_review_enabled=True, api_key="k")
    answers = spark.createDataFrame([("g:1", '{"violation": true, "category": "欺诈", "reason": "R"}', 9)], "review_key string, raw string, done_ms long")
    done = decided(spark, rows, settings, answers=answers)
    log, _ = audit.review_updates(done.requests, done.decisions)
    table = audit.stored(decided(spark, rows, settings).audits)
    listed = console.Console(settings).audits(table, "g", changes=log)
    assert {(r.message_id, r.status, r.action, r.offense_count) for r in listed.rows.collect()} == {
        ("1", "confirmed", "delete", 2), ("2", "pending", "silent", 0), ("3", "confirmed", "delete", 1),
    }
    assert listed.rows.columns == table.columns and console.Console(settings).audits(table, "g", status="confirmed", changes=log).total == 2


NOW = None  # set by the fixture: a column needs a session


@pytest.fixture(autouse=True)
def now(spark):
    global NOW
    NOW = F.timestamp_millis(F.lit(0))


def test_edits_of_a_stored_table(spark, tmp_path):
    dropped = []
    store = stored.rule_table(spark, str(tmp_path / "rules"), lambda: dropped.append(1))
    edits = console.Console(Config())
    assert store.read().count() == 0 and store.versions() == []
    assert store.edit(lambda t: edits.create_rule(t, "g", "redline", "one", "me", NOW)) == 1
    # two edits of one version: the first is committed, the other is told so, and made anew finds the first
    version, before = 1, store.read()
    assert store.commit(edits.create_rule(before, "g", "redline", "two", "me", NOW), version) == 2
    with pytest.raises(stored.Conflict):
        store.commit(edits.create_rule(before, "g", "redline", "three", "me", NOW), version)
    assert sorted(r.pattern for r in store.read().collect()) == ["one", "two"] and store.read(1).count() == 1
    tries = []

    def racing(table):
        tries.append(table.count())
        if len(tries) == 1:  # another process is faster
            store.commit(edits.create_rule(table, "g", "sensitive", "four", "them", NOW), 2)
        return edits.create_rule(table, "g", "redline", "three", "me", NOW)

    assert store.edit(racing) == 4 and tries == [2, 3] and len(dropped) == 4
    assert sorted((r.id, r.pattern) for r in store.read().collect()) == [(1, "one"), (2, "two"), (3, "four"), (4, "three")]
    store.KEPT = 2
    store.edit(lambda t: edits.delete_rule(t, "g", 1))
    assert store.versions() == [4, 5] and not list((tmp_path / "rules" / "_staged").iterdir())


def test_an_edit_is_seen_at_once(spark, tmp_path):
    store = stored.rule_table(spark, str(tmp_path / "rules"))
    cached = Refreshed(lambda s: store.read(), ttl_s=1000)
    store.listeners = (cached.drop,)
    assert cached(spark).count() == 0
    store.edit(lambda t: console.Console(Config()).create_rule(t, "g", "redline", "one", "me", NOW))
    assert cached(spark).count() == 1


def test_import_into_a_stored_table(spark, tmp_path):
    store = stored.rule_table(spark, str(tmp_path / "rules"))
    got = stored.import_wordlist(store, "g", "redline", "a\nb\nA!\n", "me", NOW).first()
    assert (got.created_count, got.known_count, got.failed_count) == (2, 0, 0) and store.read().count() == 2

    class Busy(stored.Stored):
        def commit(self, table, based_on):
            raise stored.Conflict("another's")

    busy = Busy(spark, str(tmp_path / "rules"), schemas.RULES)
    got = stored.import_wordlist(busy, "g", "redline", "a\nc\nd\n", "me", NOW, attempts=2).first()
    assert (got.created_count, got.known_count, got.failed_count) == (0, 1, 2) and store.read().count() == 2


def test_deep_pages(spark, monkeypatch):
    """Pages found by counts hold what sorting all gives, ties, rows without a time and pages at the edges of spans included."""
    monkeypatch.setattr(console, "SHALLOW_ROWS", 30)
    rng = random.Random(1)
    times = [datetime.fromtimestamp(86_400 * rng.randrange(3) + rng.choice([0, 1, 5, 4000]), timezone.utc) for _ in range(400)] + [None] * 15
    df = spark.createDataFrame([(i, "g", t, "p") for i, t in enumerate(times)], "id long, guild_id string, created_at timestamp, pattern string")
    want = [r.id for r in df.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    shown = console.Console(Config())
    for page in (1, 2, 5, 9, 17, 20, 21, 22, 30):
        rows, total = shown.audits(df, "g", page=page, size=20).fetch()
        assert [r.id for r in rows] == want[(page - 1) * 20 : page * 20] and total == 415, page
    rules = spark.range(0, 90_000, 3).selectExpr("id", "'g' guild_id", "'redline' scope", "cast(id as string) pattern", "true enabled")
    listed = shown.rules(rules, "g", page=280, size=100)
    assert [r.id for r in listed.rows.collect()] == list(range(27_900 * 3, 28_000 * 3, 3)) and listed.total == 30_000


def test_many_rules_by_grams(spark):
    rng = random.Random(3)
    letters = "abcde微信🙂"
    patterns = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "a" * 5000), (503, "a" * 5000)]
    t = spark.createDataFrame(texts, "content_id long, keyword_text string")
    p = spark.createDataFrame([(x,) for x in patterns], "npat string")
    got = [keywords.found(t, p, ["content_id"], method=m).collect() for m in ("grams", "automaton", "one")]
    assert set(got[0]) == set(got[1]) == set(got[2]) and len(got[0]) == len(set(got[0])) > 500


def test_a_million_rules_are_not_gathered(spark, monkeypatch):
    """Patterns beyond an automaton's are found without a collect of any."""
    from pyspark.sql.classic.dataframe import DataFrame

    n = 1_000_000
    p = spark.range(n).select(F.concat(F.lit("w"), F.conv((F.col("id") * 7919 + 46_656).cast("string"), 10, 36)).alias("npat"))
    word = lambda i: "W" + "".join(reversed([*_digits(i * 7919 + 46_656)]))
    texts = [(0, f"xx{word(5).replace('W', 'w', 1)}yy"), (1, "nothing here"), (2, word(999_999).replace("W", "w", 1))]
    t = spark.createDataFrame(texts, "content_id long, keyword_text string")
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    found = keywords.found(t, p, ["content_id"])
    monkeypatch.undo()
    got = {(r.content_id, r.npat) for r in found.collect()}
    assert {(0, word(5).replace("W", "w", 1)), (2, word(999_999).replace("W", "w", 1))} <= got and all(b in dict(texts)[a] for a, b in got)


def _digits(n):
    while n:
        n, r = divmod(n, 36)
        yield "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[r]


def test_signals_without_keys_still_work(spark):
    """Tables made without the key column are told apart by their ids."""
    rows = [(1, "g", "u", 1, 0, "a", "x", "r", "e", "p", "delete", False, 0, True, True, None), (2, "g", "u", 1, 0, "a", "x", "r", "e", "p", "delete", False, 0, True, True, None)]
    kinds = "message_id long, guild_id string, user_id string, t_ms long, seq int, code string, source string, public_reason string, evidence string, pattern string, action string, needs_ai boolean, rule_id long, counts_as_offense boolean, write_audit boolean, content_label string"
    assert sig.top(spark.createDataFrame(rows, kinds)).count() == 2


def test_a_lexicon_is_written_with_its_counters(spark, tmp_path):
    import json

    from guildward.sources import wordlists

    files = spark.createDataFrame([("a.txt", "one two\n# note\nthree\nThree.\nx"), ("b.txt", "four")], "file string, text string")
    wordlists.write_lexicon(files, str(tmp_path / "words"), str(tmp_path / "stats"))
    (told,) = [json.loads(p.read_text()) for p in (tmp_path / "stats").glob("part-*.json")]
    words = "".join(p.read_text() for p in (tmp_path / "words").glob("part-*.txt")).split("\n")[:-1]
    assert told == wordlists.lexicon_stats(files).first().asDict() and told["output_words"] == len(words) == 3
    assert told["output_bytes"] == sum(len(w.encode()) + 1 for w in words)
