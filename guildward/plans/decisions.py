"""From messages to decisions: gates, views, signals, classifier and review routes, offenses, punishment, audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guildward import config
from guildward.config import Config
from guildward.functions import text
from guildward.operators import audit, flood_split, gates, identity, keywords, offenses
from guildward.operators import signals as sig
from guildward.tables import unsettled


@dataclass
class Outcome:
    """signals: all; decisions: one per message that a signal decides; audits and events: rows to append; requests: reviews to make."""

    signals: DataFrame
    decisions: DataFrame
    audits: DataFrame
    events: DataFrame
    requests: DataFrame


#: Rows and bytes of hits up to which they are sent to the messages, not these dealt out by text.
HIT_ROWS, HIT_BYTES = 250_000, 16 << 20


def keyword_hits(messages: DataFrame, rules: DataFrame, contents: DataFrame | None, settle: Callable[[DataFrame], DataFrame] = unsettled) -> DataFrame:
    """Hits of messages. With contents (content_id, content) each text is normalized and searched once, wherever it is posted."""
    if contents is None:
        return keywords.match(text.message_views(messages), rules, [*sig.KEY, *identity.carried(messages)])
    posted = messages.select("content_id", "guild_id").distinct()
    views = text.message_views(contents).select("content_id", "keyword_text")
    hits = keywords.match(posted, rules, ["content_id", "guild_id"], views)
    hits = hits if settle is unsettled else gates.small(settle(hits), HIT_ROWS, HIT_BYTES)
    return messages.select(*sig.KEY, *identity.named(messages)).join(hits, ["content_id", "guild_id"])


def told(df: DataFrame, messages: DataFrame, contents: DataFrame | None) -> DataFrame:
    """df with the texts of its messages: content, stored (as an audit keeps it), short (as a notice shows it), and channel_id if messages have one.

    With contents a row names its text by content_id up to the last join, so a
    text is dealt out once, not with every message, and messages are not dealt
    again to tell what a row already knows. The cuts are made before the join, and
    only where they are used.
    """
    key = identity.row_key(messages)
    own = [c for c in ("channel_id", "content" if contents is None else "content_id") if c in messages.columns and c not in df.columns]
    if contents is None:
        return df.join(cut(messages.select(key, *own)), key, "left")
    if own:
        df = df.join(messages.select(key, *own), key, "left")
    return df.join(cut(contents.select("content_id", "content")), "content_id", "left").drop("content_id")


def cut(texts: DataFrame) -> DataFrame:
    """texts with their cuts, stored and short."""
    content = F.coalesce("content", F.lit(""))
    return texts.withColumns({"stored": F.left(content, F.lit(config.CONTENT_LIMIT)), "short": text.shortened(content)})


def once(contents: DataFrame | None) -> DataFrame | None:
    """contents with every content_id once; of texts that share an id the greatest stays."""
    if contents is None or contents.groupBy("content_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return contents
    return contents.groupBy("content_id").agg(F.max("content").alias("content"))


def detect(
    messages: DataFrame, rules: DataFrame, access: DataFrame, settings: Config, contents: DataFrame | None = None, limited: DataFrame | None = None,
    settle: Callable[[DataFrame], DataFrame] = unsettled,
) -> DataFrame:
    """All initial signals of gated messages, which name their texts if contents do. limited: the limiter's results, where a stream has them already."""
    policy = settings.policy()
    if contents is None:
        messages = messages.drop("content_id")
    flagged = gates.flag_blacklisted(messages, access)
    out = sig.access_signals(flagged)
    if settings.behavior_detection_enabled and limited is not None:
        key = identity.row_key(limited)
        own = limited.drop("content_id").join(messages.select(key), key, "left_semi")
        if contents is not None:
            own = own.join(messages.select(key, "content_id").dropDuplicates([key]), key)
        out = out.unionByName(sig.flood_signals(own, policy))
    elif settings.behavior_detection_enabled:
        user = F.coalesce(F.when(F.col("user_id") != "", F.col("user_id")), F.lit("unknown"))
        told = identity.carried(messages)
        keyed = messages.select(*sig.KEY, *identity.named(messages)).withColumn("_user", user)
        out = out.unionByName(sig.flood_signals(flood_split.limit(keyed, policy, ["guild_id", "_user"], ["t_ms", "message_id", *told]), policy))
    if settings.content_detection_enabled:
        out = out.unionByName(sig.keyword_signals(keyword_hits(messages, rules, contents, settle)))
    return out


@dataclass
class Gathered:
    """What is known of messages before offenses are counted.

    signals: all; events: their rows to append; deterministic: signals that need no
    review; passed: the classifier's silent ones, if it was asked; asked: reviews to
    make, not yet queued or worded; messages: those that passed the gates.
    """

    signals: DataFrame
    events: DataFrame
    deterministic: DataFrame
    passed: DataFrame | None
    asked: DataFrame
    messages: DataFrame
    contents: DataFrame | None
    model: str

    def told(self, df: DataFrame) -> DataFrame:
        return told(df, self.messages, self.contents)

    def worded(self, df: DataFrame) -> DataFrame:
        """asked, or what the queue made of it, with texts and requests; a message asks once, even if its text is there twice."""
        return audit.worded(told(df, self.messages, once(self.contents)), self.model)


def reviews(settings: Config) -> bool:
    """Whether reviews are made at all."""
    return settings.ai_review_enabled and bool(settings.api_key)


def gather(
    messages: DataFrame, rules: DataFrame, access: DataFrame, settings: Config, scores: DataFrame | None = None, contents: DataFrame | None = None,
    settle: Callable[[DataFrame], DataFrame] = unsettled, limited: DataFrame | None = None,
) -> Gathered:
    """Gates, signals, the classifier's routes and the reviews to ask for."""
    gated = gates.drop_whitelisted(gates.gate(messages, settings, contents, settle), access)
    # messages with texts of their own are not written again
    messages = identity.with_key(gated).drop("content_id") if contents is None else identity.keyed(gated, settle)
    key = identity.ROW_KEY
    found = settle(detect(messages, rules, access, settings, contents, limited, settle))
    events = audit.hit_events(found)
    deterministic, candidates = found.where("not needs_ai"), found.where("needs_ai")
    passed = None
    if scores is not None:
        results = settle(sig.scored(messages.select(*sig.KEY, *identity.named(messages)), scores))
        routed = sig.routed(results, found)
        events = events.unionByName(audit.event(routed, F.lit("spam_model"), F.col("status")))
        deterministic = deterministic.unionByName(routed.where("status = 'action'").drop("status"))
        passed = routed.where("status = 'pass'").drop("status")
        asked = audit.judged(found, results)
    else:
        asked = audit.grouped(candidates.join(sig.immediate(found), key, "left_anti"))
    return Gathered(found, events, deterministic, passed, asked, messages, contents, settings.model)


def selected(signals: DataFrame) -> DataFrame:
    """The signal of each message that decides it, with its category of offense."""
    return sig.top(signals).withColumn("category", offenses.category(F.col("source")))


def decide(
    messages: DataFrame, rules: DataFrame, access: DataFrame, settings: Config, scores: DataFrame | None = None,
    answers: DataFrame | None = None, clears: DataFrame | None = None, contents: DataFrame | None = None,
    settle: Callable[[DataFrame], DataFrame] = unsettled, limited: DataFrame | None = None, carry: DataFrame | None = None,
    capacity: int | None = None,
) -> Outcome:
    """The whole pipeline. messages: (message_id, guild_id, user_id, t_ms) and content, or content_id into contents.

    Messages are told apart by ``identity.ROW_KEY``, which signals, decisions and
    requests carry: ids may repeat over guilds or be missing, and a row that comes
    twice is two messages.

    All outputs start from the signals. Where several are wanted of large input,
    give settle a function that writes a table and reads it back, so that texts
    are scanned once. limited and carry are what is known of earlier messages: the
    limiter's results for these, and the offense state before them; capacity is
    what the review queue holds: with answers a request leaves it at its answer,
    without them the first in time fill it.
    """
    policy = settings.policy()
    known = gather(messages, rules, access, settings, scores, contents, settle, limited)
    requests = audit.queued(known.asked, reviews(settings), capacity, answers, settle)
    chosen = sig.top(known.deterministic)
    if answers is not None:
        requests = requests.where("status <> 'pending'").unionByName(audit.reviewed(requests, answers), allowMissingColumns=True)
        chosen = chosen.unionByName(audit.confirmed_signals(requests))
    requests = known.worded(requests)
    chosen = chosen.withColumn("category", offenses.category(F.col("source")))
    counted = offenses.count(chosen, policy.window_ms, clears, only="counts_as_offense", carry=carry).drop("category", "first_ms")
    decisions = known.told(offenses.decide(counted, policy))
    audits = audit.audits(decisions, F.lit("confirmed"))
    if known.passed is not None:
        audits = audits.unionByName(passed_audits(known))
    audits = audits.unionByName(audit.request_audits(requests))
    events = known.events.unionByName(audit.request_events(requests)).unionByName(audit.decision_events(audits))
    return Outcome(known.signals.drop("content_id"), decisions, audits, events, requests)


def passed_audits(known: Gathered) -> DataFrame:
    """Audits of what the classifier let pass."""
    silent = known.passed.withColumn("final_action", F.lit("silent")).withColumn("offense_count", F.lit(0))
    return audit.audits(known.told(silent), F.lit("dismissed"))


def assigned(messages: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """messages with column config: the number of the first of configs that names their guild, else of the first for all guilds; others go."""
    named = {g: i for i, c in reversed(list(enumerate(configs))) for g in c.guild_ids}
    rest = next((i for i, c in enumerate(configs) if not c.guild_ids), None)
    table = messages.sparkSession.createDataFrame(list(named.items()), "guild_id string, config int")
    found = messages.join(gates.small(table), "guild_id", "left")
    return found.withColumn("config", F.coalesce("config", F.lit(rest).cast("int"))).where("config is not null")


def decide_each(messages: DataFrame, rules: DataFrame, access: DataFrame, configs: Sequence[Config], **more) -> Outcome:
    """decide with the settings of each message's guild. The plan grows with the number of settings, not with that of guilds."""
    dealt = assigned(messages, configs)
    parts = []
    for i, settings in enumerate(configs):
        own = dealt.where(F.col("config") == i).drop("config")
        parts.append(decide(own, rules, access, replace(settings, guild_ids=()), **more))
    names = [f.name for f in fields(Outcome)]
    return Outcome(*(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [getattr(p, n) for p in parts]) for n in names))
