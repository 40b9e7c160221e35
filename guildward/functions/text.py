"""Text as column expressions, all of them built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guildward import config, schemas

#: White space of the message format: Unicode space separators, line ends and the byte order mark (fixed value).
SPACE = r"[\x09-\x0D\x20\xA0  -     　﻿]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
_ZERO_WIDTH, _JOINER = "​‌‍﻿", "⁠"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def nfkc(x: Column) -> Column:
    """NFKC by the Unicode library that comes with Spark; ASCII is its own normal form."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).when(x.isNotNull(), composed)


def normalize(x: Column, word_joiner: bool = True) -> Column:
    """The form in which keywords and texts are compared. Not idempotent: aliases apply before punctuation goes.

    word_joiner: also drops U+2060, as imports and messages do and the lexicon builder doesn't.
    """
    x = F.translate(nfkc(x), _ZERO_WIDTH + (_JOINER if word_joiner else ""), "")
    x = F.lower(x)
    # fixed values: the aliases of two messengers
    x = F.regexp_replace(x, rf"薇信|微{SPACE}*信|v{SPACE}*x|v{SPACE}*信", "微信")
    x = F.regexp_replace(x, "扣扣|企鹅号", "qq")
    x = F.regexp_replace(x, SPACE, "")
    x = F.regexp_replace(x, r"[\p{P}\p{S}]", "")
    return F.regexp_replace(x, r"(.)\1{2,}", "$1$1")


def plain_text(x: Column) -> Column:
    """Texts between markup tags, joined by spaces, references decoded; the original if none is left."""
    parts = F.filter(F.split(x, r"<[!/?a-zA-Z][^>]*>", -1), lambda p: p != "")
    joined = F.array_join(parts, " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        joined = F.replace(joined, F.lit(name), F.lit(char))
    return F.when(trim(joined) == "", x).otherwise(joined)


def message_views(messages, content: str = "content"):
    """messages with raw_text, plain_text and keyword_text."""
    return messages.withColumn("raw_text", F.coalesce(F.col(content), F.lit(""))).withColumn("plain_text", plain_text(F.col("raw_text"))).withColumn(
        "keyword_text", normalize(F.col("plain_text"))
    )


def shortened(x: Column) -> Column:
    """Plain text on one line, cut after 160 characters."""
    line = trim(F.regexp_replace(plain_text(x), rf"{SPACE}+", " "))
    return F.when(F.char_length(line) <= config.NOTICE_LIMIT, line).otherwise(F.concat(F.left(line, F.lit(config.NOTICE_LIMIT)), F.lit("...")))


def mapped(x: Column, names: dict, other: Column | str | int | None = None) -> Column:
    """The value of names for x, or other."""
    out = other if isinstance(other, Column) else F.lit(other)
    for key, value in names.items():
        out = F.when(x == key, F.lit(value)).otherwise(out)
    return out


def violation_type(source: Column, label: Column) -> Column:
    labelled = F.concat(F.lit("内容违规：疑似"), label, F.lit("内容"), F.when(label == "普通广告", F.lit("，请仔细甄别")).otherwise(F.lit("")))
    content = F.when(F.coalesce(label, F.lit("")) == "", F.lit("内容违规")).otherwise(labelled)
    return F.when(source == "content", content).otherwise(F.lit("行为违规"))


def scope_name(x: Column) -> Column:
    return F.when(x == "redline", F.lit(schemas.SCOPE_NAMES["redline"])).otherwise(F.lit(schemas.SCOPE_NAMES["sensitive"]))


def action_name(x: Column) -> Column:
    return mapped(x, schemas.ACTION_NAMES, schemas.OTHER_ACTION_NAME)


def at(user: Column) -> Column:
    """A mention of a user in message markup."""
    return F.concat(F.lit('<at id="'), user, F.lit('"/>'))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Replaces all {name}, name by name, so that a later name inside an earlier value is replaced too."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def replace_first(x: Column, name: str, value: Column) -> Column:
    """Replaces the first occurrence only; the value is taken as it is."""
    at_ = F.instr(x, name)
    before, after = F.substring(x, F.lit(1), at_ - 1), F.substring(x, at_ + len(name), F.char_length(x))
    return F.when(at_ > 0, F.concat(before, value, after)).otherwise(x)


def welcome(template: Column, user_id: Column, username: Column, bot_name: Column) -> Column:
    name = F.coalesce(F.when(username != "", username), user_id, F.lit(""))
    return F.concat(replace_first(replace_first(template, "{username}", name), "{botName}", bot_name), at(user_id))


def leave(template: Column, user_id: Column) -> Column:
    return replace_first(template, "{userId}", F.coalesce(user_id, F.lit("")))


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 on with one or two decimals: the nearest to its exact binary value, of two equally near the greater.

    The product with the scale is taken as a sum of two doubles without error, as
    a formatter that rounds the decimal notation differs where that ends in 5.
    """
    scale, x = 10**digits, x.cast("double")
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * float(scale)
    error = (high * float(scale) - product) + (x - high) * float(scale)
    n = F.floor(product)
    n = n + F.when((product - n - 0.5) + error >= 0, 1).otherwise(0)
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def percent(x: Column) -> Column:
    return F.concat(fixed(x * 100, 1), F.lit("%"))


def parse_scope(x: Column) -> Column:
    """A rule scope from its name or its label, else null."""
    return F.when(x.isin("redline", "红线"), F.lit("redline")).when(x.isin("sensitive", "敏感"), F.lit("sensitive"))


def parse_time(x: Column) -> Column:
    """Milliseconds of an ISO time, 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(x)), F.lit(0))


def label(x: Column, kind: str) -> Column:
    """The console's name of a signal, action, status, stage or result; of an unknown value the value itself."""
    return mapped(x, schemas.LABELS_OF[kind], x)


def normalize_action(x: Column, fallback: str) -> Column:
    return F.when(x.isin(*schemas.ACTION_RANK), x).otherwise(F.lit(fallback))


def punishment_action(x: Column) -> Column:
    """What a level of the ladder may do; anything else warns."""
    return F.when(x.isin("mute", "kick"), x).otherwise(F.lit("warn"))


def local_time(x: Column) -> Column:
    """An ISO time in the session's time zone as the console shows it; what is no time stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(x), "yyyy/M/d HH:mm:ss"), x)


def megabytes(x: Column) -> Column:
    return F.format_string("%d MB", F.floor(x / (1024 * 1024) + 0.5))


def iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def file_size(x: Column) -> Column:
    return (
        F.when(x < 1024, F.format_string("%d B", x.cast("long")))
        .when(x < 1024 * 1024, F.concat(fixed(x / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(x / (1024 * 1024), 2), F.lit(" MB")))
    )


def trace_id(*key: Column) -> Column:
    """An id that a repeated run gives to the same message again."""
    h = F.sha2(F.concat_ws("\u0001", *key), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
