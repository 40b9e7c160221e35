"""Keyword rules against message texts: each text is searched once for the distinct patterns of all guilds, then rules join the hits.

Few patterns are searched for one by one, more by an automaton that each task
builds. Beyond what an automaton should hold, patterns stay where they are: each is
filed under the one of its grams (three characters, or all of a shorter pattern)
that the fewest patterns have, an equi-join with the grams of the texts finds
candidates, and the text is searched for these alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward import config, schemas
from guildward.functions import text
from guildward.operators.gates import small

#: Distinct patterns up to which each is searched for by itself; beyond it, automata do.
FEW_PATTERNS = 64
#: Patterns that an automaton holds; more are found by their grams.
AUTOMATON_PATTERNS = 200_000
GRAM = 3


def compiled(rules: DataFrame) -> DataFrame:
    """Enabled valid rules with npat, the pattern as it is compared."""
    live = rules.where(F.col("enabled") & (F.coalesce("guild_id", F.lit("")) != "") & F.col("scope").isin(*schemas.SCOPES))
    return live.withColumn("npat", text.normalize(F.col("pattern"))).where("npat <> ''").select("id", "guild_id", "scope", "pattern", "npat")


def ranked(hits: DataFrame, key: list[str]) -> DataFrame:
    """The first MAX_SIGNALS rules of a message: by the end of their first occurrence, the longer pattern, the older rule."""
    w = Window.partitionBy(*key).orderBy("end_pos", F.desc(F.char_length("npat")), "id")
    return hits.withColumn("match_seq", F.row_number().over(w)).where(F.col("match_seq") <= config.MAX_SIGNALS)


def found(texts: DataFrame, patterns: DataFrame, keep: list[str], keyword_text: str = "keyword_text", method: str = "auto") -> DataFrame:
    """(keep, npat, end_pos): the first occurrence of every pattern (distinct, column npat) in every text.

    method: one, automaton or grams; auto tells by the number of patterns.
    """
    if method == "auto":
        n = patterns.limit(AUTOMATON_PATTERNS + 1).count()
        method = "one" if n <= FEW_PATTERNS else "automaton" if n <= AUTOMATON_PATTERNS else "grams"
    if method == "automaton":
        return _scanned(texts, patterns, keep, keyword_text)
    if method == "grams":
        return _by_grams(texts, patterns, keep, keyword_text)
    few = [r["npat"] for r in patterns.collect()]
    body = F.col(keyword_text)
    hits = F.filter(F.array(*map(F.lit, few)).cast("array<string>"), lambda p: F.contains(body, p))
    out = texts.select(*keep, keyword_text, F.explode(hits).alias("npat"))
    return out.select(*keep, "npat", (F.instr(body, F.col("npat")) + F.char_length("npat") - 1).cast("long").alias("end_pos"))


def _grams(of: str, size: int) -> Column:
    """The different runs of ``size`` characters of a text; none of a shorter one."""
    letters = F.regexp_extract_all(F.col(of), F.lit("(?s)."), F.lit(0))
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - size + 1), lambda i: F.concat(*[F.element_at(c, i + k) for k in range(size)]))
    # the letters are a variable of a function, so that they are made once and not for every run
    made = F.element_at(F.transform(F.array(letters), runs), 1)
    return F.when(F.char_length(of) >= size, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def filed(patterns: DataFrame) -> DataFrame:
    """(gram, npat): each pattern under the one of its grams that the fewest patterns have."""
    own = F.when(F.char_length("npat") < GRAM, F.array("npat")).otherwise(_grams("npat", GRAM))
    each = patterns.select("npat", F.explode(own).alias("gram"))
    times = each.groupBy("gram").agg(F.count("*").alias("n"))
    return each.join(times, "gram").groupBy("npat").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")).select("gram", "npat")


def _by_grams(texts: DataFrame, patterns: DataFrame, keep: list[str], keyword_text: str) -> DataFrame:
    """found by an equi-join of grams. Equal texts are looked for once; texts are told by a hash, as the search itself decides."""
    body = F.col(keyword_text)
    hashed = texts.where(body.isNotNull()).withColumn("_h", F.xxhash64(keyword_text))
    grams = F.array_distinct(F.concat(*[_grams(keyword_text, k) for k in range(1, GRAM + 1)]))
    asked = hashed.select("_h", F.explode(grams).alias("gram"))
    candidates = asked.join(filed(patterns), "gram").select("_h", "npat").distinct()
    out = hashed.select(*keep, keyword_text, "_h").join(candidates, "_h").where(F.contains(body, F.col("npat")))
    return out.select(*keep, "npat", (F.instr(body, F.col("npat")) + F.char_length("npat") - 1).cast("long").alias("end_pos"))


def _scanned(texts: DataFrame, patterns: DataFrame, keep: list[str], keyword_text: str) -> DataFrame:
    """found by one scan of each text over an automaton of the patterns, which are within AUTOMATON_PATTERNS, about."""
    shared = texts.sparkSession.sparkContext.broadcast([r["npat"] for r in patterns.collect()])
    schema = T.StructType([*(texts.schema[c] for c in keep), T.StructField("npat", T.StringType()), T.StructField("end_pos", T.LongType())])

    def scan(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in shared.value:
            machine.add_word(p, p)
        machine.make_automaton()
        for b in batches:
            take, names, ends = [], [], []
            for i, value in enumerate(b.column(b.schema.get_field_index(keyword_text)).to_pylist()):
                if not value or not shared.value:
                    continue
                seen = set()
                for end, p in machine.iter(value):
                    if p not in seen:
                        seen.add(p)
                        take.append(i)
                        names.append(p)
                        ends.append(end + 1)
            if take:
                at = pa.array(take, pa.int64())
                own = [b.column(b.schema.get_field_index(c)).take(at) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names), pa.array(ends, pa.int64())], names=schema.names)

    return texts.select(*keep, keyword_text).mapInArrow(scan, schema)


def match(
    messages: DataFrame, rules: DataFrame, key: list[str], contents: DataFrame | None = None, keyword_text: str = "keyword_text", method: str = "auto"
) -> DataFrame:
    """(key, guild_id, id, scope, pattern, npat, end_pos, match_seq), a row for each rule that a message of its guild contains.

    With contents (content_id, keyword_text) messages name theirs by content_id,
    and a text is searched once, wherever it is posted.
    """
    rules = compiled(rules)
    patterns = rules.select("npat").distinct()
    keys = [*dict.fromkeys([*key, "guild_id"])]
    if contents is None:
        hits = found(messages, patterns, keys, keyword_text, method)
    else:
        hits = messages.select(*keys, "content_id").join(found(contents, patterns, ["content_id"], keyword_text, method), "content_id")
    hits = hits.join(small(rules), ["guild_id", "npat"])
    return ranked(hits.select(*keys, "id", "scope", "pattern", "npat", "end_pos"), key)
