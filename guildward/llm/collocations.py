"""Phrase collocations by contiguous pattern growth, as PrefixSpan grows sequences.

An occurrence pointer of a word is what follows the word within its piece, up to
the longest phrase. Tasks that read texts gather pointers by word, equal ones as
one with a count, so a frequent word's pointers are few. The pointers of a prefix
then meet in one task, which extends the prefix to the right, depth first: the
pointers of a longer phrase are those of the shorter one that go on with its last
word, and a phrase below the least count is not extended. A prefix with more
pointers than a task should hold (TASK_POINTERS) is counted, and its pointers are
dealt to parts by a hash of the next word, each grown by itself; a part that is too
large still, as one next word is frequent, is extended by one word where its
pointers lie, and each extension is dealt as a prefix of its own. So on, until none
is too large.

Texts are lower-cased in A-Z, split at ``.,;:!?`` and line ends into pieces, and
these at spaces and tabs into words. A null or empty text has no words; a null
language counts as ``und``. Texts are read in parts of PART_BYTES, so a long one
needs no more memory; a repeated row counts again; an empty table gives no rows;
other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guildward.llm import arrow
from guildward.llm.common import light, texts
from guildward.tables import Work

LEAST_COUNT, LONGEST, INSIDE_PERCENT, FIRST = 10, 3, 50, 2000
SCALE = 1_000_000
#: Words that a task holds before it hands on what it has gathered.
TASK_WORDS = 4_000_000
#: Distinct pointers from which a prefix is divided before it is dealt.
TASK_POINTERS = 200_000
#: Pointers of one row, and bytes of a text that are split at a time.
ROW_POINTERS, PART_BYTES = 50_000, 1 << 20

_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\x0b\x0c\r\t", string.ascii_lowercase.encode() + b"\n" * 9 + b" ")
_PROJECTED = "lang string, prefix string, part int, words int, n long, pointers int, suffixes binary, counts binary"

_KEY = ["lang", "prefix", "part"]


class _Ids(dict):
    """Numbers of words in the order of their coming; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _parts(text: bytes):
    """text, cut at spaces or line ends after PART_BYTES."""
    at = 0
    while at < len(text):
        end = at + PART_BYTES
        if end < len(text):
            stops = [x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0]
            end = min(stops, default=len(text))
        yield text[at:end]
        at = end


class _Gathered:
    """Words that a task has read, and the rows of _PROJECTED that they make."""

    def __init__(self, longest: int):
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.ids, self.held, self.size = _Ids(), {}, 0

    def words(self, lang: str, part: bytes) -> None:
        found = list(filter(None, part.replace(b"\n", b" \n ").split(b" ")))
        self.held.setdefault(lang, []).append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def rows(self, lang: str, left: int = 0):
        """Rows of a language; the last ``left`` words are followed by others still, and give none."""
        t = np.concatenate([*self.held[lang], np.zeros(self.longest, np.int32)])
        n = len(t) - self.longest - left
        columns = [t[:n]]
        for k in range(1, self.longest):
            columns.append(np.where(columns[-1] == 0, 0, t[k : n + k]))
        columns = [c[columns[0] != 0] for c in columns]
        if not len(columns[0]):
            return
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(order))).astype("<i4")
        columns, names = [c[at] for c in columns], list(self.ids)
        names[0] = b""
        starts = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            for a in range(lo, hi, ROW_POINTERS):
                b = min(hi, a + ROW_POINTERS)
                suffixes = [names[x] for x in columns[1][a:b].tolist()] if self.longest > 1 else [b""] * (b - a)
                for c in columns[2:]:
                    suffixes = [s + b" " + names[x] if x else s for s, x in zip(suffixes, c[a:b].tolist(), strict=True)]
                yield lang, names[columns[0][lo]], -1, 1, int(counts[a:b].sum()), b - a, b"\n".join(suffixes), counts[a:b].tobytes()


def _sent(rows):
    """Rows of _PROJECTED as record batches of bounded size."""
    held, size = [], 0

    def batch():
        lang, prefix, part, words, n, pointers, suffixes, counts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(lang, pa.string()), pa.array(prefix, pa.binary()).cast(pa.string()), pa.array(part, pa.int32()), pa.array(words, pa.int32()),
                pa.array(n, pa.int64()), pa.array(pointers, pa.int32()), pa.array(suffixes, pa.binary()), pa.array(counts, pa.binary()),
            ],
            names=[c.split()[0] for c in _PROJECTED.split(", ")],
        )

    for row in rows:
        held.append(row)
        size += len(row[6]) + len(row[7]) + 64
        if size > arrow.BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def project(docs: DataFrame, longest: int = LONGEST, text: str = "text", lang: str = "lang", held: int = TASK_WORDS) -> DataFrame:
    """_PROJECTED: the pointers of all words, by language and word, as the reading tasks have gathered them."""
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))

    def gathered(batches):
        own = _Gathered(longest)
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                for part in _parts((value or b"").translate(_FOLD)):
                    own.words(name, part)
                    if own.size >= held:  # in the middle of a text: its last words are kept for what follows them
                        names, last = list(own.ids), np.concatenate(own.held[name])[1 - longest :] if longest > 1 else []
                        for each in own.held:
                            yield from own.rows(each, len(last) if each == name else 0)
                        own.clear()
                        own.words(name, b" ".join([names[i] for i in last]))
                if value:
                    own.words(name, b"\n")
        for each in own.held:
            yield from own.rows(each)

    return arrow.bounded(given).mapInArrow(lambda batches: _sent(gathered(batches)), _PROJECTED)


def _divided(rows: DataFrame) -> DataFrame:
    """The pointers of too large prefixes (_PROJECTED and parts): in parts by the next word, or of a part, as those of its extensions by one word."""

    def run(batches):
        def divided():
            for b in batches:
                for lang, prefix, part, words, _, _, suffixes, counts, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own: dict = {}
                    for s, k in zip(suffixes.split(b"\n"), np.frombuffer(counts, "<i4").tolist(), strict=True):
                        head, _, tail = s.partition(b" ")
                        if head:
                            to, rest = (zlib.crc32(head) % parts, s) if part < 0 else (head, tail)
                            if to in own:
                                own[to].append((rest, k))
                            else:
                                own[to] = [(rest, k)]
                    for to, some in own.items():
                        n = np.array([k for _, k in some], "<i4")
                        place = (prefix.encode(), to, words) if part < 0 else (prefix.encode() + b" " + to, -1, words + 1)
                        yield lang, *place, int(n.sum(dtype=np.int64)), len(some), b"\n".join([s for s, _ in some]), n.tobytes()

        yield from _sent(divided())

    return arrow.bounded(rows).mapInArrow(run, _PROJECTED)


def _grown(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, words, f): the frequent phrases that begin with the prefixes of rows, each grown in one task; of a part, those longer than the prefix."""

    def grow(phrase: bytes, words: int, pointers: list, n: int, found: list, part: int = -1) -> None:
        if part < 0:
            found.append((phrase, words, n))
        if words == longest:
            return
        further: dict[bytes, list] = {}
        for rest, k in pointers:
            if rest:
                head, _, tail = rest.partition(b" ")
                if head in further:
                    further[head].append((tail, k))
                else:
                    further[head] = [(tail, k)]
        for head, own in further.items():
            total = sum([k for _, k in own])
            if total >= least:
                grow(phrase + b" " + head, words + 1, own, total, found)

    def phrases(prefix: str, part: int, words: int, n: int, parts: list) -> list:
        found: list = []
        if n >= least:
            merged: dict[bytes, int] = {}
            for suffixes, counts in parts:
                for s, k in zip(suffixes.split(b"\n"), np.frombuffer(counts, "<i4").tolist(), strict=True):
                    merged[s] = merged.get(s, 0) + k
            grow(prefix.encode(), words, list(merged.items()), n, found, part)
        return found

    def batch(held: list):
        lang, phrase, words, f = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(words, pa.int32()), pa.array(f, pa.int64())],
            names=["lang", "phrase", "words", "f"],
        )

    def run(batches):
        of, words, n, parts, held = None, 0, 0, [], []
        for b in batches:
            for lang, prefix, part, w, k, _, suffixes, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, prefix, part) != of:
                    if of:
                        held += [(of[0], *x) for x in phrases(*of[1:], words, n, parts)]
                    of, words, n, parts = (lang, prefix, part), w, 0, []
                n += k
                parts.append((suffixes, counts))
                if len(held) >= 10_000:
                    yield batch(held)
                    held = []
        if of:
            held += [(of[0], *x) for x in phrases(*of[1:], words, n, parts)]
        if held:
            yield batch(held)

    dealt = rows.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return arrow.bounded(dealt).mapInArrow(run, "lang string, phrase string, words int, f long")


def frequent(
    docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, text: str = "text", lang: str = "lang", most: int = TASK_POINTERS, held: int = TASK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f), the phrases of up to ``longest`` words found ``least`` times or more, and (lang, n), all words.

    Phrases are space-joined. Both are written tables.
    """
    work = Work(docs.sparkSession)
    rows = work.table(project(docs, longest, text, lang, held), "projected")
    totals = work.table(rows.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    parts = []
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.max("words").alias("words"), F.sum("n").alias("f"), F.sum("pointers").alias("pointers"))
        large = work.table(sizes.where(F.col("pointers") > most).withColumn("parts", F.ceil(2 * F.col("pointers") / most).cast("int")), "large")
        hint = light(large.select(*_KEY, "parts"))
        parts.append(work.table(_grown(rows.join(hint, _KEY, "left_anti").select(*rows.columns), least, longest), "phrases"))
        parts.append(large.where(f"part < 0 and f >= {least}").select("lang", F.col("prefix").alias("phrase"), "words", "f"))
        if not large.limit(1).count():
            break
        rows = work.table(_divided(rows.where(F.col("words") < longest).join(hint, _KEY).select(*rows.columns, "parts")), "projected")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, totals


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, text: str = "text", lang: str = "lang", **more
) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, cut): phrases of two words or more, without those that a longer one explains.

    a is the phrase's count; of its cuts in two the one of the least score
    floor(SCALE * a * a / (l * r)) counts, of equal ones the first, l and r being
    the counts of its parts. A phrase goes if a longer frequent one around it has
    inside_percent of its count or more. Arithmetic is decimal and exact for
    counts below 10^14.
    """
    every, totals = frequent(docs, least, longest, text, lang, **more)
    split = F.split("phrase", " ", -1)
    long = every.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), split.alias("w"))
    cuts = long.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cuts.select("lang", "phrase", "words", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    of = lambda part, name: every.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    d = lambda c: F.col(c).cast("decimal(14,0)")
    cuts = cuts.withColumns({"up": d("a") * d("a") * F.lit(SCALE).cast("decimal(7,0)"), "down": d("l") * d("r")})
    cuts = cuts.withColumn("score", F.expr("up div down").cast("long"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    around = every.where("words > 2").select("lang", "words", "f", split.alias("w")).select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    around = around.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("at"))
    around = around.groupBy("lang", joined(F.col("at"), F.col("k")).alias("phrase")).agg(F.max("f").alias("longer"))
    best = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    out = best.select("lang", "phrase", "words", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score"), F.col("s.cut").alias("cut"))
    return out.join(totals, "lang").select("lang", "phrase", "words", "a", "l", "r", "n", "score", "cut")


def top(found: DataFrame, first: int = FIRST) -> DataFrame:
    """The first phrases of each language by score, count, then phrase, with rank; limited before the shuffle."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    return top(found).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
occurrences AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS t(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM occurrences GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, t.cut,
    array_to_string(string_split(c.phrase, ' ')[1:t.cut], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[t.cut + 1:], ' ') AS tail
  FROM f AS c, (VALUES (1), (2)) AS t(cut) WHERE t.cut < c.k),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = c.head JOIN f AS y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase FROM f, (VALUES (1), (2)) AS t(i) WHERE k = 3)
  GROUP BY ALL),
left_over AS (SELECT b.* FROM best AS b LEFT JOIN longer AS g ON g.lang = b.lang AND g.phrase = b.phrase WHERE b.k = 3 OR g.f IS NULL OR 100 * g.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
