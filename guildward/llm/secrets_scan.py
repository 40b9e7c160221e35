"""Secret scans: fixed patterns, and runs that a random-string Markov model explains better than an identifier model.

JVM-side only. ``split`` by a pattern yields the text between its matches, so
running lengths give every match's place in code points.

Defined cases: a null text is an empty one; an empty text has no spans; spans
are sorted by start, then kind in the order assign, access, hex, markov; a
random run that is a base match as a whole is reported once, one that only
overlaps base matches is reported beside them; equal rows give equal rows; other
columns of the input pass through ``scan`` unless they are called like its
results, and through ``redact`` whatever they are called. Time is linear in the
text, also in one long run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind, pattern, group that is measured, its least length. The last two may
#: ask for their length in the pattern: a shorter run can hold no longer one.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
]
MARKOV = "markov"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Runs that the Markov models judge: a run of the alphabet, long enough, with a letter and a digit.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Mean log-likelihood ratio per character pair from which a run counts as random.
THRESHOLD = 0.5
#: A run that is a base match as a whole, which needs no second report.
WHOLE = "^(?:[0-9a-f]+|AKIA[A-Z0-9]+|" + KINDS[0][1].replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]{12,}") + ")$"
#: Matches whose places are summed at a time.
RUN_OF = 32
RESULTS = ["n_assign", "n_access", "n_hex", "base_spans", "all_spans", "base", "spans"]
STEMS = (
    "user name page view item list data file path time date count index table query order price total group event "
    "value state cache token session client server request response message content header image video audio search "
    "result filter report account customer product service update delete create insert select build test config default "
    "local global public private static module package version release branch commit merge change review button layout"
).split()


def labelled_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(text, random 0/1): digests in three alphabets, and identifiers of words, separators and numbers."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    raw = F.unhex(digest)
    random = F.when(i % 3 == 0, F.substring(digest, 1, 40)).when(i % 3 == 1, F.base64(raw)).otherwise(F.translate(F.base64(raw), "+/=", "aZ9"))
    stems = F.array(*map(F.lit, STEMS))
    word = lambda k: F.element_at(stems, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(STEMS))) + 1).cast("int"))
    tail = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(2100)).cast("string")
    plain = (
        F.when(i % 4 == 0, F.concat_ws("_", word(1), word(2), word(3), tail))
        .when(i % 4 == 1, F.concat_ws("-", word(1), word(2), tail, word(3)))
        .when(i % 4 == 2, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), tail))
        .otherwise(F.concat_ws("/", word(1), word(2), tail))
    )
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(1).alias("random")).union(ids.select(plain, F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs of ALPHABET, row by row, from (text, random).

    Add-one smoothed transition frequencies; the counts are at most two per
    pair, so what reaches the driver is bounded. No samples give zeros.
    """
    n = len(ALPHABET)
    pairs = samples.where(F.length("text") > 1).select(
        "random", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("pair")
    )
    counts = {0: {}, 1: {}}
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] = r["count"]
    log = {}
    for kind, seen in counts.items():
        for a in ALPHABET:
            row = sum(seen.get(a + b, 0) for b in ALPHABET)
            for b in ALPHABET:
                log[kind, a, b] = math.log((seen.get(a + b, 0) + 1) / (row + n))
    return [log[1, a, b] - log[0, a, b] for a in ALPHABET for b in ALPHABET]


def _let(value: Column, body) -> Column:
    """body(value), value made once: what a lambda only refers to is made anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_runs(values: Column) -> Column:
    """An array that isn't empty, cut in arrays of RUN_OF."""
    runs = lambda of: F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / RUN_OF)), lambda k: F.slice(of, (k * RUN_OF + 1).cast("int"), RUN_OF))
    return _let(values, runs)


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """Places of the matches ``found`` of pattern, from 0, in code points.

    Running sums are taken in runs of RUN_OF matches, then over the runs, so that
    arrays that grow by an element are short.
    """
    none = F.array().cast("array<bigint>")
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    lengths = F.zip_with(gaps, found, lambda gap, hit: F.struct(gap.cast("long").alias("gap"), F.length(hit).cast("long").alias("hit")))

    def within(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["hit"]).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    def over(acc, run):
        moved = F.transform(run["starts"], lambda at: at + acc["at"])
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["runs"], F.array(moved)).alias("runs"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("starts"))
    summed = F.transform(_in_runs(lengths), lambda run: F.aggregate(run, zero, within))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("runs"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(summed, zero, over, lambda acc: acc["runs"]))).otherwise(none)


def _spans(kind: int, pattern: str, measured: str, least: int) -> Column:
    """Spans (start, kind, end, hit) of the matches in column k<kind> whose measured group is long enough."""
    found = F.col(f"hit{kind}")
    spans = F.zip_with(
        _starts(F.col("body"), pattern, found),
        found,
        lambda s, h: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(h)).alias("end"), h.alias("hit")),
    )
    if measured == f"hit{kind}":
        return F.filter(spans, lambda s: F.length(s["hit"]) >= least)
    long = F.zip_with(spans, F.col(measured), lambda s, m: F.when(F.length(m) >= least, s))
    return F.array_compact(long)


def _joined(spans: Column, names: list[str]) -> Column:
    kinds = F.array(*map(F.lit, names))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def mean_ratio(w: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the neighbouring characters of w, all of ALPHABET: each character is looked up once."""
    n, table = len(ALPHABET), F.array(*[F.lit(round(x, 4)) for x in ratios])
    places = F.transform(F.split(w, "", -1), lambda c: F.instr(F.lit(ALPHABET), c))

    def total(p):
        pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.element_at(table, ((a - 1) * n + b).cast("int")))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    return _let(F.slice(places, 1, F.length(w)), total) / (F.length(w) - 1)


def _found(docs: DataFrame, ratios: list[float], text: str, threshold: float) -> tuple[DataFrame, list[str]]:
    """docs, its columns called c0, c1 and so on, with body, s0 to s2, base_spans and all_spans; and the columns' names."""
    names = docs.columns
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])
    df = df.withColumn("body", F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")))
    cols = {f"hit{k}": F.regexp_extract_all("body", F.lit(p), F.lit(0)) for k, (_, p, _, _) in enumerate(KINDS)}
    cols["hit3"] = F.regexp_extract_all("body", F.lit(RUN), F.lit(0))
    cols["in0"] = F.regexp_extract_all("body", F.lit(KINDS[0][1]), F.lit(2))
    df = df.withColumns(cols)
    base = {f"s{k}": _spans(k, p, "in0" if k == 0 else f"hit{k}", least) for k, (_, p, _, least) in enumerate(KINDS)}
    judged = lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]") & ~w.rlike(WHOLE)
    random = F.filter(_spans(3, RUN, "hit3", 2), lambda s: judged(s["hit"]) & (mean_ratio(s["hit"], ratios) >= threshold))
    df = df.withColumns(base).withColumn("s3", F.when(F.exists("hit3", judged), random))
    df = df.withColumn("base_spans", F.array_sort(F.concat("s0", "s1", "s2")))
    more = F.when(F.col("s3").isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", "s3")))
    return df.withColumn("all_spans", more), names


def scan(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_assign, n_access, n_hex (long), base_spans and all_spans (arrays of start, kind number, end, hit), base and spans (text)."""
    df, given = _found(docs, ratios, text, threshold)
    names = [k for k, *_ in KINDS] + [MARKOV]
    counts = [F.size(f"s{k}").cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(given) if c.lower() not in RESULTS]
    return df.select(*own, *counts, "base_spans", "all_spans", _joined(F.col("base_spans"), names).alias("base"), _joined(F.col("all_spans"), names).alias("spans"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: numbers of base findings, SHA-256 of the base spans, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(spark)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """docs with every span's text replaced by ``[secret]`` (overlapping or touching spans by one); other columns and rows stay.

    A text is split once, at its spans' ends: array slices, not substrings, so the
    time is linear in text and spans.
    """
    df, names = _found(docs, ratios, text, THRESHOLD)
    # spans come by start; one that begins beyond the greatest end before it opens a cut
    edges = F.flatten(F.transform("all_spans", lambda s: F.array(F.struct(s["start"].alias("at"), F.lit(0).alias("close")), F.struct(s["end"].alias("at"), F.lit(1).alias("close")))))
    zero = F.struct(F.lit(0).cast("long").alias("open"), F.array().cast("array<array<struct<at:bigint,cut:boolean>>>").alias("runs"))
    inner = F.struct(F.lit(0).cast("long").alias("open"), F.array().cast("array<struct<at:bigint,cut:boolean>>").alias("marks"))

    def mark(acc, e):
        now = acc["open"] + F.when(e["close"] == 1, -1).otherwise(1)
        point = F.array(F.struct(e["at"].alias("at"), (now > 0).alias("cut")))
        changes = (now > 0) != (acc["open"] > 0)
        return F.struct(now.cast("long").alias("open"), F.when(changes, F.concat(acc["marks"], point)).otherwise(acc["marks"]).alias("marks"))

    def run(acc, part):
        got = F.aggregate(part, F.struct(acc["open"].alias("open"), inner["marks"].alias("marks")), mark)
        return F.struct(got["open"].alias("open"), F.concat(acc["runs"], F.array(got["marks"])).alias("runs"))

    parts = _in_runs(F.array_sort(edges))
    df = df.withColumn("marks", F.when(F.size("all_spans") > 0, F.flatten(F.aggregate(parts, zero, run, lambda acc: acc["runs"]))))
    letters = F.split("body", "", -1)
    # between neighbouring marks lies a cut or a kept piece; before the first and after the last, kept ones
    bounds = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("cut"))), F.col("marks"))
    ends = F.concat(F.transform("marks", lambda m: m["at"]), F.array(F.length("body").cast("long")))

    def pieces(all_):
        kept = lambda b, e: F.array_join(F.slice(all_, (b["at"] + 1).cast("int"), (e - b["at"]).cast("int")), "")
        return F.array_join(F.zip_with(bounds, ends, lambda b, e: F.when(b["cut"], F.lit("[secret]")).otherwise(kept(b, e))), "")

    masked = F.when(F.size("all_spans") > 0, _let(letters, pieces)).otherwise(F.col(f"c{names.index(text)}"))
    return df.select(*[(masked if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
