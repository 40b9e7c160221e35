"""Quality rules: counts and fixed limits, then a hashed n-gram log-likelihood ratio of trusted against raw text.

Words and word pairs are hashed to buckets, about as many as keep LOAD n-grams
in one, up to MOST_BUCKETS. Two multinomials over the buckets, one of the trusted
documents and one of all documents, are counted over the whole table; a
document's score is its mean log ratio per n-gram, and the verdict is
score >= threshold: no randomness, so equal texts get equal verdicts.

How far scores spread depends on the corpus and on the load, so the threshold
comes from the scores of all trusted documents, each without its own share of
the trusted counts, as an unlabelled document is scored: the LOW quantile, less
MARGIN times its distance from the median.

Defined cases: a null or empty text has no words, zero counts, score 0 and fails
the base rule; with no trusted documents all scores are 0; with none that meets
the base rules no score is too low; repeated rows give
repeated rows and count as often, and equal texts get equal results; a very long
text is read whole, as one list of words; an empty table gives no rows, and as the
text to learn from a model that rejects by the base rules only; other columns pass through ``judge`` unless
they are called like its results, whose names may be chosen.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.common import WordHash, among, texts, unlike

#: Buckets are a power of two: n-grams are counted in MOST_BUCKETS, then folded while a bucket holds LOAD or fewer and LEAST_BUCKETS are left.
LEAST_BUCKETS = 1 << 15
MOST_BUCKETS = 1 << 20
LOAD = 32
#: Pseudo-counts of a bucket in the raw text; the trusted text gets its share of them, so that what neither has seen is neutral.
SMOOTHING = 1.0
LOW = 0.01
MARGIN = 0.5
#: Scores of trusted documents are counted in steps of 1/STEPS nats per n-gram.
STEPS = 1000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]


class Model(NamedTuple):
    """Log ratio of every bucket, and the least mean log ratio (nats per n-gram) of a document that is kept."""

    ratios: np.ndarray
    threshold: float = -math.inf


def buckets_of(hashes: np.ndarray, buckets: int = MOST_BUCKETS) -> np.ndarray:
    """Bucket of every word and of every pair of neighbouring words."""
    pairs = hashes[:-1] * np.uint64(0xFF51AFD7ED558CCD) ^ (hashes[1:] >> np.uint64(7)) * np.uint64(0xC4CEB9FE1A85EC53)
    both = np.concatenate([hashes, pairs])
    return ((both ^ (both >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _hashes(table: WordHash, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def ngram_counts(docs: DataFrame, text: str) -> DataFrame:
    """(bucket, n): n-grams of all documents; counts are added up per task first."""

    def run(batches):
        table, n = WordHash(), np.zeros(MOST_BUCKETS, np.int64)
        for b in batches:
            for part in arrow.chunks(texts(b.column(0))):
                each = [buckets_of(_hashes(table, w)) for t in part if (w := arrow.words_of(t))]
                if each:
                    n += np.bincount(np.concatenate(each), minlength=MOST_BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return arrow.bounded(docs).select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def totals(all_: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(raw, trusted) counts of every bucket, folded to the table's size."""
    raw, good = np.zeros(MOST_BUCKETS), np.zeros(MOST_BUCKETS)
    for counts, into in ((all_, raw), (trusted, good)):
        got = counts.toArrow()
        into[got["bucket"].to_numpy()] = got["n"].to_numpy()
    while len(raw) > LEAST_BUCKETS and raw.sum() <= LOAD * (len(raw) // 2):
        # h % (n / 2) is h % n % (n / 2)
        raw, good = raw.reshape(2, -1).sum(0), good.reshape(2, -1).sum(0)
    return raw, good


def share(counts: np.ndarray, more: float, buckets: int, total: float) -> np.ndarray:
    """Log of the smoothed shares of buckets with these counts."""
    return np.log((counts + more) / (total + more * buckets))


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(trusted / raw) of every bucket, smoothed."""
    if not good.any():
        return np.zeros(len(raw))
    return share(good, SMOOTHING * good.sum() / raw.sum(), len(raw), good.sum()) - share(raw, SMOOTHING, len(raw), raw.sum())


def trusted_threshold(docs: DataFrame, raw: np.ndarray, good: np.ndarray, text: str) -> float:
    """The threshold that the scores of docs, the trusted documents, set; counts of steps are added up, so order doesn't matter."""
    size, total = len(raw), good.sum()
    more = SMOOTHING * total / max(1, raw.sum())
    log_raw = share(raw, SMOOTHING, size, raw.sum())

    def run(batches):
        table, steps = WordHash(), {}
        for b in batches:
            for t in texts(b.column(0)):
                h = _hashes(table, arrow.words_of(t))
                if base_failed(len(h), arrow.repeated_words(h)):
                    continue
                at, own = np.unique(buckets_of(h, size), return_counts=True)
                n = 2 * len(h) - 1
                llr = math.fsum((own * (share(good[at] - own, more, size, total - n) - log_raw[at])).tolist()) / n
                step = math.floor(llr * STEPS)
                steps[step] = steps.get(step, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(steps), pa.int64()), pa.array(list(steps.values()), pa.int64())], names=["step", "n"])

    counted = docs.select(text).mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    rows = sorted((r["step"], r["n"]) for r in counted.collect())
    if not rows:
        return -math.inf
    steps, upto = np.array([r[0] for r in rows]), np.cumsum([r[1] for r in rows])
    low, median = (steps[np.searchsorted(upto, q * upto[-1])] / STEPS for q in (LOW, 0.5))
    return float(low - MARGIN * (median - low))


def base_failed(words: int, repeated: int) -> bool:
    return words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * words


def base_counts(text: bytes | None, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0
    return (
        arrow.code_points(text, arrow.SPACE),
        arrow.count_bytes(text, arrow.SYMBOLS),
        arrow.duplicate_lines(text),
        arrow.repeated_words(hashes),
    )


def judge(
    docs: DataFrame, model: Model, text: str = "text", threshold: float | None = None, keep: list[str] | None = None, names: list[str] | None = None
) -> DataFrame:
    """docs (or the columns of ``keep``) with RESULTS, or these under the names given; threshold replaces the model's."""
    ratios, threshold = model.ratios, model.threshold if threshold is None else threshold
    names = RESULTS if names is None else names
    kinds = [T.LongType()] * 5 + [T.DoubleType(), T.BooleanType(), T.BooleanType()]
    fields = [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]

    def make(batches):
        table = WordHash()
        for b in batches:
            rows = []
            for t in texts(b.column(b.schema.get_field_index(text))):
                h = _hashes(table, arrow.words_of(t))
                n = len(h)
                counts = base_counts(t, h)
                llr = math.fsum(ratios[buckets_of(h, len(ratios))].tolist()) / (2 * n - 1) if n else 0.0
                failed = base_failed(n, counts[3])
                rows.append((n, *counts, llr, failed, not failed and llr >= threshold))
            yield list(zip(*rows, strict=True)) if rows else [[] for _ in fields]

    keep = unlike(docs.columns if keep is None else keep, names)
    return arrow.append_columns(docs, fields, make, keep)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Log ratios and threshold with the documents that labels call good (quality 1) as the trusted ones; counts all documents."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    trusted = among(docs, good)
    raw, of_trusted = totals(ngram_counts(docs, "text"), ngram_counts(trusted, "text"))
    threshold = trusted_threshold(trusted, raw, of_trusted, "text") if of_trusted.any() else -math.inf
    return Model(log_ratios(raw, of_trusted), threshold)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model, keep=["doc_id"])
