"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees to one feature at a time, so that each
feature ends as a lookup table over its bins; then the pairs of features that
explain most of the rest get tables of their own, boosted the same way. A score
is the sigmoid of an intercept and one table entry per feature and pair.

Defined cases: a null text is an empty one and is scored like any other; with no
labelled rows every score is 0.9 (nothing speaks against a document); rows
without a doc_id are never learnt from, and rows that repeat one count once;
repeated rows give repeated rows, and equal texts equal scores; a very long text is
read whole, by counts over its bytes and words; an empty table gives no rows, and
to learn from counts as one without labels; other columns pass through ``score`` unless
they are called like its results, whose names may be chosen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.common import texts, unlike

#: Labelled rows that a model is fitted on at most: those whose doc_id hashes lowest.
SAMPLE_ROWS = 20_000
KEEP_FROM = 0.7
FEATURES = [
    "log_words", "symbols", "upper", "digits", "marks", "commas", "word_chars", "non_ascii",
    "distinct_words", "distinct_per_root", "common_words", "duplicate_lines", "words_per_line", "bars",
]
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_LETTERS = _UPPER + bytes(range(97, 123))


def features(text: bytes | None) -> list[float]:
    """FEATURES of a whole text: shares and means, from counts over its bytes and words."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    letters = arrow.count_bytes(text, _LETTERS)
    distinct = len(set(words))
    short = sum(map((3).__gt__, map(len, words)))
    lines = text.count(b"\n") + 1
    return [
        np.log1p(n),
        arrow.count_bytes(text, arrow.SYMBOLS) / size,
        arrow.count_bytes(text, _UPPER) / max(letters, 1),
        arrow.count_bytes(text, _DIGITS) / size,
        arrow.count_bytes(text, b"!?") / size,
        arrow.count_bytes(text, b".,;") / max(n, 1),
        arrow.code_points(text, arrow.SPACE) / max(n, 1),
        1 - len(text.translate(None, bytes(range(128, 256)))) / size,
        distinct / max(n, 1),
        distinct / max(n, 1) ** 0.5,
        short / max(n, 1),
        arrow.duplicate_lines(text) / lines,
        n / lines,
        text.count(b"|") / max(n, 1),
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of FEATURES."""
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def _cut(grad: np.ndarray, hess: np.ndarray, lo: int, hi: int, least: float) -> tuple[float, int]:
    """Best gain of one cut of the bins lo..hi, and where; gain 0 if none leaves enough weight on both sides."""
    g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
    left, right = h[:-1], h[-1] - h[:-1]
    ok = (left >= least) & (right >= least)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, g[:-1] ** 2 / (left + 1) + (g[-1] - g[:-1]) ** 2 / (right + 1) - g[-1] ** 2 / (h[-1] + 1), 0)
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values of the bins under a tree of so many leaves at most."""
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        gain, at, part = max((*_cut(grad, hess, lo, hi, least), (lo, hi)) for lo, hi in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = grad[lo:hi].sum() / (hess[lo:hi].sum() + 1)
    return out


def _quarters(grad: np.ndarray, hess: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Best gain, and the values, of a two-way cut of a pair's table in four."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, at = 0.0, None
    for a in range(len(grad) - 1):
        for b in range(grad.shape[1] - 1):
            gs = np.array([g[a, b], g[a, -1] - g[a, b], g[-1, b] - g[a, b], g[-1, -1] - g[a, -1] - g[-1, b] + g[a, b]])
            hs = np.array([h[a, b], h[a, -1] - h[a, b], h[-1, b] - h[a, b], h[-1, -1] - h[a, -1] - h[-1, b] + h[a, b]])
            gain = float((gs**2 / (hs + 1)).sum())
            if gain > best and (hs >= least).sum() >= 2:
                best, at = gain, (a, b, gs / (hs + 1))
    out = np.zeros(grad.shape)
    if at:
        a, b, v = at
        out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, cells: int = 6, pairs: int = 3, least: float = 2.0) -> Model:
    """Boosts round-robin over the features, then over the pairs with most left to explain. Deterministic."""
    prior = (y.sum() + 0.9) / (len(y) + 1)
    model = Model(float(np.log(prior / (1 - prior))))
    if len(y) == 0 or y.min() == y.max():
        return model
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    n = x.shape[1]
    model.edges = [quantiles(x[:, j], bins) for j in range(n)]
    model.coarse = [quantiles(x[:, j], cells) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    place = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(place[j], g, size), np.bincount(place[j], h, size), 3, least)
            model.tables[j] += step
            z += step[place[j]]
    spot = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]

    def grid(i, j):
        g, h = slopes()
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        at = spot[i] * shape[1] + spot[j]
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = sorted(((_quarters(*grid(i, j)[1:], least)[0], i, j) for i in range(n) for j in range(i + 1, n)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in gains[:pairs]]
    for _ in range(rounds // 5):
        for i, j, table in model.pairs:
            at, g, h = grid(i, j)
            step = rate * _quarters(g, h, least)[1]
            table += step
            z += step.ravel()[at]
    return model


def with_features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def make(batches):
        for b in batches:
            rows = [[float(v) for v in features(t)] for t in texts(b.column(b.schema.get_field_index(text)))]
            yield [rows]

    return arrow.append_columns(docs, [T.StructField("_features", T.ArrayType(T.DoubleType()))], make, keep)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", doc_id: str = "doc_id") -> Model:
    """A model of labels.quality from the labelled rows that are not held out, at most ``rows`` of them (lowest hashes first)."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out("doc_id"))
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    # rows that repeat an id count once, with the least of their features: a row a label, so within the bound
    once = with_features(picked, "text", ["doc_id", "_quality"]).groupBy("doc_id", "_quality").agg(F.min("_features").alias("_features"))
    got = once.toArrow().sort_by("doc_id")
    x = np.array(got.column("_features").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("_quality").to_pylist(), float))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs (or the columns of ``keep``) with score (0 to 1) and predicted (1 from KEEP_FROM on) under these names."""

    def make(batches):
        for b in batches:
            x = np.array([features(t) for t in texts(b.column(b.schema.get_field_index(text)))], float).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield [s, (s >= KEEP_FROM).astype(np.int32)]

    keep = unlike(docs.columns if keep is None else keep, names)
    return arrow.append_columns(docs, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], make, keep)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
