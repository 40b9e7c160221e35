"""Exact top-k search by integer inner products, with buckets of vectors of like length.

Vectors are sorted by length, the longest first, and cut into buckets. A block of
queries meets a stripe of buckets in one task, in order of length, and keeps the k
best of each query. What a query must reach (its k-th best so far) over its own and
a bucket's greatest length is the cosine that a vector of the bucket needs. If that
is above one the bucket is left out, and all shorter ones. From COORDINATE_FROM on,
only vectors are looked at whose components lie where such a cosine lets them, for
the query's largest components; below it, those that are long enough. Products of
what is left are computed and compared, so results are exact. The longest bucket is
seen by every stripe first, which gives a bound to begin with.

Components are floor(256 x). A vector that is null, holds a null or non-finite
component (also after scaling) or has no id takes no part; an empty one does, among
vectors of dimension 0, as only vectors of one dimension meet. A row that repeats
is a candidate again, but a query once; rows with the query's id are its own. Ties
go to the smaller id. Products beyond the range of long count as its ends. An empty
table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guildward.llm import arrow
from guildward.tables import Work

K, SCALE, EVERY = 5, 256.0, 50
#: Bytes of a bucket's and of a query block's vectors, and the buckets of a stripe.
BUCKET_BYTES, BLOCK_BYTES, STRIPE_BUCKETS = 256 << 10, 1 << 20, 16
#: Cosine that a bucket must ask for to be pruned by coordinates, and how many of a query's coordinates are used.
COORDINATE_FROM, FOCUS = 0.8, 3
#: Relative slack of bounds, far above rounding; products of lengths from which sums may leave the exact range of doubles.
SLACK, EXACT = 1e-9, 2.0**52
_LEAST, _MOST = -(2**63), 2**63 - 1
_GROUP = "dim int, last long, longest double, ids binary, vecs binary"


def scaled(values: list | None) -> np.ndarray | None:
    """floor(256 x) of the components, or None if a vector takes no part."""
    if values is None or None in values:
        return None
    with np.errstate(over="ignore"):
        v = np.floor(SCALE * np.asarray(values, np.float64))
    return v if np.isfinite(v).all() else None


def _length(v: np.ndarray) -> float:
    """The Euclidean length, infinite only if it is beyond the doubles."""
    top = float(np.abs(v).max(initial=0.0))
    return top * math.sqrt(float(((v / top) ** 2).sum())) if top else 0.0


def prepare(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, length, vec) of the vectors that take part."""
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where("vec_id is not null and v is not null")

    def run(batches):
        for b in batches:
            found = [(i, v) for i, v in zip(b.column(0).to_pylist(), map(scaled, b.column(1).to_pylist()), strict=True) if v is not None]
            if found:
                ids, vecs = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(map(len, vecs), pa.int32()), pa.array(map(_length, vecs), pa.float64()), pa.array([v.tobytes() for v in vecs])],
                    names=["vec_id", "dim", "length", "vec"],
                )

    return arrow.bounded(given).mapInArrow(run, "vec_id long, dim int, length double, vec binary")


def _grouped(rows: DataFrame, most: int, key: list[str]) -> DataFrame:
    """Neighbouring rows (key, vec_id, dim, length, vec) of one key and of ``most`` bytes at most as one row (key, _GROUP)."""
    kinds = [rows.schema[c] for c in key]

    def run(batches):
        of, ids, vecs, size, longest = None, [], [], 0, 0.0

        def batch():
            group = [pa.array([v], type=t) for v, t in zip(of[1:], own, strict=True)]
            values = [pa.array([of[0]], pa.int32()), pa.array([ids[-1]], pa.int64()), pa.array([longest])]
            values += [pa.array([np.array(ids, "<i8").tobytes()]), pa.array([b"".join(vecs)], pa.binary())]
            return pa.RecordBatch.from_arrays([*group, *values], names=[*key, *(c.split()[0] for c in _GROUP.split(", "))])

        for b in batches:
            own = [b.schema.field(c).type for c in key]
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            for k, i, d, n, v in zip(zip(*map(column, ["dim", *key]), strict=True), column("vec_id"), column("dim"), column("length"), column("vec"), strict=True):
                if ids and (k != of or size + len(v) > most or len(ids) >= most // 8):
                    yield batch()
                    ids, vecs, size = [], [], 0
                if not ids:
                    of, longest = k, n
                longest = max(longest, n)
                ids.append(i)
                vecs.append(v)
                size += len(v)
        if ids:
            yield batch()

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds] + [_GROUP])
    return arrow.bounded(rows).mapInArrow(run, schema)


def buckets_of(rows: DataFrame, parts: int) -> DataFrame:
    """(bucket, _GROUP): vectors of like length; of one dimension, greater bucket numbers have shorter vectors."""
    order = ["dim", F.desc("length"), "vec_id"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return _grouped(dealt, BUCKET_BYTES, []).withColumn("bucket", F.monotonically_increasing_id())


class Best:
    """The k best of each query of a block, and what a candidate must reach."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.k, self.ids, self.vecs = k, ids, vecs
        self.length = np.array([_length(v) for v in vecs])
        self.scores, self.found = np.full((len(ids), k), _LEAST), np.full((len(ids), k), _MOST)
        self.floor = np.full(len(ids), _LEAST)
        self.looked, self.over = 0, False  # products computed; whether no bucket that is left can reach a bound

    def bound(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def seed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Takes a bucket's vectors for bounds only."""
        other = Best(self.ids, self.vecs, self.k)
        other.add(ids, vecs)
        self.floor = np.maximum(self.floor, other.scores[:, -1])

    def products(self, some: np.ndarray, vecs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact inner products of the queries ``some`` with vecs."""
        self.looked += len(some) * len(vecs)
        if not len(some) or not len(vecs) or self.length[some].max() * lengths.max() < EXACT:
            return (self.vecs[some] @ vecs.T).astype(np.int64)
        own, others = ([[int(x) for x in v] for v in a.tolist()] for a in (self.vecs[some], vecs))
        held = [[min(_MOST, max(_LEAST + 1, sum(x * y for x, y in zip(q, v, strict=True)))) for v in others] for q in own]
        return np.array(held, np.int64).reshape(len(own), len(others))

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> bool:
        """Takes a bucket's vectors, longest first; false if none can reach any query's bound, nor any shorter."""
        lengths = np.array([_length(v) for v in vecs])
        least = self.bound()
        need = least.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            most = self.length * lengths[0] * (1 + SLACK)
            live = ~(most < need)
            cosine = np.where((need > 0) & (most > 0) & np.isfinite(most), need / most, -1.0)
            keep = np.where(live, (~(self.length[:, None] * lengths[None, :] * (1 + SLACK) < need[:, None])).sum(1), 0)
        if not live.any():
            return False
        by_coordinate = live & (cosine >= COORDINATE_FROM)
        some = np.flatnonzero(live & ~by_coordinate)
        pairs = []
        if len(some):
            cut = int(keep[some].max())
            scores = self.products(some, vecs[:cut], lengths[:cut])
            scores[self.ids[some][:, None] == ids[None, :cut]] = _LEAST
            least_here = np.maximum(least[some], _LEAST + 1)
            if cut > self.k:
                least_here = np.maximum(least_here, np.partition(scores, cut - self.k, axis=1)[:, cut - self.k])
            q, c = np.nonzero(scores >= least_here[:, None])
            pairs.append((some[q], ids[c], scores[q, c]))
        if by_coordinate.any():
            pairs += self._by_coordinates(np.flatnonzero(by_coordinate), cosine, ids, vecs, lengths, least, keep)
        self._merge(*(np.concatenate(x) for x in zip(*pairs, strict=True))) if pairs else None
        return True

    def _by_coordinates(self, some, cosine, ids, vecs, lengths, least, keep):
        """Pairs of queries that need a high cosine: candidates lie, in each of the query's largest coordinates, where the cosine lets them."""
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = np.where(lengths[:, None] > 0, vecs / lengths[:, None], 0.0)
        for i in some.tolist():
            own = self.vecs[i] / self.length[i]
            wide = math.acos(min(1.0, cosine[i])) + 1e-6
            near = np.ones(int(keep[i]), bool)
            for f in np.argsort(-np.abs(own))[:FOCUS].tolist():
                angle = math.acos(max(-1.0, min(1.0, float(own[f]))))
                low = -1.0 if angle + wide >= math.pi else math.cos(angle + wide)
                high = 1.0 if angle <= wide else math.cos(angle - wide)
                x = unit[: len(near), f]
                near &= (x >= low - SLACK) & (x <= high + SLACK)
            at = np.flatnonzero(near)
            at = at[ids[at] != self.ids[i]]
            if len(at):
                scores = self.products(np.array([i]), vecs[at], lengths[at])[0]
                good = scores >= least[i]
                yield np.full(int(good.sum()), i), ids[at][good], scores[good]

    def _merge(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(queries):
            return
        touched = np.unique(queries)
        q = np.concatenate([queries, np.repeat(touched, self.k)])
        i = np.concatenate([ids, self.found[touched].ravel()])
        s = np.concatenate([scores, self.scores[touched].ravel()])
        order = np.lexsort((i, ~s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < self.k
        self.scores[q[first], place[first]], self.found[q[first], place[first]] = s[first], i[first]

    def rows(self):
        """(query, id, score) of what was found; query is a place in the block."""
        q, at = np.nonzero(self.scores > _LEAST)
        return q, self.found[q, at], self.scores[q, at]


def _search(batches, k: int):
    """Rows (dim, part, stripe, kind, ids, vecs) in this order: queries (kind 0), the longest bucket (1), buckets (2)."""
    of, held = None, []

    def found():
        for best in held:
            q, i, s = best.rows()
            digests = [hashlib.md5(v.tobytes()).digest() for v in best.vecs]
            for at in range(0, len(q), 50_000):
                some = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best.ids[q[some]]), pa.array([digests[x] for x in q[some].tolist()], pa.binary()), pa.array(i[some]), pa.array(s[some])],
                    names=["query_id", "digest", "vec_id", "score"],
                )

    for b in batches:
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("dim", "part", "stripe", "kind", "ids", "vecs")]
        for dim, part, stripe, kind, ids, vecs in zip(*columns, strict=True):
            if (dim, part, stripe) != of:
                yield from found()
                of, held = (dim, part, stripe), []
            own = np.frombuffer(ids, "<i8")
            rows = np.frombuffer(vecs, "<f8").reshape(len(own), dim)
            for best in held:
                if kind == 1:
                    best.seed(own, rows)
                elif not best.over:
                    best.over = not best.add(own, rows)
            if kind == 0:
                held.append(Best(own, rows, k))
    yield from found()


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of greatest product with each query; both tables as ``prepare`` gives them, and written."""
    spark = vectors.sparkSession
    work = Work(spark)
    size = vectors.agg(F.sum(8 * F.col("dim") + 16)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    buckets = work.table(buckets_of(vectors, parts), "buckets")
    stripes = max(1, -(-buckets.count() // STRIPE_BUCKETS))
    asked = queries.dropDuplicates(["vec_id", "vec"])
    n_blocks = max(1, -(-(asked.agg(F.sum(8 * F.col("dim") + 16)).first()[0] or 0) // BLOCK_BYTES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_blocks)).cast("int"))
    blocks = work.table(_grouped(asked.repartition("dim", "part").sortWithinPartitions("dim", "part"), BLOCK_BYTES, ["part"]), "blocks")
    every_stripe, every_part = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (stripes, n_blocks))
    row = lambda df, kind: df.select("dim", "part", "stripe", F.lit(kind).alias("kind"), "bucket", "ids", "vecs")
    rows = row(blocks.withColumn("stripe", every_stripe).withColumn("bucket", F.lit(-1).cast("long")), 0)
    longest = buckets.groupBy("dim").agg(F.min("bucket").alias("bucket")).select("bucket")
    rows = rows.union(row(buckets.join(longest, "bucket", "left_semi").withColumn("part", every_part).withColumn("stripe", every_stripe), 1))
    rows = rows.union(row(buckets.withColumn("part", every_part).withColumn("stripe", F.pmod(F.xxhash64("bucket"), F.lit(stripes)).cast("int")), 2))
    key = ["dim", "part", "stripe"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "kind", "bucket")
    found = arrow.bounded(dealt).mapInArrow(lambda batches: _search(batches, k), "query_id long, digest binary, vec_id long, score long")
    w = Window.partitionBy("query_id", "digest").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    vectors = Work(spark).table(prepare(vectors), "vectors")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
products AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM products)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
