"""Best-fit packing of documents into sequences of fixed capacity, under conflicts.

Documents are dealt to shards of bounded size by a hash of what they are, so a hot
source spreads over all shards, and so do rows that repeat, and each shard is packed by itself, longest
last piece first. Bins are ordered by what they have left and carry a bitmap of the sources
and one of the duplicate clusters in them: no bin holds two documents of one
source or of one cluster. A document goes to the tightest bin that is compatible;
the search runs from the least sufficient residual to its successors, and opens a
new bin only if none is compatible. For sources that hold much of a shard the
residuals with a compatible bin are kept as a bitmap, so that the search need not
pass the bins that hold the source.

A document longer than the capacity is cut into full pieces, each alone in its
bin, and a last piece that is packed like any other; nothing is dropped.

Defined cases: a document of n words takes n + 1 places (its end mark), so null
and empty texts take one; a null source or cluster conflicts with nothing; ties
in length go by id, then by place in the shard; null ids come last; repeated rows
are packed each; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.common import texts

CAPACITY = 2048
#: Documents of a shard, about.
SHARD_DOCS = 16_384
#: Equal items that are dealt together.
ALIKE = 16
#: Sources with more than this share of a shard get a bitmap of residuals.
HOT_SHARE = 0.01


class Shard:
    """The bins of one shard."""

    def __init__(self, capacity: int, hot: dict):
        self.capacity = capacity
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        #: Bit r: some bin has r left, and (for a hot source) doesn't hold the source.
        self.any = 0
        self.hot = hot
        self.free = dict.fromkeys(hot, 0)
        self.counts = {s: [0] * (capacity + 1) for s in hot}

    def _mark(self, b: int, step: int) -> None:
        r, held = self.left[b], self.sources[b]
        if step > 0:
            self.at[r][b] = None
        else:
            del self.at[r][b]
        self.any = self.any | 1 << r if self.at[r] else self.any & ~(1 << r)
        for s in self.hot:
            if not held >> s & 1:
                counts = self.counts[s]
                counts[r] += step
                if step > 0:
                    self.free[s] |= 1 << r
                elif not counts[r]:
                    self.free[s] &= ~(1 << r)

    def fill(self) -> int:
        """A bin that is full from the start: nothing fits in, so it needs no bitmaps."""
        self.left.append(0)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.left) - 1

    def put(self, length: int, source: int | None, cluster: int | None) -> int:
        """The bin that takes a document; source and cluster are bit numbers."""
        mask_s = 0 if source is None else 1 << source
        mask_c = 0 if cluster is None else 1 << cluster
        bits = self.free.get(source, self.any) >> length << length
        while bits:
            r = (bits & -bits).bit_length() - 1
            for b in self.at[r]:
                if not self.sources[b] & mask_s and not self.clusters[b] & mask_c:
                    self._mark(b, -1)
                    self.left[b] -= length
                    self.sources[b] |= mask_s
                    self.clusters[b] |= mask_c
                    self._mark(b, 1)
                    return b
            bits &= bits - 1
        self.left.append(self.capacity - length)
        self.sources.append(mask_s)
        self.clusters.append(mask_c)
        self._mark(len(self.left) - 1, 1)
        return len(self.left) - 1


def _numbers(values: list) -> list[int | None]:
    """Bit numbers of the values that occur more than once, None for others and nulls."""
    seen, several = set(), {}
    for v in values:
        if v is not None and v in seen:
            several.setdefault(v, len(several))
        seen.add(v)
    return [several.get(v) for v in values]


def pack_shard(ids: list, lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, start, length, bin) for every piece of every document of a shard."""
    last = [1 + (n - 1) % capacity for n in lengths]
    order = sorted(range(len(ids)), key=lambda i: (-last[i], ids[i] is None, ids[i] or 0, i))
    source, cluster = _numbers(sources), _numbers(clusters)
    times = np.bincount([s for s in source if s is not None], minlength=1)
    shard = Shard(capacity, {int(s): None for s in np.flatnonzero(times > max(1, HOT_SHARE * len(ids)))})
    out = []
    for i in order:
        full = (lengths[i] - 1) // capacity
        out += [(i, k, k * capacity, capacity, shard.fill()) for k in range(full)]
        out.append((i, full, full * capacity, last[i], shard.put(last[i], source[i], cluster[i])))
    return out


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", cluster: str | None = None) -> DataFrame:
    """(doc_id, source, length, cluster): words and end mark of the whole text.

    cluster names a column with a document's group of near copies (as the
    component_id of ``near_duplicates``); without one, exact copies up to case
    and white space share a cluster.
    """

    def make(batches):
        for b in batches:
            words = [arrow.words_of(t) for t in texts(b.column(b.schema.get_field_index("_text")))]
            yield [[len(w) + 1 for w in words], [xxhash.xxh3_64_intdigest(b" ".join(w).lower()) - (1 << 63) if w else None for w in words]]

    known = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    group = [known(cluster).alias("_group")] if cluster else []
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(source).alias("source"), F.col(text).alias("_text"), *group)
    fields = [T.StructField("length", T.LongType()), T.StructField("cluster", T.LongType())]
    out = arrow.append_columns(picked, fields, make, ["doc_id", "source", *(["_group"] if cluster else [])])
    return out.withColumn("cluster", F.col("_group")).drop("_group") if cluster else out


def pack(items: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id) for items (doc_id, source, length, cluster).

    Equal items are counted first, and each ALIKE of them are dealt by
    themselves, so that a row that repeats without bound has no shard of its own.
    """
    if shards is None:
        shards = max(1, -(-items.select("doc_id").count() // SHARD_DOCS))
    alike = items.groupBy("doc_id", "source", "length", "cluster").agg(F.count("*").alias("times"))
    lots = F.floor((F.col("times") - 1) / ALIKE)
    alike = alike.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lots)))
    alike = alike.withColumn("times", F.least(F.col("times") - F.col("lot") * ALIKE, F.lit(ALIKE)))
    deal: Column = F.pmod(F.xxhash64("doc_id", "source", "length", "cluster", "lot"), F.lit(shards))

    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        t = t.take(np.repeat(np.arange(t.num_rows), t["times"].to_numpy()))
        t = t.sort_by([("doc_id", "ascending"), ("length", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        ids = t["doc_id"].to_pylist()
        rows = pack_shard(ids, t["length"].to_pylist(), t["source"].to_pylist(), t["cluster"].to_pylist(), capacity)
        row, piece, start, length, place = zip(*rows, strict=True)
        return pa.table(
            {
                "doc_id": pa.array([ids[i] for i in row], pa.int64()),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "bin_id": pa.array([shard << 32 | b for b in place], pa.int64()),
            }
        )

    dealt = alike.select("doc_id", "source", "length", "cluster", "times", deal.alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, bin_id long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack(measured(docs), shards=max(1, -(-docs.count() // SHARD_DOCS)))
