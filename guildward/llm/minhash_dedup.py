"""MinHash near-dedup: SetSketch registers, banded; pairs judged by joint likelihood, then on the full sets.

A document's set holds its distinct word shingles. Register i of its sketch is
floor(1 - log_b(min over the set of an exponential variable)), cut to one byte:
the maximum of the registers of two sets is the register of their union, and
each register is equal in two sets with about their Jaccard similarity. Bands of
registers are hashed to bucket keys; documents that share a key may be near.

Copies: documents with one and the same set are represented by the smallest id,
so groups of copies cost one sketch row. Buckets are never expanded into rows of
pairs. A bucket's smallest id is its pivot. A document is compared with the least
of its pivots, then with those that are still in another component. Where the
rest of a bucket is in several components even so, its members go, once each, to
the group of all that such buckets connect. There those outside the group's
largest component are compared with all others: a block of bounded size is held,
the others pass by, and pairs that are connected already are passed over; what is
found is links that span what hangs together. Every pair goes through two tests:
sizes and registers must not rule the similarity out (likelihood ratio), and the
full sets must meet it exactly. A pair at the limit shares no band with
probability (1 - 0.8^8)^64, about 8e-6, a closer pair less often. For much larger
corpora raise ROWS.

Defined cases: null and empty texts have empty sets and link with nothing; a row
without doc_id links with nothing and is kept; rows that repeat a doc_id are one
node with the links of each; ties take the smallest doc_id; a very long text is read
whole, its sketch has the size of any other, and its full set moves only where it is
compared; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.common import Work, WordHash, among, components, texts

REGISTERS, ROWS = 512, 8
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.09, 20.0, 255
#: Pairs are given up unseen if the registers make the least similarity less likely than the best one by this factor (log).
GIVE_UP = 18.0
#: Documents that a block of a group holds, and blocks that pass by it in one task.
BLOCK, CHUNK = 512, 8
#: What a row is to the block that it is sent to.
ALONE, HOLD, PASS = 0, 1, 2


def _streams() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the register hashes, by a fixed rule."""
    raw = np.array([xxhash.xxh3_64_intdigest(f"register {i}".encode()) for i in range(REGISTERS)], np.uint64)
    return (raw.astype(np.uint32) | np.uint32(1)), (raw >> np.uint64(32)).astype(np.uint32)


FACTORS, OFFSETS = _streams()


def shingle_set(text: bytes | None, width: int, table: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words, A-Z lower-cased; fewer words make one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], np.uint64)
    n = len(words) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k : k + n]
    return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch registers (bytes) of a set that isn't empty."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    z = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(z), 128):
        y = z[at : at + 128, None] * FACTORS + OFFSETS
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, y.min(0))
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _ahead(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)


def _likelihood(j, u, v, more, less):
    ahead, behind = _ahead(np.maximum(u - v * j, 1e-12)), _ahead(np.maximum(v - u * j, 1e-12))
    equal = np.maximum(1 - ahead - behind, 1e-12)
    return more * np.log(np.maximum(ahead, 1e-12)) + less * np.log(np.maximum(behind, 1e-12)) + (REGISTERS - more - less) * np.log(equal)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood similarities of sets with registers ra, rb (a row each) and sizes na, nb; and which of them may reach ``least``."""
    u, v = na / (na + nb), nb / (na + nb)
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 41)[:, None] * top
    values = _likelihood(grid, u, v, more, less)
    best = values.argmax(0)
    each = np.arange(len(u))
    at_least = _likelihood(np.minimum(least, top), u, v, more, less)
    similar = grid[best, each]
    return similar, (top >= least - 1e-9) & ((similar >= least) | (values[best, each] - at_least <= GIVE_UP))


def sketches(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, digest, registers); digest and registers are null for empty sets."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("registers", T.BinaryType())]

    def make(batches):
        table = WordHash()
        for b in batches:
            rows = []
            for t in texts(b.column(b.schema.get_field_index("_text"))):
                s = shingle_set(t, width, table)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch(s).tobytes()) if len(s) else (0, None, None))
            yield list(zip(*rows, strict=True)) if rows else [[], [], []]

    return arrow.append_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), fields, make, ["doc_id"])


def bands(sets: DataFrame) -> DataFrame:
    """(key, doc_id): one 64-bit bucket key for each band of a sketch."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            r = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(ids), BANDS, ROWS)
            x = np.ascontiguousarray(r).view(np.uint64)[:, :, 0]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(29))) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], names=["key", "doc_id"])

    return sets.select("doc_id", "registers").mapInArrow(run, "key long, doc_id long")


def full_sets(docs: DataFrame, ids: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, digest, set) of the documents with these ids; the set as little-endian 64-bit hashes."""
    picked = among(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), ids)

    def make(batches):
        table = WordHash()
        for b in batches:
            sets = [shingle_set(t, width, table).tobytes() for t in texts(b.column(b.schema.get_field_index("_text")))]
            yield [[xxhash.xxh3_128_digest(s) for s in sets], sets]

    return arrow.append_columns(picked, [T.StructField("digest", T.BinaryType()), T.StructField("set", T.BinaryType())], make, ["doc_id"])


def sliced(batches, rows: int):
    """The batches in parts of so many rows, so that what is made of them stays small."""
    for b in batches:
        yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers don't rule the similarity out."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    joined = joined.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches):
        for b in sliced(batches, 2048):
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (4, 5))
                _, may = estimate(ra, rb, b.column(2).to_numpy(), b.column(3).to_numpy(), percent / 100)
                yield b.select(["a", "b"]).filter(pa.array(may))

    return joined.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in sliced(batches, 256):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                keep.append(_close(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _close(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = _common(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


class _Merged:
    """Labels that links of one block have put together; others are their own root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


class _Block:
    """The documents of one block, against which others are compared one by one."""

    def __init__(self, percent: int):
        self.percent, self.least = percent, percent / 100
        self.ids, self.labels, self.sets = [], [], []
        self.table, self.of = np.empty((16, REGISTERS), np.uint8), np.empty((2, 16), np.int64)
        self.merged, self.links = _Merged(), []
        #: Equal registers below which the likelihood could let no pair pass, by far.
        self.floor = REGISTERS * self.least - 6 * (REGISTERS * 0.25) ** 0.5

    def hold(self, doc: int, label: int, registers: bytes, items: bytes) -> None:
        n = len(self.ids)
        if n == len(self.table):
            self.table, self.of = np.concatenate([self.table, self.table]), np.concatenate([self.of, self.of], 1)
        self.ids.append(doc)
        self.labels.append(label)
        self.sets.append(np.frombuffer(items, np.uint64))
        self.table[n], self.of[:, n] = np.frombuffer(registers, np.uint8), (len(self.sets[n]), label)

    def compare(self, doc: int, label: int, registers: bytes, items: bytes) -> None:
        """Adds links that connect what hangs together between this document and the block."""
        r, x = np.frombuffer(registers, np.uint8), np.frombuffer(items, np.uint64)
        sizes, own = self.of[:, : len(self.ids)]
        at = np.flatnonzero((own != label) & (100 * np.minimum(sizes, len(x)) >= self.percent * np.maximum(sizes, len(x))))
        at = at[(self.table[at] == r).sum(1) >= self.floor]
        if not len(at):
            return
        some = self.table[at]
        _, may = estimate(some, np.broadcast_to(r, some.shape), sizes[at], np.full(len(at), len(x)), self.least)
        for i in at[may].tolist():
            if self.merged.top(self.labels[i]) != self.merged.top(label) and _close(self.sets[i], x, self.percent):
                self.merged.join(self.labels[i], label)
                self.links.append((self.ids[i], doc))


def _compare(batches, percent: int):
    """Rows (grp, block, chunk, role, doc_id, label, registers, set) in the order of the first four; yields links.

    Of each (grp, block, chunk) the rows of role HOLD and ALONE are held, those of
    role PASS are compared with them as they come, so memory holds one block.
    ALONE rows are also compared among themselves.
    """
    key, block = None, None

    def links(of: _Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in of.links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in sliced(batches, 256):
        for *now, role, doc, label, registers, items in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            if now != key:
                if block is not None and block.links:
                    yield links(block)
                key, block = now, _Block(percent)
            if role != HOLD and block.ids:
                block.compare(doc, label, registers, items)
            if role != PASS:
                block.hold(doc, label, registers, items)
    if block is not None and block.links:
        yield links(block)


def _rest(work: Work, members: DataFrame, sets: DataFrame, full: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (key, doc_id, pivot) of a bucket in different components; pivots have been compared with all."""
    named = members.where("doc_id <> pivot").select("key", "doc_id").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    named = named.withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    several = named.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.min("doc_id").alias("head")).where("_lo < _hi")
    heads = named.join(work.table(several.select("key", "head"), "several"), "key").select("doc_id", "label", "head")
    # a document has BANDS buckets at most, so the set of their heads is bounded
    heads = work.table(heads.groupBy("doc_id", "label").agg(F.collect_set("head").alias("heads"), F.min("head").alias("least")), "open")
    # the least head stands for a document's buckets: one edge to it, and one to it from each other head, keep all connected
    ends = F.explode(F.array_union("heads", F.array("doc_id")))
    groups = components(work, heads.select(ends.alias("a"), F.col("least").alias("b")))
    docs = heads.select("doc_id", "label").join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    docs = work.table(docs, "grouped")
    # Documents of a group's commonest label are connected already, so only the others are compared: with each
    # other and with those. The others' blocks have the first numbers; what comes later passes by in chunks of blocks.
    labelled = docs.groupBy("grp", "label").agg(F.count("*").alias("n"))
    blocks = labelled.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("all"))
    in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    blocks = blocks.select("grp", "top", in_blocks(F.col("all") - F.col("most")).alias("rare"), in_blocks(F.col("most")).alias("common"))
    blocks = work.table(blocks, "blocks")
    is_rare = F.col("label") != F.col("top")
    chance = F.pmod(F.xxhash64("doc_id"), F.when(is_rare, F.col("rare")).otherwise(F.col("common"))).cast("int")
    dealt = docs.join(blocks, "grp").where("rare > 0").withColumn("place", F.when(is_rare, chance).otherwise(F.col("rare") + chance))
    chunk = F.floor(F.col("place") / CHUNK).cast("int")
    last = F.floor((F.col("rare") + F.col("common") - 1) / CHUNK).cast("int")
    own = dealt.where(is_rare).select("grp", F.col("place").alias("block"), F.explode(F.sequence(chunk, last)).alias("chunk"), chunk.alias("_own"), "doc_id", "label")
    own = own.withColumn("role", F.when(F.col("chunk") == F.col("_own"), ALONE).otherwise(HOLD)).drop("_own")
    passing = dealt.where("place > 0").select("grp", F.explode(F.sequence(F.lit(0), F.least("place", "rare") - 1)).alias("block"), chunk.alias("chunk"), "doc_id", "label")
    rows = own.unionByName(passing.withColumn("role", F.lit(PASS)))
    rows = rows.join(sets.select("doc_id", "registers"), "doc_id").join(full, "doc_id")
    rows = rows.select("grp", "block", "chunk", "role", "doc_id", "label", "registers", "set")
    n = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk", "role")
    return rows.mapInArrow(lambda b: _compare(b, percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per document: the smallest doc_id that links of at least percent reach."""
    spark = docs.sparkSession
    work = Work(spark)
    all_sets = work.table(sketches(docs, width, text, doc_id), "sketches")
    groups = all_sets.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    sets = groups.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    sets = work.table(sets, "sets")
    # keys of shared buckets are written, here and below, so that joins with them shuffle both sides and can split a hot key
    shared = bands(sets).groupBy("key").agg(F.count("*").alias("_n"), F.min("doc_id").alias("pivot")).where("_n > 1").drop("_n")
    members = work.table(bands(sets).join(work.table(shared, "shared"), "key"), "members")
    ids = work.table(members.select("doc_id").distinct(), "ids")
    full = full_sets(docs, ids, width, text, doc_id).join(sets.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    full = work.table(full.dropDuplicates(["doc_id", "digest"]).select("doc_id", "set"), "full")
    pairs = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    # most documents hang on the least of their pivots; the other pivots matter only where that leaves them apart
    first = work.table(pairs.groupBy("b").agg(F.min("a").alias("a")), "first")
    found = work.table(confirmed(likely(first.select("a", "b"), sets, percent), full, percent), "links")
    labels = work.table(components(work, found), "labels")
    stars = lambda labels: labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    apart = pairs.distinct().join(first, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = apart.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    found = work.table(confirmed(likely(apart, sets, percent), full, percent), "links")
    labels = work.table(components(work, stars(labels).unionByName(found)), "labels")
    found = work.table(_rest(work, members, sets, full, labels, percent), "rest")
    nodes = components(work, stars(labels).unionByName(found))
    reps = sets.select("digest", F.col("doc_id").alias("node")).join(nodes, "node", "left").select("digest", F.coalesce("component", "node").alias("rep"))
    reps = work.table(reps, "reps")
    # a doc_id whose rows differ is one node: the copies of each row hang together through it
    out = all_sets.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left").withColumn("component_id", F.coalesce("rep", "doc_id"))
    repeated = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi")
    if repeated.limit(1).count():
        edges = out.where("doc_id is not null").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        again = components(work, edges.unionByName(edges.select(F.col("b").alias("a"), F.col("b"))))
        out = out.drop("component_id").join(again.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")
        out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
