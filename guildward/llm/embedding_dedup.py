"""Embedding near-dedup: spherical-cap filters from structured random product codes, joined and verified.

Each of REPEATS codes turns a vector by random signs and a Hadamard transform,
cuts it in two blocks and has CODES random directions for each; a filter is a
pair of them, its cap the vectors whose two block products add up to a limit,
the same for all, such that a random vector lies in LISTED caps on average (in
more where a sample shows that pairs would be missed). A vector is decoded to the
list of all filters whose cap holds it. Vectors of a label that share a filter
are compared by exact cosines in double precision.

Equal vectors of a label are compared once, with their number as weight. A
filter's vectors are compared in blocks of bounded size, by matrix products, and
a pair counts only in the first filter that both share; from a block come sums
of links per vector and a spanning set of links, never all pairs. Measured, a
pair at cosine 0.93 shares no filter in about 3 of a million cases, a closer
pair less often.

Defined cases: null, zero and non-finite vectors, vectors with null components,
null labels and rows without vec_id link with nothing; vectors of different
length are not compared; rows that repeat a vec_id count as vectors of their
own; ties take the smallest vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.common import Work, components

LEAST = 0.93
REPEATS, CODES, LISTED, SHARED = 64, 40, 50, 3
#: Vectors of a filter that one block holds; two blocks at a time are compared.
BLOCK = 1024
#: Cosines as near to the limit as rounding could be.
DOUBT = 1e-12
#: Groups up to this size are compared together, by size.
SMALL = 16


class Code:
    """The filters for vectors of one length."""

    def __init__(self, dim: int):
        self.dim, self.padded = dim, 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng(dim)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (REPEATS, self.padded))
        codes = rng.standard_normal((REPEATS, 2, CODES, self.padded // 2))
        self.codes = codes / (np.linalg.norm(codes, axis=3, keepdims=True) * np.sqrt(2))
        self._settle(rng)

    def _settle(self, rng) -> None:
        """Sets the limit that leaves LISTED filters to a random vector, or twice as many and so on, until all of
        a sample of pairs at the least cosine share SHARED filters: in few dimensions lists vary more. Where
        no limit does (below about five dimensions) all vectors share one filter, so all are compared."""
        x, z = rng.standard_normal((2, 512, self.dim)) if self.dim > 1 else np.ones((2, 512, 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = LEAST * x + (1 - LEAST**2) ** 0.5 * z
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        full = np.zeros((256, self.padded))
        full[:, : self.dim] = x[:256]
        sums = []
        for k in range(0, REPEATS, 8):
            w = self._turned(full * self.signs[k]).reshape(len(full), 2, -1)
            first, second = w[:, 0] @ self.codes[k, 0].T, w[:, 1] @ self.codes[k, 1].T
            sums.append((first[:, :, None] + second[:, None]).ravel())
        sums, listed = np.sort(np.concatenate(sums)), LISTED
        while True:
            self.limit = float(sums[-max(1, int(len(sums) * listed / (REPEATS * CODES * CODES)))])
            pairs = zip(self.decode(x), self.decode(y), strict=True)
            if all(len(np.intersect1d(a, b, assume_unique=True)) >= SHARED for a, b in pairs):
                return
            listed *= 2
            if listed > REPEATS * CODES:
                self.limit = None
                return

    def _turned(self, x: np.ndarray) -> np.ndarray:
        n, size, step = len(x), self.padded, 1
        while step < size:
            y = x.reshape(n, -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
            step *= 2
        return x / np.sqrt(size)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the sorted numbers of all filters whose cap holds it."""
        if self.limit is None:
            return [np.zeros(1, "<i4") for _ in unit]
        x = np.zeros((len(unit), self.padded))
        x[:, : self.dim] = unit
        rows, filters = [], []
        for k in range(REPEATS):
            y = self._turned(x * self.signs[k]).reshape(len(x), 2, -1)
            first, second = y[:, 0] @ self.codes[k, 0].T, y[:, 1] @ self.codes[k, 1].T
            i, a = np.nonzero(first >= self.limit - second.max(1, keepdims=True))
            j, b = np.nonzero(first[i, a][:, None] + second[i] >= self.limit)
            rows.append(i[j])
            filters.append((k * CODES + a[j]) * CODES + b)
        rows, filters = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((filters, rows))
        return np.split(filters[order].astype("<i4"), np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])


_CODES: dict[int, Code] = {}


def code(dim: int) -> Code:
    if dim not in _CODES:
        _CODES[dim] = Code(dim)
    return _CODES[dim]


def _vector(values: list | None) -> bytes | None:
    """A vector that can link as bytes (4 a component if that is exact, else 8), any other as null."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    return (narrow if (narrow == x).all() else x).tobytes()


def unit_rows(vectors: list[bytes], dim: int) -> np.ndarray:
    """The vectors scaled to length one, in double precision."""
    widths = {len(v) for v in vectors}
    if widths == {4 * dim} or widths == {8 * dim}:
        x = np.frombuffer(b"".join(vectors), np.float32 if widths == {4 * dim} else np.float64).astype(np.float64).reshape(-1, dim)
    else:
        x = np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Bytes:
    """The values of a binary Arrow column, read where they lie."""

    def __init__(self, column: pa.ChunkedArray):
        array = column.combine_chunks()
        array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
        self.ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
        self.data = memoryview(array.buffers()[2]) if array.buffers()[2] is not None else memoryview(b"")

    def __getitem__(self, i: int) -> memoryview:
        return self.data[self.ends[i] : self.ends[i + 1]]


class _Links:
    """Links found by one task: sums per vector, and links that span what hangs together."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.edges: set[tuple[int, int]] = set()

    def add(self, ids, weights):
        for i, w in zip(ids.tolist(), weights.tolist(), strict=True):
            self.counts[i] = self.counts.get(i, 0) + w

    def batches(self, most: int = 50_000):
        """Record batches (a, b, links): sums have no b, links no sum."""
        counts, edges = list(self.counts.items()), list(self.edges)
        for rows, other in ((counts, "links"), (edges, "b")):
            for k in range(0, len(rows), most):
                a, x = (pa.array(v, pa.int64()) for v in zip(*rows[k : k + most], strict=True))
                given = {"a": a, "b": pa.nulls(len(a), pa.int64()), "links": pa.nulls(len(a), pa.int64())} | {other: x}
                yield pa.RecordBatch.from_arrays(list(given.values()), names=list(given))


def _first_shared(a: bytes, b: bytes) -> int:
    return int(np.intersect1d(np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4"), assume_unique=True)[0])


def exact(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine of two unit vectors, by one formula whatever group they are compared in."""
    return math.fsum((x * y).tolist())


def _reach(sims: np.ndarray, first, second, unit: np.ndarray, least: float) -> np.ndarray:
    """Which similarities reach the limit; those within rounding of it are told by ``exact``. first and second give a place's rows of unit."""
    near = sims >= least
    for at in np.argwhere(np.abs(sims - least) < DOUBT).tolist():
        near[tuple(at)] = exact(unit[first(at)], unit[second(at)]) >= least
    return near


def _compare_small(links: _Links, size: int, at: np.ndarray, unit, ids, weights, filters, own: np.ndarray, least: float) -> None:
    """Groups of ``size`` rows from ``at`` on, all at once; own holds the filter of each group."""
    x, y = np.triu_indices(size, 1)
    for k in range(0, len(at), 4096):
        a, b = (at[k : k + 4096, None] + x).ravel(), (at[k : k + 4096, None] + y).ravel()
        near = _reach(np.einsum("ij,ij->i", unit[a], unit[b]), lambda at: a[at[0]], lambda at: b[at[0]], unit, least)  # noqa: B023
        for i, j, f in zip(a[near].tolist(), b[near].tolist(), np.repeat(own[k : k + 4096], len(x))[near].tolist(), strict=True):
            if _first_shared(filters[i], filters[j]) == f:
                for p, q in ((int(ids[i]), weights[j]), (int(ids[j]), weights[i])):
                    links.counts[p] = links.counts.get(p, 0) + int(q)
                links.edges.add((int(ids[i]), int(ids[j])))


def _compare_large(links: _Links, left: np.ndarray, right: np.ndarray | None, unit, ids, weights, filters, own: int, least: float) -> None:
    """All rows of left against all of right, or left's among themselves."""
    both = left if right is None else np.concatenate([left, right])
    n = len(left)
    other = both if right is None else right
    near = _reach(unit[left] @ unit[other].T, lambda at: left[at[0]], lambda at: other[at[1]], unit, least)
    earlier = [f[: np.searchsorted(f, own)] for f in (np.frombuffer(filters[i], "<i4") for i in both)]
    names, place, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(f) for f in earlier])
    for k in range(0, len(names), 512):
        held = np.zeros((len(both), min(512, len(names) - k)), np.float32)
        some = (place >= k) & (place < k + 512) & (times[place] > 1)
        held[row[some], place[some] - k] = 1
        near &= (held @ held.T if right is None else held[:n] @ held[n:].T) == 0
    w, name = np.asarray(weights, np.int64)[both], np.asarray(ids, np.int64)[both]
    if right is None:
        np.fill_diagonal(near, False)
        links.add(name, near @ w)
        grown = near
    else:
        links.add(name[:n], near @ w[n:])
        links.add(name[n:], near.T @ w[:n])
        grown = np.zeros((len(both), len(both)), bool)
        grown[:n, n:], grown[n:, :n] = near, near.T
    root = np.arange(len(both))
    while True:  # least root of the neighbours, until nothing changes
        low = np.minimum(root, np.where(grown, root, len(both)).min(1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    for i in np.flatnonzero(root != np.arange(len(both))).tolist():
        links.edges.add((int(name[i]), int(name[root[i]])))


def _compare(batches, least: float):
    """Rows (dim, filter, left, right, rep, weight, vec, filters, block) in the order of their groups; yields (a, b, links)."""
    links, carry = _Links(), None
    columns = ["label", "dim", "filter", "left", "right", "rep", "weight", "vec", "filters", "block"]

    def groups(t: pa.Table, key: np.ndarray, cut: np.ndarray) -> None:
        """Compares the groups of t that cut parts; key has their dim, filter, left and right."""
        n = t.num_rows
        ids, weights, block = (t[c].to_numpy() for c in ("rep", "weight", "block"))
        filters, vec = _Bytes(t["filters"]), _Bytes(t["vec"])
        dims, own, left, right = key
        size = np.diff(cut)
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims[cut[:-1]] == dim)
            which = np.flatnonzero(dims == dim)
            unit = np.zeros((n, dim))
            unit[which] = unit_rows([vec[i] for i in which.tolist()], int(dim))
            small = (size[mine] <= SMALL) & (left[cut[mine]] == right[cut[mine]])
            for k in np.unique(size[mine[small]]).tolist():
                if k > 1:
                    at = cut[mine[small & (size[mine] == k)]]
                    _compare_small(links, k, at, unit, ids, weights, filters, own[at], least)
            for g in mine[~small].tolist():
                a, b = cut[g], cut[g + 1]
                if left[a] == right[a]:
                    _compare_large(links, np.arange(a, b), None, unit, ids, weights, filters, own[a], least)
                else:
                    one, two = a + np.flatnonzero(block[a:b] == left[a]), a + np.flatnonzero(block[a:b] == right[a])
                    if len(one) and len(two):
                        _compare_large(links, one, two, unit, ids, weights, filters, own[a], least)

    def taken(t: pa.Table, whole: bool) -> pa.Table:
        """Compares t's groups, but for the last one if more of it may come, which is returned."""
        label = t["label"].combine_chunks().dictionary_encode()
        label = label.indices if isinstance(label, pa.DictionaryArray) else label.unify_dictionaries().combine_chunks().indices
        key = np.stack([t[c].to_numpy() for c in ("dim", "filter", "left", "right")])
        codes = label.to_numpy(zero_copy_only=False)
        new = (key[:, 1:] != key[:, :-1]).any(0) | (codes[1:] != codes[:-1])
        cut = np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])
        if not whole:
            cut = cut[:-1]
        if len(cut) > 1:
            groups(t.slice(0, cut[-1]), key[:, : cut[-1]], cut)
        return t.slice(cut[-1])

    for b in batches:
        t = pa.Table.from_batches([b]).select(columns)
        t = pa.concat_tables([carry, t]) if carry is not None else t
        if t.num_rows:
            carry = taken(t, False)
    if carry is not None and carry.num_rows:
        taken(carry, True)
    yield from links.batches()


def near_vectors(vectors: DataFrame, least: float = LEAST, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector."""
    work = Work(vectors.sparkSession)
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("_v"))

    def prepare(batches):
        for b in batches:
            vec = [_vector(v) for v in b.column(b.schema.get_field_index("_v")).to_pylist()]
            dims = [len(v) if v is not None else None for v in b.column(b.schema.get_field_index("_v")).to_pylist()]
            yield [dims, vec, [xxhash.xxh3_128_digest(v) if v else None for v in vec]]

    fields = [T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType()), T.StructField("digest", T.BinaryType())]
    every = work.table(arrow.append_columns(given, fields, prepare, ["vec_id", "label"]), "vectors")
    usable = every.where("vec is not null and label is not null and vec_id is not null")
    reps = usable.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec"))

    def decode(batches):
        for b in batches:
            dims, vecs = b.column(b.schema.get_field_index("dim")).to_pylist(), b.column(b.schema.get_field_index("vec")).to_pylist()
            out: list[bytes | None] = [None] * len(dims)
            for dim in set(dims):
                which = [i for i, d in enumerate(dims) if d == dim]
                for k in range(0, len(which), 500):
                    some = which[k : k + 500]
                    for i, f in zip(some, code(dim).decode(unit_rows([vecs[i] for i in some], dim)), strict=True):
                        out[i] = f.tobytes()
            yield [out]

    reps = work.table(arrow.append_columns(reps, [T.StructField("filters", T.BinaryType())], decode), "filters")

    def explode(batches):
        for b in batches:
            lists = [np.frombuffer(f, "<i4") for f in b.column(3).to_pylist()]
            if lists:
                rows = pa.array(np.repeat(np.arange(len(lists)), [len(f) for f in lists]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(np.concatenate(lists))],
                    names=["label", "dim", "rep", "filter"],
                )

    held = reps.select("label", "dim", "rep", "filters").mapInArrow(explode, "label string, dim int, rep long, filter int")
    key = ["label", "dim", "filter"]
    sizes = held.groupBy(key).agg(F.count("*").alias("size")).where("size > 1")
    # written, so that the join shuffles both sides itself and can split a filter with very many vectors
    sizes = work.table(sizes.select(*key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "sizes")
    # a member of a large filter goes to the pairs of its own block with every block
    dealt = held.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "rep", "block")
    rows = dealt.join(reps.select("rep", "label", "dim", "weight", "vec", "filters"), ["rep", "label", "dim"])
    group = ["label", "dim", "filter", "left", "right"]
    rows = rows.select(*group, "rep", "weight", "vec", "filters", "block")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *group).sortWithinPartitions(*group)
    found = work.table(rows.mapInArrow(lambda b: _compare(b, least), "a long, b long, links long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    nodes = components(work, found.where("b is not null").select("a", "b"))
    known = reps.select("label", "dim", "digest", "rep", "weight").join(counts.withColumnRenamed("a", "rep"), "rep", "left")
    known = known.join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    out = every.drop("vec").join(known, ["label", "dim", "digest"], "left")
    alone = F.col("vec_id").isNull()
    out = out.select(
        "vec_id",
        F.when(alone, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_links"),
        F.when(~alone, F.coalesce("_c", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
