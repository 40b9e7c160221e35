"""Shared plumbing: members of an id table, connected components, word hashes."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildward.llm import bloom
from guildward.tables import Work

#: Rows up to which a side of (id, flag) pairs may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many (narrow) rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes up to which a side whose rows have no bounded width may be broadcast.
BROADCAST_BYTES = 32 << 20


def light(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values, added up, have at most so many bytes, else as it is."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, a table (doc_id, text), whose id is in column doc_id of ids (distinct).

    Few ids are broadcast. Of many, a Bloom filter of bounded size is, so that
    only texts of members, and of what the filter lets through, move to the
    equi-join that decides.
    """
    n = ids.count()
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    blocks = min(bloom.blocks_for(n), bloom.BROADCAST_BLOCKS)
    key, filled = F.col("doc_id"), F.broadcast(bloom.table(ids, "doc_id", blocks))
    maybe = docs.withColumn("block", bloom.block(key, blocks)).join(filled, "block").where(bloom.passed(key))
    return maybe.select(*docs.columns).join(ids, "doc_id", "left_semi").select(*docs.columns)


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in column doc_id of ids (distinct), null ids among them; as in ``among``, few other rows move."""
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    rows, key, gone = docs.toDF(*own), F.col(own[names.index(doc_id)]), ids.select(F.col("doc_id").alias("id"))
    n = ids.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), key == F.col("id"), "left_anti").toDF(*names)
    blocks = min(bloom.blocks_for(n), bloom.BROADCAST_BLOCKS)
    filled = F.broadcast(bloom.table(ids, "doc_id", blocks))
    probed = rows.withColumn("block", bloom.block(key, blocks)).join(filled, "block", "left").select(*own, bloom.passed(key).alias("maybe"))
    kept = probed.where("not maybe").drop("maybe")
    return kept.unionByName(probed.where("maybe").drop("maybe").join(gone, key == F.col("id"), "left_anti")).toDF(*names)


def unlike(columns: list[str], results) -> list[str]:
    """The columns that are not called like a result, in any case."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def fresh(columns: list[str], names: list[str]) -> list[str]:
    """names, each with underscores before it until no column is called so, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node that links reach.

    Alternates large-star and small-star steps, each a map-side combined
    minimum and an equi-join, until the edges are stars around the minima: no
    node has two smaller neighbours, or a smaller and a larger one.
    Self-loops and nulls are dropped; no edges give no rows.
    """
    e = work.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        # written, so that the join shuffles both sides itself and can split a node with very many neighbours
        of_u = work.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(of_u, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m")).distinct()
        after = work.table(small, "edges")
        ends = after.select(F.col("hi").alias("x"), F.lit(1).alias("h")).union(after.select("lo", F.lit(0)))
        times = ends.groupBy("x").agg(F.sum("h").alias("up"), F.min("h").alias("end"))
        open_ = times.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("end") == 0))).first()[0]
        work.drop(e)
        work.drop(of_u)
        e = after
        if not open_:
            break
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(e.select("lo", "lo").distinct())


class WordHash(dict):
    """64-bit hashes of words, computed once; forgets all beyond a bound."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def texts(column) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
