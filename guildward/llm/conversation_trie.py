"""Prefix trie of conversations: which begin alike, and what a cache of shared turns saves.

Texts become digests in the scan; a conversation goes on as the string of its
turns' 20-byte records (MD5 of role and text, length of the text), and equal ones
as one with a count, so a group of copies is one row. Records are dealt by a hash of
the first turn to tasks of about TASK_TURNS turns, each of which builds a trie of
dictionaries and sums up its subtrees in an iterative postorder. A first turn with
more turns below it than that is not built in a task: the part that all its
conversations share is a chain with known numbers, found by the least and the
greatest of them, and what follows is dealt by its next turn, again and again,
until no part is too large. The nodes above the split parts are summed from the
deepest split upwards.

Turns are ordered by number (null first), equal numbers by the turn's record. Null
roles and texts are empty; rows without a conversation are left out; repeated rows
are turns of their own. A long text costs its record only; a conversation's records
are held in one row. Without conversations there is no node, not even a root. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guildward.llm import arrow
from guildward.llm.common import light
from guildward.tables import Work

#: Bytes of a turn's record; of these its digest.
RECORD, DIGEST = 20, 16
#: Turns of distinct conversations that a task holds, and from which a part is split by its next turn.
TASK_TURNS = 8192
#: Conversation ids are joined in ranges of so many before they are hashed in order.
RANGE = 4096
HEADS, GROUP = 6, 100

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top binary"
)
_NOBODY = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path), the records of a conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    record = F.concat(digest, F.lpad(F.hex(F.char_length(text)), 2 * (RECORD - DIGEST), "0"))  # in hexadecimal digits
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"), record.alias("record")).alias("t")
    )
    own = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["record"])
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(own, "")).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """paths, each with its first turns taken from the first conversation of its hundred: as many as a hash of its id tells."""
    n = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int") * RECORD
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("of"), F.substring("path", 1, (HEADS - 1) * RECORD).alias("head"))
    df = own.withColumns({"of": F.col("conv_id") - F.col("conv_id") % GROUP, "n": n}).join(heads, "of", "left")
    head = F.coalesce(F.expr("substring(head, 1, n)"), F.unhex(F.lit("")))
    return df.select("conv_id", F.concat(head, F.expr("substring(path, n + 1, octet_length(path))")).alias("path"))


def _hashed(batches):
    """Rows (path, range, ids) in order: (path, ends), the hash of all ids of a path, read as a stream."""
    of, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([of], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends"])
    for b in batches:
        for key, ids in zip(b.column(b.schema.get_field_index("key")).to_pylist(), b.column(b.schema.get_field_index("ids")).to_pylist(), strict=True):
            if key != of:
                if digest:
                    yield row()
                of, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if digest:
        yield row()


def distinct_paths(work: Work, all_paths: DataFrame) -> DataFrame:
    """(path, n, conv_id, ends): different conversations, how many are so, the least id, and the hash of all ids."""
    same = work.table(all_paths.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "paths")
    key = F.unhex(F.md5("path")).alias("key")
    several = same.where("n > 1").select(key)
    members = all_paths.select(key, "conv_id").join(light(several), "key", "left_semi")
    # a group of copies is joined in ranges of ids first, so that its task reads few rows
    ranges = members.groupBy("key", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = ranges.repartition("key").sortWithinPartitions("key", "range").select("key", "ids")
    ends = ordered.mapInArrow(_hashed, "key binary, ends string")
    one = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    out = same.where("n = 1").select("path", "n", "conv_id", one.alias("ends"))
    return out.unionByName(same.where("n > 1").withColumn("key", key).join(light(ends), "key").select("path", "n", "conv_id", "ends"))


class _Trie:
    """Nodes as parallel lists; children of a node by record, in a dictionary."""

    def __init__(self):
        self.children, self.parent, self.depth, self.chars = [], [], [], []
        self.n, self.conv, self.ends = [], [], []

    def node(self, parent: int | None, depth: int, chars: int) -> int:
        for held, value in ((self.children, {}), (self.parent, parent), (self.depth, depth), (self.chars, chars), (self.n, 0), (self.conv, None), (self.ends, _NOBODY)):
            held.append(value)
        return len(self.n) - 1

    def add(self, root: int, records: list[bytes], n: int, conv: int, ends: str) -> None:
        at = root
        for i, r in enumerate(records):
            child = self.children[at].get(r)
            if child is None:
                child = self.children[at][r] = self.node(at, self.depth[root] + i + 1, int.from_bytes(r[DIGEST:], "big"))
            at = child
            self.n[at] += n
            self.conv[at] = conv if self.conv[at] is None else min(conv, self.conv[at])
        self.ends[at] = ends

    def sums(self, root: int) -> tuple[dict, dict]:
        """Leaves and saved tokens of every node below root."""
        leaves, saved = {}, {}
        stack = [(c, False) for c in self.children[root].values()]
        while stack:
            at, done = stack.pop()
            below = self.children[at].values()
            if not done:
                stack.append((at, True))
                stack += [(c, False) for c in below]
                continue
            leaves[at] = sum(leaves[c] for c in below) if below else 1
            saved[at] = (self.n[at] - 1) * self.chars[at] + sum(saved[c] for c in below)
        return leaves, saved


def _built(items: pd.DataFrame) -> pd.DataFrame:
    """The nodes below the places ``top`` (with the id ``up``) of the conversations of one task."""
    trie, roots = _Trie(), {}
    for top, up, path, n, conv, ends in zip(*(items[c].tolist() for c in ("top", "up", "path", "n", "conv_id", "ends")), strict=True):
        top = bytes(top)
        if top not in roots:
            roots[top] = trie.node(None, len(top) // RECORD, 0)
            trie.conv[roots[top]] = up
        rest = bytes(path)[len(top) :]
        trie.add(roots[top], [rest[i : i + RECORD] for i in range(0, len(rest), RECORD)], n, conv, ends)
    out = []
    for top, root in roots.items():
        leaves, saved = trie.sums(root)
        for at in leaves:
            parent = trie.parent[at]
            mark = top if parent == root else None
            out.append((trie.conv[at], trie.depth[at], trie.conv[parent], trie.n[at], len(trie.children[at]), leaves[at], saved[at], trie.ends[at], mark))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])


def _chained(batches):
    """Nodes of the chains (top, low, up, conv_id, n, ends, n_children, leaves, saved), from below ``top`` to ``low``; the last values are those of low's children."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            first, last = len(row["top"]) // RECORD + 1, len(row["low"]) // RECORD
            leaves, saved = (row["leaves"] or 1), (row["saved"] or 0)
            for depth in range(last, first - 1, -1):
                saved += (row["n"] - 1) * int.from_bytes(row["low"][depth * RECORD - RECORD + DIGEST : depth * RECORD], "big")
                children, ends = (row["n_children"] or 0, row["ends"] or _NOBODY) if depth == last else (1, _NOBODY)
                up = row["up"] if depth == first else row["conv_id"]
                out.append((row["conv_id"], depth, up, row["n"], children, leaves, saved, ends, row["top"] if depth == first else None))
                if len(out) >= 10_000:
                    yield _nodes(out)
                    out = []
        if out:
            yield _nodes(out)


def _nodes(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _NODE.split(", ")])


def trie(work: Work, items: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """_NODE without top: all nodes of the different conversations (path, n, conv_id, ends), the root included."""
    spark = work.spark
    depth = lambda c: (F.octet_length(c) / RECORD).cast("long")
    root = items.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max(F.when(F.octet_length("path") == 0, F.col("ends"))).alias("ends"))
    root = work.table(root.where("n is not null"), "root")
    least = root.select(F.coalesce(F.max("conv_id"), F.lit(0))).first()[0]
    left = items.where(F.octet_length("path") > 0).withColumns({"top": F.unhex(F.lit("")), "up": F.lit(least).cast("long")})
    nodes, splits = [], []
    while True:
        # the place of the next turn; turns are counted from the place above
        place = F.expr(f"substring(path, 1, octet_length(top) + {RECORD})")
        left = left.withColumn("place", place)
        turns = F.sum(depth("path") - depth("top"))
        sizes = work.table(left.groupBy("place").agg(turns.alias("turns")), "sizes")
        large = work.table(sizes.where(F.col("turns") > task_turns).select("place"), "large")
        total = sizes.join(light(large), "place", "left_anti").agg(F.sum("turns")).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_turns))
        small = left.join(light(large), "place", "left_anti").withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks)))
        nodes.append(work.table(small.groupBy("task").applyInPandas(_built, _NODE), "nodes"))
        if not large.limit(1).count():
            break
        left = work.table(left.join(light(large), "place", "left_semi").select("place", "top", "up", "path", "n", "conv_id", "ends"), "left")
        split = left.groupBy("place").agg(
            F.first("top").alias("top"), F.first("up").alias("up"), F.min("path").alias("a"), F.max("path").alias("b"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")
        )
        split = work.table(split.mapInArrow(_lowest, "place binary, top binary, up long, n long, conv_id long, low binary"), "split")
        below = left.drop("top", "up").join(light(split.select("place", "low", F.col("conv_id").alias("up"))), "place").drop("place").withColumnRenamed("low", "top")
        ended = below.where(F.octet_length("path") == F.octet_length("top")).select(F.col("path").alias("low"), "ends")
        splits.append(work.table(split.drop("place").join(light(ended), "low", "left"), "chains"))
        left = below.where(F.octet_length("path") > F.octet_length("top"))
    tops = [n.where("top is not null").select("top", "n_leaves", "saved_tokens") for n in nodes]
    below = _union(tops)
    for chain in reversed(splits):
        sums = _summed(below)
        made = work.table(chain.join(sums, chain["low"] == sums["place"], "left").drop("place").mapInArrow(_chained, _NODE), "nodes")
        nodes.append(made)
        below = below.union(made.where("top is not null").select("top", "n_leaves", "saved_tokens"))
    sums = _summed(below.where(F.octet_length("top") == 0)).drop("place")
    nothing = F.lit(0).cast("long")
    top = root.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one", "left").select(
        "conv_id", nothing.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", nothing).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", nothing).alias("saved_tokens"), F.coalesce("ends", F.lit(_NOBODY)).alias("ends_sha256"),
    )
    return top.unionByName(_union(nodes).drop("top"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _summed(tops: DataFrame) -> DataFrame:
    """(place, n_children, leaves, saved) of the children that hang on a place."""
    return tops.groupBy(F.col("top").alias("place")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _lowest(batches):
    """The end of what all paths of a place share: that of the least (a) and the greatest (b)."""
    for b in batches:
        low = []
        for x, y in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("a", "b")), strict=True):
            n = min(len(x), len(y)) // RECORD * RECORD
            at = next((i for i in range(0, n, RECORD) if x[i : i + RECORD] != y[i : i + RECORD]), n)
            low.append(x[:at])
        names = ["place", "top", "up", "n", "conv_id"]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(low, pa.binary())], names=[*names, "low"])


def head_length(conv_id: int) -> int:
    """How many first turns a rebuilt conversation takes from the first of its hundred."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def conversation_trie(conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text) as they are, without rebuilding."""
    work = Work(arrow.bounded(conversations).sparkSession)
    return trie(work, work.table(distinct_paths(work, work.table(paths(conversations), "own")), "items"), task_turns)


def rebuilt_trie(conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    work = Work(arrow.bounded(conversations).sparkSession)
    own = work.table(paths(conversations), "own")
    return trie(work, work.table(distinct_paths(work, work.table(rebuilt(own), "rebuilt")), "items"), task_turns)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP12_SQL = """
WITH own AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, o.pos AS place, o.x FROM crc AS c JOIN own AS o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1000000 + o.pos, o.x FROM crc AS c JOIN own AS o ON o.conv_id = c.conv_id AND o.pos > c.h),
whole AS (SELECT conv_id, coalesce(list(x ORDER BY place) FILTER (x IS NOT NULL), []) AS p FROM crc LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, d, p[1:d] AS prefix, len(p) = d AS ended FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended) AS ids FROM prefixes GROUP BY d, prefix),
linked AS (
  SELECT n.*, u.conv_id AS up, coalesce((n.n - 1) * CASE WHEN n.d = 0 THEN 0 ELSE length(n.prefix[n.d].t) END, 0) AS own_saved
  FROM nodes AS n LEFT JOIN nodes AS u ON u.d = n.d - 1 AND u.prefix = n.prefix[1:n.d - 1] AND n.d > 0),
counted AS (SELECT l.*, (SELECT count(*) FROM linked AS k WHERE k.d = l.d + 1 AND k.up = l.conv_id) AS kids FROM linked AS l),
below AS (
  SELECT a.d, a.conv_id, sum(b.own_saved) AS saved, count(*) FILTER (b.kids = 0) AS leaves
  FROM counted AS a JOIN prefixes AS p ON p.d = a.d AND p.prefix = a.prefix JOIN counted AS b ON b.conv_id = p.conv_id AND b.d >= a.d GROUP BY a.d, a.conv_id)
SELECT c.conv_id, c.d::BIGINT AS depth, c.up AS parent_conv_id, c.n AS n_convs, c.kids AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(c.ids, '')) AS ends_sha256
FROM counted AS c JOIN below AS b ON b.d = c.d AND b.conv_id = c.conv_id
"""
