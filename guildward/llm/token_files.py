"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a sequence of zstandard frames, readable as one stream, followed by a
skippable frame with the seek table (sizes and checksums of all frames). Frame 0
is the index: place of the file, width of an id, and doc_id and token count of
each document; frame k holds the ids of document k. So a reader takes the seek
table and frame 0, then decompresses only the documents that it wants.

Files are written by Spark's text sink, one row a file: each row is a file's
bytes without its last four, and these, the seek table's magic number, are the
sink's line separator. Writes so go through the committer and any Hadoop store,
and a lost task leaves no half file. This rests on the sink copying a string's
bytes as they are, valid UTF-8 or not; every frame's checksum would tell if it
did not, and a test writes all byte values. Files cover ascending ranges of
doc_id; a running total over them, a row each, needs one task: FILE_BYTES bounds
their number at some ten thousand a terabyte of ids.

Defined cases: a null text is an empty one; every document ends with the end id;
null doc_ids come first; rows with equal doc_id follow each other in the order of
a hash of their texts, then of their ids' bytes, and one that fills several
ranges is spread over them by that hash; an empty table writes no frames.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.bpe import _Bounded, _byte_letters, as_assumed, latin_parts, vocabulary_path
from guildward.llm.common import Work, sized, texts

END_ID = 2
#: Documents that a range of doc_ids holds about, and bytes of ids after which a file is closed.
RANGE_DOCS = 2048
#: Ranges at most; in larger corpora a range holds more documents and is cut into more files.
MAX_RANGES = 8192
FILE_BYTES = 8 << 20
SEEK_MAGIC = 0x8F92EAB1
SKIPPABLE = 0x184D2A5E
#: Index: part, number in the part, bytes of an id, documents.
_HEAD = struct.Struct("<iiii")
_ENTRY = struct.Struct("<III")
NO_ID = -(1 << 63)


class Library:
    """Ids by the tokenizers library, part by part with a cache.

    Latin texts are split as the library splits them; of others a word is the
    unit, as no token spans ASCII white space. Under a file with other settings
    than those assumed the library encodes whole texts.
    """

    def __init__(self, path: str, cached: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = f"<u{self.width}"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            self.by_parts = as_assumed(json.load(f))
        self.parts = _Bounded(self._part, cached)
        self.words = _Bounded(self._word, cached // 4)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _part(self, part: str) -> bytes:
        """Ids of a part that is normalised and not split any more, by the library's model."""
        text = part if part.isascii() and part.isalpha() else "".join([self.letters[b] for b in part.encode()])
        return self._packed([t.id for t in self.model.tokenize(text)])

    def _word(self, word: bytes) -> bytes:
        return self._packed(self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0].ids)

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_parts:
            return self._packed(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids)
        parts = latin_parts(text)
        if parts is None:
            words = self.words
            return b"".join([words[w] for w in text.split()])
        return b"".join(map(self.parts.__getitem__, parts))


_LIBRARIES: dict[str, Library] = {}


def library(path: str) -> Library:
    """This worker's tokenizer of the file."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


def file_bytes(part: int, number: int, width: int, ids: list[int], payloads: list[bytes]) -> bytes:
    """A whole file of the documents ids, whose token ids (little-endian, ``width`` bytes each) are payloads."""
    import zstandard

    index = _HEAD.pack(part, number, width, len(ids)) + np.array(ids, "<i8").tobytes() + np.array([len(p) // width for p in payloads], "<i8").tobytes()
    pack = zstandard.ZstdCompressor(level=1).compress
    frames, table = [], []
    for data in (index, *payloads):
        frames.append(pack(data))
        table.append(_ENTRY.pack(len(frames[-1]), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
    tail = b"".join(table) + struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(tail)) + tail


class Reader:
    """Random access to a file's documents."""

    def __init__(self, data):
        import zstandard

        self.data = memoryview(data)
        frames, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self.data[-9 - 12 * frames : -9], "<u4").reshape(frames, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.sizes, self.sums = table[:, 1], table[:, 2]
        self.unpack = zstandard.ZstdDecompressor().decompress
        head = self.frame(0)
        self.part, self.number, self.width, n = _HEAD.unpack(head[: _HEAD.size])
        self.doc_ids, self.counts = np.frombuffer(head[_HEAD.size :], "<i8").reshape(2, n)

    def frame(self, k: int) -> bytes:
        out = self.unpack(self.data[self.starts[k] : self.starts[k + 1]], max_output_size=int(self.sizes[k])) if self.sizes[k] else b""
        if len(out) != self.sizes[k] or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return out

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the file's document k, from 0."""
        return np.frombuffer(self.frame(k + 1), f"<u{self.width}")


def _encoded(docs: DataFrame, path: str, bounds: list[int]) -> DataFrame:
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("mix", T.LongType())]

    def make(batches):
        lib, cuts = library(path), np.array(bounds, np.int64)
        end = np.array([END_ID], lib.code).tobytes()
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            given = texts(b.column(1))
            mix = np.array([xxhash.xxh64_intdigest(t or b"") >> 11 for t in given], np.int64)
            # an id that is a bound several times fills the ranges between, in the order of the hash
            first, last = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
            part = first + (mix / (1 << 53) * (last - first + 1)).astype(np.int64)
            yield [[lib.encode(t) + end for t in given], np.minimum(part, last).astype(np.int32), mix]

    return arrow.append_columns(docs, fields, make, ["doc_id"])


def write(docs: DataFrame, path: str, folder: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the token files of docs into folder, ranges of doc_id by range."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = min(MAX_RANGES, max(1, round(docs.count() / RANGE_DOCS)))
    placed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    bounds = sorted(int(x) for x in placed.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)) if ranges > 1 else []
    width = library(path).width
    dealt = _encoded(docs, path, bounds).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id", "mix", "ids")

    def run(batches):
        ids, payloads, size, number, part = [], [], 0, 0, 0

        def closed():
            whole = file_bytes(part, number, width, ids, payloads)
            return pa.RecordBatch.from_arrays([pa.array([whole[:-4]], pa.binary()).view(pa.string())], names=["value"])

        for b in batches:
            for i, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if ids and size + len(p) > FILE_BYTES:
                    yield closed()
                    ids, payloads, size, number = [], [], 0, number + 1
                part = x
                ids.append(NO_ID if i is None else i)
                payloads.append(p)
                size += len(p)
        if ids:
            yield closed()

    rows = dealt.select("doc_id", "ids", "part").mapInArrow(run, "value string")
    magic = struct.pack("<I", SEEK_MAGIC).decode("latin-1")
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", magic).option("maxRecordsPerFile", 1).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")

    def heads(batches):
        for b in batches:
            for content in b.column(0):
                r = Reader(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([r.part], pa.int32()), pa.array([r.number], pa.int32()), pa.array([int(r.counts.sum())])], names=["part", "number", "total"])

    def documents(batches):
        for b in batches:
            for content in b.column(0):
                r = Reader(content.as_buffer())
                n = len(r.doc_ids)
                crc = [zlib.crc32(r.tokens(k).astype("<u4").tobytes()) for k in range(n)]
                columns = [
                    pa.array(r.doc_ids, mask=r.doc_ids == NO_ID),
                    pa.array(np.full(n, r.part, np.int32)),
                    pa.array(np.full(n, r.number, np.int32)),
                    pa.array(np.cumsum(r.counts) - r.counts),
                    pa.array(r.counts),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "number", "inside", "n_tokens", "ids_crc32"])

    # one row a file, so far fewer than documents: a running total over them needs one task
    totals = files.mapInArrow(heads, "part int, number int, total long")
    before = totals.withColumn("before", F.sum("total").over(Window.orderBy("part", "number")) - F.col("total")).drop("total")
    rows = files.mapInArrow(documents, "doc_id long, part int, number int, inside long, n_tokens long, ids_crc32 long")
    joined = rows.join(sized(before), ["part", "number"])
    return joined.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = Work(spark).path("tokens")
    write(docs, vocabulary_path(), folder)
    return read(spark, folder)
