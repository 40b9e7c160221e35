"""Arrow batch functions: text statistics over UTF-8 bytes, and columns appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
#: Texts of about so many bytes are handled at a time, whatever the batch that Arrow brings.
CHUNK_BYTES = 8 << 20
#: Rows that ``append_columns`` hands on at a time, so that results and copies stay small beside the batch.
SLICE_ROWS = 1024


#: Bytes of an Arrow batch that Spark hands to Python: rows hold whole texts, so their number bounds nothing.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, after the session's bound of an Arrow batch is set to BATCH_BYTES; it holds for what runs later, and only less memory comes of it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of ``keep``) with ``fields``, whose values ``make`` yields batch by batch.

    ``make`` takes an iterator of record batches of df and yields a list of
    value sequences for each. Names of ``fields`` must not be among the kept.
    """
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []

        def watched():
            for b in batches:
                for at in range(0, b.num_rows, SLICE_ROWS):
                    seen.append(b.slice(at, SLICE_ROWS))
                    yield seen[-1]

        for values in make(watched()):
            b = seen.pop()
            own = [b.column(b.schema.get_field_index(c)) for c in keep]
            new = [pa.array(v, type=k) if not isinstance(v, pa.Array) else v.cast(k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(own + new, names=schema.names)

    return bounded(df).mapInArrow(run, schema)


def chunks(texts: list, most: int = CHUNK_BYTES) -> Iterator[list]:
    """Consecutive parts of texts, each of about most bytes at most or a single text."""
    part, size = [], 0
    for t in texts:
        n = len(t or b"")
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() parts at just these six characters."""
    return text.split() if text else []


def code_points(text: bytes, without: bytes = b"") -> int:
    """Code points of text that are none of the (ASCII) characters of ``without``."""
    return len(text.translate(None, CONTINUATION + without))


def count_bytes(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def repeated_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words covered by the 8-word windows that occur twice or more; windows are told apart by 64-bit hashes."""
    assert width == 8
    n = len(hashes)
    if n <= width:
        return 0
    two = hashes[:-1] * _MIX[0] + (hashes[1:] ^ (hashes[1:] >> np.uint64(31)))
    four = two[:-2] * _MIX[1] + (two[2:] ^ (two[2:] >> np.uint64(29)))
    eight = four[:-4] * _MIX[2] + (four[4:] ^ (four[4:] >> np.uint64(32)))
    order = np.sort(eight)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    twice = np.isin(eight, np.unique(order[1:][same]))
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())
