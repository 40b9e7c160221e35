"""BPE encoding and decoding of whole texts from a public vocabulary file.

A word is encoded by a contiguous rank array: its parts stand side by side with
the merge ranks of neighbours; the least rank is found by a scan, its right part
deleted, and the two ranks beside it refreshed. Long words, where scans would
grow quadratic, keep the ranks in a heap instead and give the same parts.
Encoded words are cached per worker, within a bound.

The file's settings are those of its kind: NFC, white space to one space, lower
case, split into contractions, letter runs, single numerals and other runs, then
bytes with a word-end mark; a file with others is refused. Its special strings in
a text become their own ids.

Defined cases: a null text is an empty one, without tokens, and decodes to the
empty string; equal texts get equal ids; rows repeat as in the input; other
columns pass through ``encode`` unless they are called like its results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.common import texts, unlike

VOCABULARY = "word_bpe_49k.json"
#: Words of at most so many parts are scanned; longer ones use a heap.
SHORT = 200
NONE = 1 << 62
#: Bits of an id in a packed pair or rank; written out as 20 in the innermost loop.
_ID_BITS = 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The settings that encoding assumes, as the file writes them (fixed values).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def as_assumed(data: dict) -> bool:
    """Whether a vocabulary file's settings are those that this module encodes by."""
    model, empty = data["model"], ("dropout", "unk_token", "continuing_subword_prefix")
    added = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in data["added_tokens"])
    return (
        (data["normalizer"] or {}).get("normalizers") == NORMALIZERS
        and (data["pre_tokenizer"] or {}).get("pretokenizers") == PRE_TOKENIZERS
        and model["type"] == "BPE"
        and not any(model.get(k) for k in (*empty, "byte_fallback", "ignore_merges"))
        and data["post_processor"] is None
        and data["decoder"] is None
        and added
    )


#: Up to U+024F texts are in NFC and lower-case letter by letter, to letters up to U+02AF, but for U+0130, U+023A and U+023E.
_BEYOND_LATIN = re.compile("[^\\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]")
_LETTER, _NUMERAL = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_SPLIT = re.compile(f"[{_LETTER}]+|[{_NUMERAL}]|'(?:[stmd]|re|ve|ll)|[^{_LETTER}{_NUMERAL}\\t-\\r \x85\xa0]+").findall


def latin_parts(text: bytes) -> list[str] | None:
    """The parts that a Latin text without special strings is split in, lower-cased; of other texts None."""
    if b"<|" in text:
        return None
    string = text.decode("utf-8", "replace")
    if not string.isascii() and _BEYOND_LATIN.search(string):
        return None
    return _LATIN_SPLIT(string.lower())


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 letters themselves, the rest from U+0100 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else more))
        more += b not in printable
    return out


class _Bounded(dict):
    """A cache whose older half goes when it is full; ``make`` fills gaps."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids and decoded text of words and texts under one vocabulary file."""

    def __init__(self, path: str, cached: int = 250_000):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if not as_assumed(data):
            raise ValueError(f"{path} doesn't have the settings that are assumed here")
        vocab, model = data["model"]["vocab"], data["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << _ID_BITS | vocab[b]] = rank << _ID_BITS | vocab[a + b]
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self.library = path, None
        self.parts = _Bounded(self._part, cached)
        self.words = _Bounded(self._word, cached // 4)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word, given as bytes: the rank array."""
        if not data:
            return []
        inner, ranks, mask = self.inner, self.ranks, (1 << _ID_BITS) - 1
        ids = list(map(inner.__getitem__, data))
        ids[-1] = self.last[data[-1]]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get = ranks.get
        near = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while near:
            least = min(near)
            if least == NONE:
                break
            i = near.index(least)
            ids[i] = new = least & mask
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = get(ids[i - 1] << 20 | new, NONE)
            if i < len(near):
                near[i] = get(new << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, least rank and then leftmost first, from a heap over linked parts."""
        ranks, mask, n = self.ranks, (1 << _ID_BITS) - 1, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(ids[i] << _ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get(ids[i] << _ID_BITS | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = r & mask, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (q := ranks.get(ids[a] << _ID_BITS | ids[b])) is not None:
                    heapq.heappush(heap, (q, a))
        return [x for x in ids if x >= 0]

    def _part(self, part: str) -> tuple[bytes, bytes]:
        ids = self.merge(part.encode())
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode()

    def _split(self, text: str) -> list[str]:
        """The parts of a piece of text that are merged each by itself."""
        if text.isascii():
            text = text.lower()
            return [text] if text.isalpha() else self.split.findall(text)
        if any(unicodedata.category(c) == "Cn" for c in text):
            return self._split_newer(text)
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a final sigma is like any other
        return self.split.findall("".join(c.lower() for c in text))

    def _split_newer(self, text: str) -> list[str]:
        """The same of a text with code points newer than Python's tables, by the library's tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes_of = {c: b for b, c in enumerate(_byte_letters())}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, p)).decode() for p, _ in parts]

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded tokens, of what stands between ASCII white space."""
        text, got = word.decode("utf-8", "replace"), []
        for piece in self.at_special.split(text) if self.at_special and "<" in text else [text]:
            if piece in self.special:
                got.append((struct.pack("<I", self.special[piece]), piece.encode()))
            elif piece:
                got += [self.parts[p] for p in self._split(piece)]
        return got[0] if len(got) == 1 else (b"".join([i for i, _ in got]), b" ".join([d for _, d in got]))

    def _encoded(self, text: bytes) -> list[tuple[bytes, bytes]]:
        parts = latin_parts(text)
        if parts is None:
            words = self.words
            return [words[w] for w in text.split()]
        return list(map(self.parts.__getitem__, parts))

    def encode(self, text: bytes | None) -> bytes:
        """All ids of a text as little-endian 32-bit integers."""
        return b"".join([i for i, _ in self._encoded(text)]) if text else b""

    def encode_decode(self, text: bytes | None) -> tuple[bytes, bytes]:
        """The ids, and the text that they decode to."""
        if not text:
            return b"", b""
        got = self._encoded(text)
        return b"".join([i for i, _ in got]), b" ".join([d for i, d in got if i])

    def decode(self, ids) -> str:
        """The tokens of ids, parted by spaces; special ones are not skipped."""
        return " ".join([self.tokens[i] for i in ids])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns of ``keep``) with ids (binary, little-endian 32-bit integers) and n_tokens."""

    def make(batches):
        e = encoder(path)
        for b in batches:
            ids = [e.encode(t) for t in texts(b.column(b.schema.get_field_index(text)))]
            yield [ids, [len(i) // 4 for i in ids]]

    keep = unlike(docs.columns if keep is None else keep, ("ids", "n_tokens"))
    return arrow.append_columns(docs, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], make, keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with column decoded: the text of its ids."""

    def make(batches):
        e = encoder(path)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids)).to_pylist()
            yield [[e.decode(struct.unpack(f"<{len(i) // 4}I", i)) if i else "" for i in column]]

    return arrow.append_columns(encoded, [T.StructField("decoded", T.StringType())], make, unlike(encoded.columns, ["decoded"]))


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (SHA-256 of the ids, and of the text they decode to)."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(batches):
        e = encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for t in texts(b.column(b.schema.get_field_index(text))):
                ids, decoded = e.encode_decode(t)
                rows.append((len(ids) // 4, sha(ids), sha(decoded)))
            yield list(zip(*rows, strict=True)) if rows else [[], [], []]

    keep = unlike(docs.columns if keep is None else keep, [f.name for f in fields])
    return arrow.append_columns(docs, fields, make, keep)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, vocabulary_path(), keep=["doc_id"])
