"""Packing by power-of-two decomposition.

Every document's ids are cut into pieces whose lengths are powers of two:
full pieces of ``max_len`` first, then the binary digits of the rest from
large to small. Pieces of equal length form a bucket, and a batch is drawn
from one bucket, so each piece is a sequence by itself: no sequence
crosses documents and none needs padding. The decomposition looks at one
document alone, so the job is a single map over the input without any
shuffle, and a hot source or a group of copies changes nothing.

Tokenizing whole texts is the cost. Both the normaliser and the split of
the tokenizer drop white space, so the ids of a text are those of its
chunks between white space one after another; each worker keeps the ids of
the chunks and pieces it has seen in bounded tables and applies the
tokenizer to new ones only.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import small_batches

MAX_LEN = 4096
#: Id that ends every document (a parameter of the dealt contract).
END_ID = 2
#: str.split() also splits at these four, which are no white space to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
ASCII_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
#: Bounds of each of a worker's tables, in entries and in bytes; the one before is kept too.
KNOWN, KNOWN_BYTES = 500_000, 96 << 20
#: Longer chunks and pieces are not kept: they hardly recur.
LONGEST = 256
#: What an entry takes besides its characters and ids.
ENTRY = 150
#: The split of the tokenizer's pattern, and the same on the characters below.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Chunks of these alone need no normalising but lower case: visible ASCII and Latin letters.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Known(dict):
    """A bounded table: when it is full, it becomes the table before, whose
    entries are taken over as they recur, so frequent entries stay."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.find(key)
        out = self.before.get(key)
        if out is None:
            out = self.find(key)
        if len(self) >= KNOWN or self.bytes >= KNOWN_BYTES:
            self.before, self.bytes = dict(self), 0
            self.clear()
        self[key] = out
        self.bytes += ENTRY + (len(key) if key.isascii() else 4 * len(key)) + len(out)
        return out


class PieceIds(Known):
    """lower-case piece -> its ids, by the tokenizer's merges alone."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        # the letter of each byte in a byte-level vocabulary: itself if visible, else 256, 257, ... in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def find(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode("utf-8")])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])


class ChunkIds(Known):
    """chunk between white space -> its ids as little-endian uint32 bytes, filled on demand.

    Chunks of plain characters are cut into pieces here and looked up by
    piece; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.pieces = PieceIds(self.tokenizer.model) if split == PATTERN else None

    def find(self, chunk: str) -> bytes:
        if self.pieces is not None and PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.special):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk.lower())))
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def of(self, text: str) -> bytes:
        chunks = text.split() if not SEPARATORS.search(text) else [c for c in ASCII_SPACE.split(text) if c]
        return b"".join(map(self.__getitem__, chunks))


_TABLES: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The worker's table for one tokenizer file."""
    if path not in _TABLES:
        _TABLES[path] = ChunkIds(path)
    return _TABLES[path]


def binary_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of ``n`` ids, in order; ``max_len`` is a power of two."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False,
         tokenizer: str | None = None) -> DataFrame:
    """One row per piece of ``docs`` (needs doc_id, text): doc_id, start,
    length, ids_crc32, doc_tokens, bucket (log2 of the length),
    sequence_id, offset, and the ids themselves ``with_ids``.

    Every piece is a sequence of its own: sequence_id is unique, offset 0.
    A document's ids end with ``end_id``, so every document has a piece.

    Defined cases: a null text counts as empty (one piece of length 1); a
    null doc_id is kept; rows repeated with the same id are packed each by
    itself; very long texts give as many full pieces as needed; an empty
    table gives an empty result; extra columns are ignored whatever their
    names.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    tail = end_id.to_bytes(4, "little")
    fields = [docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
              T.StructField("bucket", T.IntegerType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches):
        import numpy as np
        table = chunk_ids(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at: list[int] = []
            rows: tuple[list, ...] = ([], [], [], [], [])
            blobs: list[bytes] = []
            for i in range(len(texts)):
                text = texts[i].as_py()
                data = (table.of(text) if text else b"") + tail
                n, view, pos = len(data) // 4, memoryview(data), 0
                for size in binary_lengths(n, max_len):
                    part = view[4 * pos:4 * (pos + size)]
                    at.append(i)
                    for col, v in zip(rows, (pos, size, zlib.crc32(part), n, size.bit_length() - 1), strict=True):
                        col.append(v)
                    if with_ids:
                        blobs.append(part)
                    pos += size
            cols = [ids.take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in rows[:4]],
                    pa.array(rows[4], pa.int32())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(b, "<i4") for b in blobs], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    pieces = docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()) \
        .withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces (``with_ids``) as one folder a bucket: equal lengths together."""
    pieces.write.partitionBy("bucket").parquet(path)
