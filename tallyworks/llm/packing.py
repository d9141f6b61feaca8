"""Best-fit packing by the sum-of-squares rule.

Texts become token ids, then pieces of at most ``capacity`` tokens. A piece goes
where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of open
sequences with g tokens left; ties go to the smaller gap. Pieces are dealt by a hash
into shards of about ``SHARD_PIECES`` (their place in the written table is hashed with
them, so that repeated rows spread) and each shard is packed by itself, largest
piece first, so no task sees more than a shard and a lost executor repeats one
shard. A shard leaves about one sequence half filled in over a thousand.

Tokenising works word by word: the tokenizer's pattern never crosses white space, so
the ids of a text are those of its white-space separated chunks in a row; a bounded
table keeps the ids of frequent chunks.

Defined results: null text is an empty one: the end id alone; a full piece fills a
sequence alone; repeated rows are packed as often as they occur; rows with a null
doc_id are packed too; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, utf8

CAPACITY, END_ID, SHARD_PIECES = 4096, 1, 8192
KEPT_CHUNKS = 500_000


#: A run of letters that ends in an ASCII one, then ASCII marks: the tokenizer always parts these two.
_WORD_AND_MARKS = re.compile(rb"([A-Za-z\x80-\xff]*[A-Za-z])([!-&(-/:-@\[-`{-~]+)")


class ChunkTokenizer(dict):
    """Little-endian uint32 ids by chunk; up to KEPT_CHUNKS chunks met before stay, others are worked out each time."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.met = bytearray(1 << 22)

    def __missing__(self, chunk: bytes) -> bytes:
        parts = _WORD_AND_MARKS.fullmatch(chunk)
        if parts and parts[1] in self:
            ids = self[parts[1]] + self[parts[2]]
        else:
            ids = array("I", self.tok.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        spot = hash(chunk) % len(self.met)
        if self.met[spot] and len(self) < KEPT_CHUNKS:
            self[chunk] = ids
        self.met[spot] = 1
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(b: dict) -> dict:
        out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end = np.array([END_ID], "<u4").tobytes()
        for d, ids in zip(b["doc_id"], tokenizer(path).encode(b["text"]), strict=True):
            raw = ids + end
            for k in range(0, len(raw), capacity * 4):
                part = raw[k : k + capacity * 4]
                for name, v in zip(out, (d, k // (capacity * 4), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(v)
        return out

    return map_rows(docs.select("doc_id", utf8().alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed largest first by the sum-of-squares rule."""
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; 0 and capacity stay 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in order.tolist():
        size = int(lengths[i])
        # change of the sum of squares when a bin of gap g takes the piece: N(g-s) grows, N(g) shrinks
        gaps = np.flatnonzero(count[size:]) + size
        best, gap = (2 * int(count[capacity - size]) + 1 if size < capacity else 0), capacity
        if len(gaps):
            change = np.where(gaps == size, 1 - 2 * count[gaps], 2 * (count[gaps - size] - count[gaps]) + 2)
            k = int(np.argmin(change))
            if change[k] <= best:
                gap = int(gaps[k])
        if gap == capacity:
            own, opened = opened, opened + 1
        else:
            own = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = own, capacity - gap
        if gap > size:
            stacks[gap - size].append(own)
            count[gap - size] += 1
    return bins, offsets


def pack(cut: DataFrame, n_pieces: int, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces. Sequence ids of a shard start at shard x 2^32."""
    shards = max(1, -(-n_pieces // shard_pieces))
    keyed = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    schema = "doc_id " + cut.schema["doc_id"].dataType.simpleString() + ", piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = pack_lengths(group.column("length").to_numpy(), capacity)
        shard = group.column("shard")[0].as_py()
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (shard << 32))).append_column("offset", pa.array(offsets))

    return keyed.groupBy("shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises once, to a table of small rows, then packs."""
    cut = materialize(pieces(docs, path, capacity))
    return pack(cut, cut.count(), capacity)
