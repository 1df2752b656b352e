"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: at most ``open_bins`` bins are open at once.  A
bitset (one Python integer) has bit f set while some open bin has f tokens
free, so the tightest bin that still holds a piece is the lowest set bit at or
above its length.  When a bin more than allowed is needed, the fullest open
bin closes.

Each input partition packs its own stream.  Bins still open at the end of a
partition become items of a second pass of the same packer over a few
partitions joined together, and so on, so a job with many partitions ends with
few part-filled sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import integer_ids, materialize, tidied

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint{ids}>"
ROW = "tag bigint, used int, pieces array<{piece}>"


class BestFit:
    """The packer.  put() returns the closed bins as (used, pieces)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.n = 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n -= 1
        return got

    def put(self, length: int, pieces: list) -> list[tuple[int, list]]:
        closed = []
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            here = self._take(free)
            here += pieces
        else:
            free, here = self.capacity, pieces
            if self.n >= self.limit and length < self.capacity:  # a full piece needs no open bin
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed.append((self.capacity - fullest, self._take(fullest)))
        left = free - length
        if left == 0:
            closed.append((self.capacity, here))
        else:
            self.by_free[left].append(here)
            self.bits |= 1 << left
            self.n += 1
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return [(self.capacity - free, pieces) for free in range(1, self.capacity + 1) for pieces in self.by_free[free]]


def encoder(path: str):
    """text -> ids of a byte-level BPE tokenizer file, without special tokens.

    The vocabulary and merges are read from the tokenizers file; tiktoken's
    engine applies them, with equal ids and several times the speed.  The
    strings of special tokens are ordinary text.
    """
    import json

    import tiktoken
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    back.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    ranks = {bytes(back[c] for c in word): i for word, i in vocab.items() if all(c in back for c in word) and word != "<|endoftext|>"}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cut(n_ids: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): only longer documents are cut; the first piece takes the remainder."""
    first = n_ids % capacity or capacity
    at = piece = 0
    while at < n_ids:
        size = first if at == 0 else capacity
        yield piece, at, size
        at += size
        piece += 1


def _emit(rows: list[tuple[int, list]], first: int, still_open: bool, kind: pa.DataType) -> pa.RecordBatch:
    """tag: a number unique in the job while closed, -1 while open."""
    tags = [-1] * len(rows) if still_open else range(first, first + len(rows))
    return pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array([u for u, _ in rows], pa.int32()), pa.array([p for _, p in rows], kind)], ["tag", "used", "pieces"])


def _packed(items: Iterable[tuple[int, list]], capacity: int, open_bins: int, level: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    packer, out = BestFit(capacity, open_bins), []
    number = (level << 56) | (TaskContext.get().partitionId() << 36)
    for length, pieces in items:
        if length == capacity:
            out.append((capacity, pieces))
        else:
            out += packer.put(length, pieces)
        if len(out) >= 4096:
            yield _emit(out, number, False, kind)
            number += len(out)
            out = []
    yield _emit(out, number, False, kind)
    yield _emit(packer.rest(), 0, True, kind)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, open_bins: int = 4096, keep_ids: bool = True, fan_in: int = 16) -> DataFrame:
    """(sequence_id, used, pieces): one row per sequence of at most capacity tokens.

    pieces is an array of (doc_id, piece, start, length, ids_crc32[, ids]) in
    the order of their places; offsets are gapless from 0.  Every document
    ends with end_id, so null and empty texts are one token.  Ids must be integers; null ids are carried along.  Repeated rows
    are packed each; an empty table gives none; extra columns are ignored.
    keep_ids=False leaves the token ids out and keeps only their checksum.
    Memory of a task: open_bins part-filled sequences and one batch.
    """
    integer_ids(docs, id_col)
    shape = PIECE.format(ids=",ids:array<int>" if keep_ids else "")
    schema = ROW.format(piece=shape)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids
    kind = pa.list_(pa.struct(fields))

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)

        def items():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.array(encode(text or "") + [end_id], dtype="<u4")
                    for piece, start, size in cut(len(ids), capacity):
                        part = ids[start : start + size]
                        row = {"doc_id": doc_id, "piece": piece, "start": start, "length": size, "ids_crc32": zlib.crc32(part.tobytes())}
                        if keep_ids:
                            row["ids"] = part.astype(np.int32)
                        yield size, [row]

        yield from _packed(items(), capacity, open_bins, 0, kind)

    def next_level(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((used, pieces) for batch in batches for used, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            yield from _packed(rows, capacity, open_bins, level, kind)

        return run

    rows = materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidied(first_level), schema))
    done, parts, level = rows.filter("tag >= 0"), docs.rdd.getNumPartitions(), 0
    left = rows.filter("tag < 0")
    while parts > 1:
        parts, level = -(-parts // fan_in), level + 1
        merged = materialize(left.coalesce(parts).mapInArrow(next_level(level), schema))
        done, left = done.unionByName(merged.filter("tag >= 0")), merged.filter("tag < 0")
    last = left.withColumn("tag", F.lit(1 << 62) + F.monotonically_increasing_id())
    return done.unionByName(last).select(F.col("tag").alias("sequence_id"), "used", "pieces")


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece, with its place in its sequence."""
    flat = sequences.select("sequence_id", F.posexplode("pieces").alias("at", "p"), F.col("pieces.length").alias("lengths"))
    offset = F.aggregate(F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return flat.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", offset.alias("offset"))
