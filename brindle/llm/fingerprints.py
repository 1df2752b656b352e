"""Document fingerprints by one-permutation MinHash.

Every distinct 5-word shingle is hashed once; the hash's high bits name its bin and each bin keeps its least hash.  An empty
bin borrows from a full one by optimal densification: it tries bins drawn by its own hash sequence, the same
for all documents, until one is full.  Of each bin the low-order bits, scrambled with the bin's number, are stored, packed.  Two fingerprints
agree in a bin by chance with probability 2^-bits, which the likeness takes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, placed, text_runs
from .ngram_join import Shingler

_NONE = np.uint64(2**64 - 1)
_BARE = mix64(np.array([0x6272696E646C65], np.uint64))  # the shingle of a text without words


class OnePermutation:
    """Sets of 64-bit hashes -> rows of ``bins`` numbers of ``bits`` bits; bins is a power of two, bits divides eight."""

    def __init__(self, bins: int = 512, bits: int = 4):
        if bins & (bins - 1) or bins * bits % 8 or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two and bits 1, 2, 4 or 8, whole bytes together")
        self.bins, self.bits = bins, bits
        self.high = np.uint64(64 - (bins.bit_length() - 1))

    def least(self, sets: list[np.ndarray]) -> np.ndarray:
        """Least hash of each bin, a row for each set; empty bins hold the greatest number."""
        out = np.full(len(sets) * self.bins, _NONE)
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * self.bins
        if self.bins > 1:
            at = at + (h >> self.high).astype(np.int64)
        np.minimum.at(out, at, h)
        return out.reshape(-1, self.bins)

    def densify(self, rows: np.ndarray) -> np.ndarray:
        """Rows, each with a full bin at least, without empty bins."""
        out = rows.copy()
        own = np.arange(self.bins, dtype=np.uint64)
        row, bin_ = np.nonzero(rows == _NONE)
        one = (rows != _NONE).sum(axis=1) == 1  # every sequence ends at the only full bin
        out[one] = rows[one].min(axis=1)[:, None]
        left = ~one[row]
        row, bin_, attempt = row[left], bin_[left], 1
        while len(row):
            drawn = (mix64(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(self.bins)).astype(np.int64)
            got = rows[row, drawn[bin_]]
            full = got != _NONE
            out[row[full], bin_[full]] = got[full]
            row, bin_, attempt = row[~full], bin_[~full], attempt + 1
        return out

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Low-order bits of the densified bins, each scrambled with its bin's number; a set without members counts as one of a member that no text has.

        Without scrambling, two small sets whose few members agree in their low bits by chance would agree in every bin that borrows from these.
        """
        rows = self.densify(self.least([s if len(s) else _BARE for s in sets]))
        rows = mix64(rows + np.arange(self.bins, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return (rows & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, rows: np.ndarray) -> list[str]:
        """Hexadecimal, the first bin in the highest bits."""
        bits = np.unpackbits(rows[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [x.tobytes().hex() for x in np.packbits(bits.reshape(len(rows), -1), axis=1)]

    def unpack(self, packed: list[str]) -> np.ndarray:
        raw = np.frombuffer(bytes.fromhex("".join(packed)), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(raw, axis=1).reshape(len(packed), self.bins, self.bits)
        return np.packbits(np.concatenate([np.zeros((*bits.shape[:2], 8 - self.bits), np.uint8), bits], axis=2), axis=2)[:, :, 0]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity, row by row, 0 to 1."""
        chance = 0.5**self.bits
        return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bins: int = 512, bits: int = 4) -> DataFrame:
    """(id, fingerprint) for every row of docs, where it is read.

    A-Z are lower-cased; words are what lies between ASCII blanks; a text of fewer than width words is one shingle.  Null, empty
    and blank texts share a fingerprint of their own; equal texts have equal fingerprints.  Ids may be of any
    type, null too; repeated rows are kept; an empty table gives no rows; extra columns are ignored.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sketch = Shingler(width), OnePermutation(bins, bits)
        for part in text_runs(batches, 1, 1_000_000, 512):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sketch.pack(sketch(shingle.raw(part.column(1).to_pylist()))), pa.string())], [id_col, "fingerprint"])

    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str, *, per_part: int = 16) -> tuple[DataFrame, bool]:
    """(bucket, guest, doc, id, text), and whether doc differs from the id: runs of rows in the order of doc, each closed by a copy of the row that follows it.

    Runs begin at the first row and wherever a hash of the number falls low, about per_part runs for each shuffle partition; only
    their first numbers are collected and broadcast.  After the last row comes the first.  Each partition is sorted by (bucket, guest, doc).
    """
    spark = docs.sparkSession
    numbered, moved = placed(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = numbered.agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low")).first()
    share = max(1, sums["n"] // (parts * per_part))
    begins = (F.pmod(F.xxhash64("doc"), F.lit(share)) == 0) | (F.col("doc") == F.lit(sums["low"]))
    heads = spark.sparkContext.broadcast(np.sort(numbered.filter(begins).select("doc").toArrow().column(0).to_numpy()))
    n = max(1, len(heads.value))

    @F.pandas_udf("bigint")
    def bucket(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(heads.value, doc.to_numpy(), "right") - 1)

    own = numbered.withColumn("own", bucket("doc"))
    places = F.when(begins, F.array(F.col("own"), F.pmod(F.col("own") - 1, F.lit(n)))).otherwise(F.array("own"))
    dealt = own.select(F.posexplode(places).alias("guest", "bucket"), "doc", "id", "text").repartition(parts, "bucket")
    return dealt.sortWithinPartitions("bucket", "guest", "doc").select("bucket", "guest", "doc", "id", "text"), moved


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bins: int = 512, bits: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    edited is the text whose last floor(n_chars / 2) code points gave way to as many of the next document's first, or to all
    if it has fewer; the next document is that of the next greater id, after the last the first, so a single document is its own next.
    near_edited and near_next are the likeness of the document's fingerprint to that of the edited text, of the next document.

    Ids must be integers.  Null counts as empty.  Of repeated ids each row counts, behind one another by a hash of their
    texts; null ids come last.  An empty table gives no rows; extra columns are ignored.
    Texts are shuffled once; a task holds two texts beside a batch of about 1 MB.
    """
    dealt, _ = with_next(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sketch = Shingler(width), OnePermutation(bins, bits)
        bucket, guest, ids, texts, prints = [], [], [], [], np.zeros((0, bins), np.uint8)
        for part in text_runs(batches, 4, 1_000_000, 512):
            new = [t or "" for t in part.column(4).to_pylist()]
            bucket, guest, ids, texts = (old + more for old, more in zip((bucket, guest, ids, texts), (part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), new)))
            prints = np.concatenate([prints, sketch(shingle.raw(new))])
            done = [k for k in range(len(ids) - 1) if not guest[k]]
            follows = [k + 1 for k in done]
            if any(bucket[k] != bucket[k + 1] for k in done):
                raise RuntimeError("a run of documents is not closed by the one that follows")
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in done]
            changed = sketch(shingle.raw(edited)) if done else prints[:0]
            own = prints[done]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in done], pa.int64()), pa.array([len(texts[k]) for k in done], pa.int64()), pa.array(edited, pa.string()), pa.array(sketch.pack(own), pa.string()), pa.array(sketch.pack(changed), pa.string()), pa.array(sketch.likeness(own, changed), pa.float64()), pa.array(sketch.likeness(own, prints[follows]), pa.float64())],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            bucket, guest, ids, texts, prints = bucket[-1:], guest[-1:], ids[-1:], texts[-1:], prints[-1:]

    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
