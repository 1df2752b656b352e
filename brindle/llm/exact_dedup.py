"""Exact deduplication with a heavy-hitter split.

Digests of the normalised texts are written once.  Misra-Gries summaries of
every partition are merged in a tree to a fixed number of candidates; a second
pass counts the candidates exactly and finds the row that stays (the verified
winners).  The winners number at most ``capacity`` and are broadcast, so copies
in hot groups are settled map-side; all other digests are grouped by an
ordinary shuffle, in which no key can hold more than rows/capacity rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, integer_ids, materialize


def _fold(counts: Counter, capacity: int) -> Counter:
    """Cut a counter to capacity entries by the Misra-Gries rule for merged summaries."""
    if len(counts) <= capacity:
        return counts
    cut = sorted(counts.values(), reverse=True)[capacity]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def misra_gries(digests: DataFrame, capacity: int) -> DataFrame:
    """(digest, seen): at most capacity rows, holding every digest with more than rows/(capacity+1) rows."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            block = pa.table({"d": batch.column(0), "n": batch.column(1)}).group_by("d").aggregate([("n", "sum")])
            for d, n in zip(block.column("d").to_pylist(), block.column("n_sum").to_pylist()):
                counts[d] += n
            counts = _fold(counts, capacity)
        if counts:
            yield pa.RecordBatch.from_pydict({"digest": list(counts), "seen": pa.array(list(counts.values()), pa.int64())})

    out = digests.select("digest", F.lit(1).cast("long").alias("seen")).mapInArrow(summary, "digest string, seen long")
    parts = digests.rdd.getNumPartitions()
    while parts > 1:  # a tree of fan-in 64: no task merges more than 64 summaries
        parts = -(-parts // 64)
        out = out.coalesce(parts).mapInArrow(summary, "digest string, seen long")
    return out


def settle(rows: DataFrame, aggs: list[Column], *, capacity: int = 256) -> DataFrame:
    """rows (with a column digest, already cheap to read twice) and the aggregates of each row's digest group.

    Digests of more than rows/(capacity+1) rows are found by Misra-Gries,
    verified by an exact count, and joined map-side; the others by a shuffle.
    """
    spark = rows.sparkSession
    found = [r["digest"] for r in misra_gries(rows, capacity).select("digest").collect()]  # capacity rows at most
    candidates = spark.createDataFrame([(d,) for d in found], "digest string")
    groups = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*aggs, F.count(F.lit(1)).alias("__n"))
    floor = rows.count() / (capacity + 1)
    verified = groups.filter(F.col("__n") > F.lit(floor)).drop("__n")
    known = spark.createDataFrame([tuple(r) for r in verified.collect()], verified.schema)
    hot = rows.join(F.broadcast(known), "digest")
    rest = rows.join(F.broadcast(known.select("digest")), "digest", "left_anti")
    return hot.unionByName(rest.join(rest.groupBy("digest").agg(*aggs), "digest"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 256) -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  Of equal texts the row with the largest id stays; rows that repeat that id stay with it.  Null ids
    come last: such a row stays only in a group of nothing else, whose keep_id is null, and there one does.  kept is never
    null.  Ids must be integers.  An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    integer_ids(docs, id_col)
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digests = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("bare")))
    done = settle(digests, [F.max("id").alias("keep_id"), F.min("bare").alias("stays"), F.count(F.lit(1)).alias("group_size")], capacity=capacity)
    kept = F.when(F.col("keep_id").isNull(), F.col("bare") == F.col("stays")).otherwise(F.col("id").eqNullSafe(F.col("keep_id")))
    return done.select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", kept.alias("kept"))
