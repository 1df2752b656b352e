"""Connected components: union-find inside bounded blocks of edges, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges (a, b) as stars to the smallest node of their local components: at most one edge a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = [(x, find(x)) for x in list(parent)]
        stars = [s for s in stars if s[0] != s[1]]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, *, block: int = 400_000, most_rounds: int = 60) -> DataFrame:
    """(id, component): every node that an edge (a, b) links with another, with the smallest id it reaches.  Self-loops and repeated edges do no harm; no edges give no rows.

    Edges are first contracted in blocks of about ``block`` edges a task, which
    settles graphs of one block; larger ones go on in rounds, each written to the
    shared folder, of which the driver sees a count and a checksum.
    """
    known = materialize(edges.select("a", "b"))
    parts = -(-known.count() // block) or 1
    now = materialize(contract(known.coalesce(1) if parts == 1 else known.repartition(parts)))
    discard(known)
    state = None
    for _ in range(most_rounds if parts > 1 else 0):
        before, now = now, materialize(_round(now))
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
