"""Guarded paging of shortlists and its behaviour summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def guarded_page(ranked: DataFrame, seen: DataFrame, base: int) -> DataFrame:
    """Per query the base's number of violating and clean places, each filled by unseen documents first, in rank order.

    ranked: (query_id, doc_id, rank, violation); seen: (query_id, doc_id).
    """
    known = ranked.join(seen.withColumn("seen", F.lit(True)), ["query_id", "doc_id"], "left").fillna(False, ["seen"])
    quota = ranked.filter(F.col("rank") <= base).groupBy("query_id", "violation").agg(F.count(F.lit(1)).alias("quota"))
    w = Window.partitionBy("query_id", "violation").orderBy("seen", "rank")
    page = known.withColumn("i", F.row_number().over(w)).join(quota, ["query_id", "violation"]).filter("i <= quota")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("violation", "i"))
    return page.select("query_id", "doc_id", "violation", "seen", place.alias("place"))


def repeats(slates: DataFrame) -> DataFrame:
    """(session_id, turns, repeated, longest) of rows (session_id, turn, slate): turns that show the slate before again, and the longest run of equal slates."""
    w = Window.partitionBy("session_id").orderBy("turn")
    marked = slates.withColumn("again", F.coalesce(F.lag("slate").over(w) == F.col("slate"), F.lit(False)).cast("int"))
    runs = marked.withColumn("run", F.sum(1 - F.col("again")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("size"), F.sum("again").alias("again"))
    return sizes.groupBy("session_id").agg(F.sum("size").alias("turns"), F.sum("again").alias("repeated"), F.max("size").alias("longest"))


def seen_before(shown: DataFrame) -> DataFrame:
    """Rows (session_id, turn, doc_id, reset) with seen: shown earlier since the session's last reset."""
    w = Window.partitionBy("session_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    epoch = shown.withColumn("epoch", F.sum(F.col("reset").cast("int")).over(w))
    first = F.min("turn").over(Window.partitionBy("session_id", "epoch", "doc_id"))
    return epoch.withColumn("seen", first < F.col("turn"))
