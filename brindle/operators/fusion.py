"""Fusion of ranked routes (query_id, route, doc_id, rank, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _first_rank(routes: DataFrame) -> DataFrame:
    return routes.groupBy("query_id", "route", "doc_id").agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))


def reciprocal_rank(routes: DataFrame, k: float = 60.0, scale: float = 1.0) -> DataFrame:
    """Weighted reciprocal-rank fusion, with each route's part."""
    part = F.col("weight") * scale / (F.lit(k) + F.col("rank"))
    rows = _first_rank(routes).withColumn("part", part)
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "part")))).alias("parts"))


def family_max(routes: DataFrame, k: float = 40.0) -> DataFrame:
    """The best route of a family counts once; families add up, over the sum of their weights.  routes also has family."""
    best = routes.groupBy("query_id", "doc_id", "family").agg(F.max(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("part"))
    total = routes.groupBy("query_id", "family").agg(F.max("weight").alias("w")).groupBy("query_id").agg(F.sum("w").alias("w"))
    return best.groupBy("query_id", "doc_id").agg(F.sum("part").alias("s")).join(total, "query_id").select("query_id", "doc_id", F.round(F.col("s") / F.col("w"), 12).alias("score"))


def interleave(routes: DataFrame, budget: int = 192) -> DataFrame:
    """Round-robin over routes by (rank, route number), first occurrence kept, up to budget places.  routes also has route_no."""
    first = routes.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "route_no")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "doc_id")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= budget).select("query_id", "doc_id", "place", F.col("at.route_no").alias("route_no"))


def overlap(routes: DataFrame) -> DataFrame:
    """Jaccard of each pair of routes of a query."""
    sets = routes.groupBy("query_id", "route").agg(F.collect_set("doc_id").alias("docs"))
    a, b = sets.select("query_id", F.col("route").alias("route_a"), F.col("docs").alias("da")), sets.select("query_id", F.col("route").alias("route_b"), F.col("docs").alias("db"))
    both = a.join(b, "query_id").filter("route_a < route_b")
    return both.select("query_id", "route_a", "route_b", F.round(F.size(F.array_intersect("da", "db")) / F.size(F.array_union("da", "db")), 9).alias("jaccard"))
