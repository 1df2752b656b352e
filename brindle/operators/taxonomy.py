"""Category taxonomies: spans, longest matches, and constraint match levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def spans(paths: DataFrame) -> DataFrame:
    """(span, product_id): every contiguous part of a category path of rows (product_id, path)."""
    n = F.size("path")
    starts = paths.filter(n > 0).select("product_id", "path", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    each = starts.select("product_id", "path", "i", F.explode(F.sequence(F.lit(1), F.size("path") - F.col("i") + 1)).alias("k"))
    return each.select(F.array_join(F.slice("path", F.col("i"), F.col("k")), " ").alias("span"), "product_id").distinct()


def longest_match(span_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, span): the longest taxonomy span that stands in the query's tokens, ties by text.

    Only widths that some span has are looked up, so spans of any length match and a query of n tokens gives n rows a width.
    """
    known = span_rows.select("span").distinct().withColumn("width", F.size(F.split("span", " ")))
    widths = known.groupBy().agg(F.sort_array(F.collect_set("width")).alias("widths"))  # one row of different lengths
    n = F.size("tokens")
    asked = queries.filter(n > 0).crossJoin(F.broadcast(widths)).select("query_id", "tokens", F.explode("widths").alias("width")).filter(F.col("width") <= n)
    starts = asked.select("query_id", "tokens", "width", F.explode(F.sequence(F.lit(1), n - F.col("width") + 1)).alias("i"))
    parts = starts.select("query_id", "width", F.array_join(F.slice("tokens", F.col("i"), F.col("width")), " ").alias("span"))
    hit = parts.join(known, ["span", "width"], "left_semi")
    return hit.groupBy("query_id").agg(F.min(F.struct((-F.col("width")).alias("w"), "span")).alias("b")).select("query_id", "b.span")


def match_level(tokens: Column, affirmed: Column, body: Column, atoms: Column) -> Column:
    """4 an atomic value, 3 the phrase in affirmed text, 2 all tokens affirmed, 1 all in the body, 0 else."""
    phrase = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    inside = F.contains(F.concat(F.lit(" "), F.array_join(affirmed, " "), F.lit(" ")), phrase)
    return F.when(F.array_contains(atoms, F.array_join(tokens, " ")), 4).when(inside, 3).when(F.size(F.array_except(tokens, affirmed)) == 0, 2).when(F.size(F.array_except(tokens, body)) == 0, 1).otherwise(0)

