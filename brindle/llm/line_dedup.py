"""Site-relative line deduplication, built from SQL functions only.

Pages are grouped by host.  For each line the number of the host's pages that
contain it is divided by the host's page total; lines above ``max_ratio`` (and
on at least ``min_pages`` pages) are boilerplate and leave every page of that
host.  Lines are compared trimmed of blanks; blank lines are never boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def _key(line: Column) -> Column:
    """Lines travel as 64-bit hashes.  A wrong drop needs a line to collide with one of its own host's few boilerplate lines."""
    return F.xxhash64(_trimmed(line))


def boilerplate_lines(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """(host, line_key, n_pages, host_pages) of the lines to drop.

    A host has at most (lines per page)/max_ratio of them.  Counts are partly
    summed before the shuffle, so a hot host or line costs one row a task.
    """
    p = pages.select(F.col(host_col).alias("host"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    seen = p.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line_key"))
    per_line = seen.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n_pages")).filter((F.col("n_pages") >= min_pages) & (F.col("line_key") != F.xxhash64(F.lit(""))))
    totals = p.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    return per_line.join(totals, F.col("host").eqNullSafe(F.col("of_host"))).filter(F.col("n_pages") > F.lit(max_ratio) * F.col("host_pages")).select("host", "line_key", "n_pages", "host_pages")


def line_dedup(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 5, broadcast_rows: int = 200_000, salts: int = 64) -> DataFrame:
    """pages with text_col cleaned, and columns n_lines and n_dropped.

    Null text stays null, with no lines; the empty text is one blank line that
    stays.  A null host is a site of its own.  Repeated pages count each.  A
    page whose every line goes gets the empty text.  Extra columns pass
    through; names that begin with __ld_ are reserved.

    Up to broadcast_rows boilerplate lines are broadcast as one list a host;
    beyond that the lists are joined by a shuffle that deals pages by host and
    salt, with each list repeated for every salt.
    """
    drops = materialize(boilerplate_lines(pages, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages))
    by_host = drops.groupBy(F.col("host").alias("__ld_host")).agg(F.collect_set("line_key").alias("__ld_drop"))
    same_host = F.col(host_col).eqNullSafe(F.col("__ld_host"))
    if drops.count() <= broadcast_rows:
        joined = pages.join(F.broadcast(by_host), same_host, "left")
    else:
        salted = pages.withColumn("__ld_salt", F.pmod(F.xxhash64(text_col), F.lit(salts)).cast("int"))
        spread = by_host.withColumn("__ld_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(spread, same_host & (F.col("__ld_salt") == F.col("__ld_copy")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col("__ld_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("__ld_drop", _key(x))))
    done = joined.withColumn("__ld_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("__ld_kept", kept)
    n_kept = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__ld_kept"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__ld_lines"))
    return done.select(*[F.array_join("__ld_kept", "\n").alias(c) if c == text_col else F.col(c) for c in pages.columns if c not in ("n_lines", "n_dropped")], n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))
