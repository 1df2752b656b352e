"""Registered queries and their SQL twins, with shared SQL fragments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import FACETS, STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only in local sessions."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='brindle-')).rstrip('/')}/brindle-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: NOT list_contains([{STOPS}], t))"


def facet_sql(x: str, name: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '\\b({FACETS[name]})\\b', 1)))"


#: documents as tokens, counts, lengths, frequencies; benchmark items as queries of 48 different terms at most
DOC_CTES = f"""
    toks AS (SELECT doc_id, {terms_sql('text')} AS w FROM documents),
    tok AS (SELECT doc_id, unnest(w) AS token FROM toks),
    tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
    tot AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM dl),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    qt AS (SELECT item_id AS query_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT item_id, {terms_sql('text')} AS w FROM benchmark)),
    q AS (SELECT query_id, token FROM (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS r FROM qt GROUP BY 1, 2) WHERE r <= 48)"""

BM25_SCORE = "greatest(ln((n_docs - df + 0.5) / (df + 0.5)), CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN 0 ELSE 1e-6 END) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * n / avg_len))"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog: product_id, title, categories, store, price, rating, reviews (its line items)."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    n = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("reviews"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returns"))
    stars = 1 + 4 * (1 - F.coalesce(F.col("returns"), F.lit(0)) / F.greatest(F.coalesce(F.col("reviews"), F.lit(0)), F.lit(1)))
    return p.join(n, p["p_partkey"] == n["l_partkey"], "left").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("categories"), F.col("p_brand").alias("store"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), stars.alias("rating"), F.coalesce(F.col("reviews"), F.lit(0)).alias("reviews"))


CATALOG = """cat AS (
        SELECT p_partkey AS product_id, p_name AS title, p_type AS categories, p_brand AS store, p_size AS size, p_retailprice AS price,
               1 + 4 * (1 - coalesce(returns, 0)::DOUBLE / greatest(coalesce(reviews, 0), 1)) AS rating, coalesce(reviews, 0) AS reviews
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS reviews, count(*) FILTER (l_returnflag = 'R') AS returns FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as evaluation sessions: a returned line is a hit, its number the turn and its supplier's place the rank."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    hits = li.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_hit_turn"), F.min(F.pmod("l_suppkey", F.lit(10)) + 1).alias("best_rank"))
    j = o.join(hits, o["o_orderkey"] == hits["l_orderkey"], "left")
    return j.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("scenario_type"), F.col("first_hit_turn").isNotNull().alias("hit"), "first_hit_turn", "best_rank", F.coalesce(1 / F.col("best_rank"), F.lit(0.0)).alias("reciprocal_rank"))


OUTCOMES = """out AS (
        SELECT o_orderkey AS sample_id, o_orderpriority AS scenario_type, first_hit_turn IS NOT NULL AS hit, first_hit_turn, best_rank,
               coalesce(1.0::DOUBLE / best_rank, 0) AS reciprocal_rank
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS first_hit_turn, min(l_suppkey % 10 + 1) AS best_rank
                               FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey)"""
