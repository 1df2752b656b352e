"""Which candidates a costly re-ranker sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def stratified(ranked: DataFrame, n: int, keep: int) -> DataFrame:
    """The first keep ranks of each query and evenly spaced ranks of the rest, n in all."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    rest = n - keep
    rows = ranked.withColumn("total", total).withColumn("span", F.greatest(F.col("total") - keep, F.lit(0)))
    slot = F.floor((F.col("rank") - keep - 1) * rest / F.greatest(F.col("span"), F.lit(1)))
    before = F.floor((F.col("rank") - keep - 2) * rest / F.greatest(F.col("span"), F.lit(1)))
    chosen = (F.col("rank") <= keep) | (F.col("span") <= rest) | (slot != before) | (F.col("rank") == keep + 1)
    return rows.filter(chosen).filter(F.col("rank") <= F.col("total")).drop("total", "span")


def greedy_cover(ranked: DataFrame, k: int, pool: int = 120) -> DataFrame:
    """(query_id, doc_id, place): repeatedly the candidate that adds most unseen facts, ties by rank; a query's pool of ``pool`` ranks is the operator's definition.

    ranked: (query_id, doc_id, rank, facts array); a document stands once in a query's pool.
    """

    row = F.struct(F.col("rank").cast("int").alias("rank"), "doc_id", "facts")
    pools = ranked.filter(F.col("rank") <= pool).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("pool"))  # pool rows at most
    doc = ranked.schema["doc_id"].dataType.simpleString()
    none = F.struct(F.array_distinct(F.flatten(F.transform(F.slice("pool", 1, 0), lambda c: c["facts"]))).alias("seen"), F.array().cast(f"array<{doc}>").alias("out"))

    def step(state, _):
        left = F.filter("pool", lambda c: ~F.array_contains(state["out"], c["doc_id"]))
        best = F.array_max(F.transform(left, lambda c: F.struct(F.size(F.array_except(c["facts"], state["seen"])).alias("new"), (-c["rank"]).alias("r"), c["doc_id"].alias("doc_id"), c["facts"].alias("facts"))))
        return F.when(F.size(left) == 0, state).otherwise(F.transform(F.array(best), lambda b: F.struct(F.array_union(state["seen"], b["facts"]).alias("seen"), F.concat(state["out"], F.array(b["doc_id"])).alias("out")))[0])

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), none, step, lambda state: state["out"])
    placed = pools.select("query_id", F.posexplode(chosen).alias("place", "doc_id"))
    return placed.select("query_id", "doc_id", (F.col("place") + 1).alias("place"))


def score_break(scored: DataFrame, share: float = 0.70, least: int = 3) -> DataFrame:
    """(query_id, boundary): the first place, at least ``least``, after which the score falls by share of the whole spread; null if none."""
    w = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id")
    gaps = scored.withColumn("gap", F.col("score") - F.lead("score").over(w)).withColumn("spread", F.max("score").over(whole) - F.min("score").over(whole))
    hit = (F.col("rank") >= least) & (F.col("spread") > 0) & (F.col("gap") >= share * F.col("spread"))
    return gaps.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("boundary"))


def retrieval_action(n_hard: Column, n_terms: Column, has_category: Column) -> Column:
    """retrieve, minimal_probe or clarify_first by what the customer has told."""
    return F.when((n_hard > 0) | (has_category & (n_terms >= 2)), "retrieve").when(has_category | (n_terms > 0), "minimal_probe").otherwise("clarify_first")
