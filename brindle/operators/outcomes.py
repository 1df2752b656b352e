"""What an answer would change: expected rank value of every question over a bounded pool, and how long a slate stays right whatever the answer.

A pool is at most MAX_POOL candidates a query, a question at most MAX_ANSWERS answers, so their products stay small however many queries there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Bounds of a model, the shares of no preference and of targets outside the pool, and the weights of a gain in rank and of a recovery.
MAX_POOL, MAX_ANSWERS = 40, 4
OUTSIDE_POOL, NO_PREFERENCE = 0.20, 0.15
ANSWERED = 1.0 - OUTSIDE_POOL - NO_PREFERENCE
RANK_GAIN, RECOVERY_GAIN = 0.30, 0.50
# A decisive gap in scores, and how much of the answers must be modelled before a slate is cut at it.
LEAST_PLACES, GAP_SHARE, MODELLED_SHARE = 3, 0.70, 0.50


def weighed(pool: DataFrame) -> DataFrame:
    """pool (query_id, rank, doc_id, score, ...) cut to MAX_POOL, with weight: falling with the square root of the rank, summing to 1 a query."""
    kept = pool.filter(F.col("rank") <= MAX_POOL).withColumn("raw", 1 / F.sqrt("rank"))
    return kept.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("query_id"))).drop("raw")


def answers(pool: DataFrame, facets: DataFrame, reference: int) -> DataFrame:
    """(query_id, attribute, answer, mass, residual, unknown, modelled): the answers worth modelling, those first that could recover what the reference slate does not show.

    facets: (doc_id, attribute, answer), several rows for a document with several values.  unknown is the weight of candidates without a value, modelled that of all kept answers.
    """
    known = weighed(pool).join(facets, "doc_id")
    share = known.withColumn("part", F.col("weight") / F.count(F.lit(1)).over(Window.partitionBy("query_id", "attribute", "doc_id")))
    mass = share.groupBy("query_id", "attribute", "answer").agg(F.sum("part").alias("mass"), F.sum(F.when(F.col("rank") > reference, F.col("part")).otherwise(0.0)).alias("residual"))
    order = Window.partitionBy("query_id", "attribute").orderBy(F.desc(F.round("residual", 12)), F.desc(F.round("mass", 12)), "answer")
    every = Window.partitionBy("query_id", "attribute")
    top = mass.withColumn("known", F.sum("mass").over(every)).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= MAX_ANSWERS)
    return top.select("query_id", "attribute", "answer", "mass", "residual", (1 - F.col("known")).alias("unknown"), F.sum("mass").over(every).alias("modelled"))


def reranked(pool: DataFrame, facets: DataFrame, told: DataFrame, gain: Column | float) -> DataFrame:
    """(query_id, attribute, answer, doc_id, rank, weight, part, place): the pool as each answer would order it: what has the answer gains, what has only others loses as much."""
    own = facets.groupBy("doc_id", "attribute").agg(F.collect_set("answer").alias("own"))
    pairs = told.select("query_id", "attribute", "answer").join(weighed(pool), "query_id").join(own, ["doc_id", "attribute"], "left")
    holds = F.coalesce(F.array_contains("own", F.col("answer")), F.lit(False))
    sign = F.when(holds, 1.0).when(F.col("own").isNotNull(), -1.0).otherwise(0.0)
    order = Window.partitionBy("query_id", "attribute", "answer").orderBy(F.desc(F.round(F.col("score") + sign * gain, 9)), "rank")
    return pairs.withColumn("place", F.row_number().over(order)).select("query_id", "attribute", "answer", "doc_id", "rank", "weight", F.when(holds, F.col("weight") / F.size("own")).otherwise(0.0).alias("part"), "place")


def models(pool: DataFrame, facets: DataFrame, *, reference: int = 10, gain: Column | float = 0.4) -> DataFrame:
    """(query_id, attribute, rank_gain, recovery_gain, value, modelled, unmodelled, stable) of asking each attribute.

    A candidate behind the reference slate that an answer would bring into it counts with its share of the answer's weight, over its
    new place for the gain in rank.  Other answers, no preference and targets outside the pool change nothing.  stable lists the lengths from 3
    on, below the reference's, at which the slate holds the same candidates whatever is answered.
    """
    told = answers(pool, facets, reference)
    moved = reranked(pool, facets, told, gain)
    won = (F.col("rank") > reference) & (F.col("place") <= reference)
    each = moved.groupBy("query_id", "attribute").agg(F.sum(F.when(won, F.lit(ANSWERED) * F.col("part") / F.col("place")).otherwise(0.0)).alias("rank_gain"), F.sum(F.when(won, F.lit(ANSWERED) * F.col("part")).otherwise(0.0)).alias("recovery_gain"))
    reach = F.max("place").over(Window.partitionBy("query_id", "attribute", "answer").orderBy("rank"))
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id", "attribute", "answer"))
    kept = moved.withColumn("reach", reach).withColumn("size", size).filter((F.col("rank") >= LEAST_PLACES) & (F.col("rank") < F.least(F.lit(reference), F.col("size"))))
    lengths = kept.groupBy("query_id", "attribute", "rank").agg(F.bool_and(F.col("reach") == F.col("rank")).alias("same")).filter("same").groupBy("query_id", "attribute").agg(F.array_sort(F.collect_list("rank")).alias("stable"))
    shares = told.groupBy("query_id", "attribute").agg(F.first("unknown").alias("unknown"), F.first("modelled").alias("modelled"))
    joined = each.join(shares, ["query_id", "attribute"]).join(lengths, ["query_id", "attribute"], "left")
    unmodelled = F.greatest(F.lit(0.0), 1 - F.col("unknown") - F.col("modelled"))
    return joined.select(
        "query_id", "attribute", "rank_gain", "recovery_gain", (RANK_GAIN * F.col("rank_gain") + RECOVERY_GAIN * F.col("recovery_gain")).alias("value"), (ANSWERED * F.col("modelled")).alias("modelled"), (ANSWERED * unmodelled).alias("unmodelled"),
        F.coalesce("stable", F.array().cast("array<int>")).alias("stable"),
    )


def gap_length(pool: DataFrame, size: int) -> DataFrame:
    """(query_id, gap): the first length from 3 on at which the scores of the first size candidates fall by 70 % of their spread."""
    shown = pool.filter(F.col("rank") <= size)
    w = Window.partitionBy("query_id")
    falls = shown.withColumn("spread", F.max("score").over(w) - F.min("score").over(w)).withColumn("drop", F.col("score") - F.lead("score").over(w.orderBy("rank"))).withColumn("n", F.count(F.lit(1)).over(w))
    return falls.filter((F.col("n") >= 4) & (F.col("rank") >= LEAST_PLACES) & (F.col("spread") > 0) & (F.col("drop") >= GAP_SHARE * F.col("spread"))).groupBy("query_id").agg(F.min("rank").alias("gap"))


def decided(pool: DataFrame, facets: DataFrame, *, reference: int = 10, gain: Column | float = 0.4, turn_cost: float = 0.0) -> DataFrame:
    """(query_id, attribute, value, size): the question of the greatest value, null unless it is worth more than the turn's cost, and how much of the slate to show with it.

    The slate is cut at a decisive gap only where it is stable there for every modelled answer of that question, at least half of the answers are modelled and none is left out.
    """
    m = models(pool, facets, reference=reference, gain=gain)
    best = m.groupBy("query_id").agg(F.max_by(F.struct("attribute", "value", "modelled", "unmodelled", "stable"), F.struct(F.round("value", 12), F.col("attribute"))).alias("b"))
    n = pool.groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(reference)).alias("full"))
    rows = n.join(best, "query_id", "left").join(gap_length(pool, reference), "query_id", "left")
    worth = F.col("b.value") > turn_cost + 1e-12
    sure = worth & F.array_contains("b.stable", F.col("gap")) & (F.col("b.modelled") >= MODELLED_SHARE) & (F.col("b.unmodelled") <= 1e-12)
    return rows.select("query_id", F.when(worth, F.col("b.attribute")).alias("attribute"), F.coalesce("b.value", F.lit(0.0)).alias("value"), F.when(F.coalesce(sure, F.lit(False)), F.col("gap")).otherwise(F.col("full")).cast("int").alias("size"))
