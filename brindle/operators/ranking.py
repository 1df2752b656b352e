"""Ranking: scores, tiers, guards and policies as column builders and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dealing import spread


def quality_prior(rating: Column, reviews: Column, weight: float = 1.05) -> Column:
    """0.02 * rating clipped to 0..5, and weight * ln(1 + reviews)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), rating)) * 0.02 + F.log1p(reviews) * weight


def review_prior(rating: Column, reviews: Column, mean: Column, *, pseudo: float = 20.0, saturation: float = 500_000.0) -> Column:
    """Stars shrunk towards the mean by pseudo reviews, times a saturating share of the log count."""
    stars = (rating * reviews + mean * pseudo) / (reviews + pseudo)
    return (stars - 1) / 4 * F.least(F.lit(1.0), F.log1p(reviews) / F.log1p(F.lit(saturation)))


def budget_allows(price: Column, mode: Column, amount: Column) -> Column:
    """Whether a price fits one limit; null when the price is unknown."""
    near = F.abs(price - amount) <= F.greatest(amount, F.lit(10.0)) * 0.35
    return (
        F.when(mode.isin("under", "below"), price < amount)
        .when(mode.isin("maximum", "max"), price <= amount)
        .when(mode == "over", price > amount)
        .when(mode == "minimum", price >= amount)
        .otherwise(near)
    )


def relative_violation(price: Column, mode: Column, amount: Column) -> Column:
    far = F.abs(price - amount) / F.greatest(amount, F.lit(10.0))
    return F.when(budget_allows(price, mode, amount), F.lit(0.0)).when(mode != "around", F.greatest(far, F.lit(0.001))).otherwise(F.greatest(F.lit(0.0), far - 0.35))


def price_score(price: Column, mode: Column, amount: Column, weight: Column) -> Column:
    soft = F.greatest(F.lit(0.0), 1 - F.abs(price - amount) / F.greatest(amount, F.lit(10.0)))
    hard = F.greatest(F.lit(0.0), 1 - relative_violation(price, mode, amount))
    return F.when(price.isNull(), F.lit(0.0)).otherwise(weight * 1.4 * F.when(mode == "around", soft).otherwise(hard))


def budgets_allow(pairs: DataFrame, *, hard_only: bool = False) -> DataFrame:
    """(query_id, doc_id, allowed) of rows (query_id, doc_id, price, grp, alt, mode, amount): all groups, any alternative, all members."""
    fits = budget_allows(F.col("price"), F.col("mode"), F.col("amount"))
    if hard_only:
        fits = fits | (F.col("mode") == "around")
    alt = pairs.groupBy("query_id", "doc_id", "grp", "alt").agg(F.bool_and(F.coalesce(fits, F.lit(True))).alias("ok"))
    group = alt.groupBy("query_id", "doc_id", "grp").agg(F.bool_or("ok").alias("ok"))
    return group.groupBy("query_id", "doc_id").agg(F.bool_and("ok").alias("allowed"))


def profile_alignment(rating: Column, prior: Column) -> Column:
    known = prior.between(1.0, 5.0) & (rating > 0) & (rating <= 5)
    return F.when(known, 1 - F.abs(rating - prior) / 4).otherwise(F.lit(0.0))


def tier_sort(rows: DataFrame, *, query: str = "query_id", doc: str = "doc_id", tiers: list[Column], k: int | None = None) -> DataFrame:
    """rows with rank by lexicographic tiers and then id."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*tiers, F.asc(doc))))
    return out if k is None else out.filter(F.col("rank") <= k)


def rerank_within_tiers(rows: DataFrame, *, query: str, tier: str, position: str, score: str, doc: str) -> DataFrame:
    """Documents trade places only with others of their tier: the i-th place of a tier goes to its i-th best score."""
    by_place, by_score = Window.partitionBy(query, tier).orderBy(position), Window.partitionBy(query, tier).orderBy(F.desc(score), F.asc(position))
    places = rows.select(query, tier, F.col(position).alias("new_position"), F.row_number().over(by_place).alias("i"))
    return rows.withColumn("i", F.row_number().over(by_score)).join(places, [query, tier, "i"]).drop("i")


def min_max(score: Column, query: str) -> Column:
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))


def linear_score(features: dict[str, Column], model: dict[str, tuple[float, float, float]], bias: float = 0.0) -> Column:
    """A standardised dot product; model: feature -> (mean, scale, coefficient)."""
    out = F.lit(float(bias))
    for name, (mean, scale, weight) in model.items():
        out = out + (features[name] - mean) / scale * weight
    return out


def logit_fusion(position: Column, logit_rank: Column, weight: float) -> Column:
    """(1-w) * 61/(61+i) + w * 61/(60+rank); position i from 0, ranks from 1."""
    return (1 - weight) * 61.0 / (61.0 + position) + weight * 61.0 / (60.0 + logit_rank)


def guard_shift(score: Column, violations: Column, query: str) -> Column:
    """Shift a violating candidate below every clean one, by the spread of the scores plus one for each violation."""
    w = Window.partitionBy(query)
    return score - violations * (F.max(score).over(w) - F.min(score).over(w) + 1)


def softmax(score: Column, query: str, temperature: float = 5.0) -> Column:
    w = Window.partitionBy(query)
    e = F.exp(F.greatest(F.lit(-700.0), (score - F.max(score).over(w)) / temperature))
    return e / F.sum(e).over(w)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, vec: str = "embedding", block: int = 4096, cells: int = 1 << 19) -> DataFrame:
    """(query_id, doc_id, score, rank) by dot product, ties by id; null vectors are left out.

    The stated query set meets all rows in blocks of about ``block`` queries, so
    what is broadcast at once is bounded.  A task multiplies a block by as many rows at a time as give about ``cells`` scores, holds its k best rows a query
    and passes them on at its end; the shuffle ranks those of all tasks.
    """
    spark = vectors.sparkSession
    wanted = queries.select("query_id", F.col(vec).alias("q")).filter("q IS NOT NULL")
    rows = spread(vectors.select("doc_id", F.col(vec).alias("v")), "doc_id", each=20_000).filter("v IS NOT NULL")
    kinds = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"
    blocks, out = -(-queries.count() // block) or 1, None
    for i in range(blocks):
        part = (wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow()  # about block rows
        held = spark.sparkContext.broadcast((part["query_id"], np.array(part["q"].to_pylist(), np.float64)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, matrix = held.value
            if not len(matrix):
                return
            step, least, kept = max(1, cells // len(matrix)), None, None  # least: what a row's score must reach for each query
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                every, ids = flat.reshape(batch.num_rows, -1), batch.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, batch.num_rows, step):
                    scores = every[at : at + step] @ matrix.T
                    if least is None:
                        some = len(scores) - k
                        first = np.partition(scores, some, axis=0)[some] - 2e-9 if some >= 0 else np.full(len(matrix), -np.inf)
                        least = np.where(np.isnan(first), -np.inf, first)
                    which, who = np.nonzero(scores >= least)
                    found = who, np.round(scores[which, who], 9), ids[at + which]
                    who, score, doc = found if kept is None else (np.concatenate(x) for x in zip(kept, found))
                    order = np.lexsort((doc, -score, who))
                    who, score, doc = who[order], score[order], doc[order]
                    place = np.arange(len(who)) - np.searchsorted(who, who, "left")
                    kept = who[place < k], score[place < k], doc[place < k]
                    full = place == k - 1
                    least[who[full]] = np.maximum(least[who[full]], score[full] - 2e-9)  # before rounding
            if kept is not None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(kept[0])).combine_chunks(), pa.array(kept[2]), pa.array(kept[1])], ["query_id", "doc_id", "score"])

        some = rows.mapInArrow(run, kinds)
        out = some if out is None else out.unionByName(some)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))  # over all blocks: a union of ranked ones does not keep their partitions
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
