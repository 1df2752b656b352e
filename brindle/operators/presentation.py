"""What of a ranking is shown: pages, deferrals, presentation policies and re-ranked prefixes, for many sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def page_numbers(turns: DataFrame, *, first_turn: int = 2, limit: int = 10, by_head: bool = True) -> DataFrame:
    """turns (session_id, turn, ids, reset) with page: one further for each turn in a row that ranks as the turn before did, back to 0 at any change or reset.

    by_head compares the sets of the first limit ids, else whole rankings.  Pages end with the ranking.
    """
    w = Window.partitionBy("session_id").orderBy("turn")
    now = F.array_sort(F.slice("ids", 1, limit)) if by_head else F.col("ids")
    marked = turns.withColumn("__now", now)
    same = F.coalesce((F.lag("__now").over(w) == F.col("__now")) & ~F.col("reset"), F.lit(False))
    runs = marked.withColumn("__run", F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = F.sum((F.col("turn") >= first_turn).cast("int")).over(Window.partitionBy("session_id", "__run").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - F.max(F.when(F.col("__first"), (F.col("turn") >= first_turn).cast("int"))).over(Window.partitionBy("session_id", "__run"))
    begun = runs.withColumn("__first", F.row_number().over(Window.partitionBy("session_id", "__run").orderBy("turn")) == 1)
    last = F.greatest(F.lit(0), F.floor((F.size("ids") - 1) / limit).cast("int"))
    return begun.withColumn("page", F.least(F.greatest(steps, F.lit(0)), last).cast("int")).drop("__now", "__run", "__first")


def unseen_first(ids: Column, seen: Column, page: Column, limit: int) -> Column:
    """The slate of a page: the head on page 0, else the best unseen ids, filled from the page's own place and then from the top."""
    fresh = F.filter(ids, lambda i: ~F.array_contains(seen, i))
    own = F.slice(ids, page * limit + 1, F.lit(limit))
    filled = F.array_distinct(F.concat(F.slice(fresh, 1, limit), own, ids))
    return F.when(page == 0, F.slice(ids, 1, limit)).otherwise(F.slice(filled, 1, limit))


def after_rejection(ids: Column, shown: Column, rejected: Column, changed: Column, limit: int) -> Column:
    """struct(slate, reason): past exactly the slate that was rejected while nothing else changed; from the top otherwise."""
    head = F.slice(ids, 1, limit)
    on = rejected & ~changed & (F.size(shown) > 0)
    past = F.slice(F.filter(ids, lambda i: ~F.array_contains(shown, i)), 1, limit)
    return F.struct(F.when(on, past).otherwise(head).alias("slate"), F.when(changed, "active_fact_change").when(on, "explicit_rejection").otherwise("no_explicit_rejection").alias("reason"))


def siblings(ranked: DataFrame, *, least: float = 0.5) -> DataFrame:
    """(query_id, deferred, tentative): whether the two best are alike in all tie-break signals and weak in the first, so that a question comes before an arbitrary order; tentative shows the best alone if it violates nothing.

    ranked: (query_id, rank, field_score, coherence, leaf, hard_exact, violation).
    """
    signals = F.struct("field_score", "coherence", "leaf", "hard_exact")
    at = lambda n, c: F.max(F.when(F.col("rank") == n, c))
    two = ranked.filter("rank <= 2").groupBy("query_id").agg(at(1, signals).alias("a"), at(2, signals).alias("b"), at(1, F.col("violation").cast("int")).alias("v"))
    alike = F.coalesce((F.col("a") == F.col("b")) & (F.col("a.field_score") < least), F.lit(False))
    return two.select("query_id", alike.alias("deferred"), (alike & (F.col("v") == 0)).alias("tentative"))


def presented(ranked: DataFrame, policy: str, *, k: int = 10) -> DataFrame:
    """(query_id, doc_id, place) under a policy: raw10 the first k; tentative_top1 the first alone where it violates nothing; explicit_rejection clean before violating, not rejected before rejected.

    ranked: (query_id, doc_id, rank, violation, rejected).
    """
    keys = {"raw10": [F.col("rank")], "tentative_top1": [F.col("rank")], "explicit_rejection": [F.col("violation"), F.col("rejected"), F.col("rank")]}[policy]
    out = ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)))
    if policy == "tentative_top1":
        out = out.filter((F.col("place") == 1) & ~F.col("violation"))
    return out.filter(F.col("place") <= k).select("query_id", "doc_id", "place")


def rerank_prefix(ranked: DataFrame, *, first: int = 30, tier: list[Column], logit: str = "logit") -> DataFrame:
    """ranked with new_rank: the first places re-ordered by tier, then logit, then rank; the rest and the membership stay."""
    w = Window.partitionBy("query_id").orderBy((F.col("rank") > first), *[F.when(F.col("rank") <= first, t) for t in tier], F.desc(F.when(F.col("rank") <= first, F.col(logit))), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w))


def apply_deltas(ranked: DataFrame, deltas: DataFrame) -> DataFrame:
    """ranked (query_id, doc_id, score, rank) moved by deltas (query_id, doc_id, delta), candidates without one staying; ties keep their order."""
    moved = ranked.join(deltas, ["query_id", "doc_id"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("delta", F.lit(0.0)), 9)).drop("delta")
    return moved.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def same_members(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, lost, gained): candidates that only one of two rankings has; no row where they hold the same."""
    keys = ["query_id", "doc_id"]
    j = a.select(*keys, F.lit(1).alias("a")).join(b.select(*keys, F.lit(1).alias("b")), keys, "full")
    return j.filter("a IS NULL OR b IS NULL").groupBy("query_id").agg(F.count("a").alias("lost"), F.count("b").alias("gained"))


def with_tail(ranked: DataFrame, catalog: DataFrame, least: int) -> DataFrame:
    """(query_id, doc_id, place): rankings of fewer than least candidates, filled up from the catalog's first ids."""
    n = ranked.groupBy("query_id").agg(F.max("rank").alias("n")).filter(F.col("n") < least)
    heads = F.broadcast(catalog.select("doc_id").distinct().orderBy("doc_id").limit(2 * least))
    tail = n.select("query_id").join(heads).join(ranked, ["query_id", "doc_id"], "left_anti").withColumn("rank", F.lit(1 << 30))
    every = ranked.select("query_id", "doc_id", "rank").unionByName(tail)
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    return placed.filter((F.col("rank") < (1 << 30)) | (F.col("place") <= least)).select("query_id", "doc_id", "place")


def hard_negatives(pairs: DataFrame, k: int = 4) -> DataFrame:
    """The k most misleading wrong candidates of each query: other role, then title overlap, then missing details, then id.  pairs: (query_id, doc_id, role_confusion, title_overlap, missing)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("role_confusion"), F.desc("title_overlap"), F.desc("missing"), "doc_id")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
