"""Turns as rows: changes of a session's facts, receipts, retries, and how far a turn's budget reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fact_changes(facts: DataFrame) -> DataFrame:
    """(session_id, turn, added, removed, kept, kind) of the facts that stood after each turn: rows (session_id, turn, facts array of attribute=value).

    kind: none, addition, removal, replacement (an attribute got another value) or category_change.
    """
    before = F.coalesce(F.lag("facts").over(Window.partitionBy("session_id").orderBy("turn")), F.array().cast("array<string>"))
    d = facts.withColumn("before", before).select("session_id", "turn", F.array_sort(F.array_except("facts", "before")).alias("added"), F.array_sort(F.array_except("before", "facts")).alias("removed"), F.array_sort(F.array_intersect("facts", "before")).alias("kept"))
    name = lambda c: F.transform(c, lambda x: F.substring_index(x, "=", 1))
    both = F.array_intersect(name("added"), name("removed"))
    kind = F.when(F.array_contains(both, "category"), "category_change").when(F.size(both) > 0, "replacement").when(F.size("added") > 0, "addition").when(F.size("removed") > 0, "removal").otherwise("none")
    return d.withColumn("kind", kind)


def typed(evidence: DataFrame) -> DataFrame:
    """Raw evidence rows (session_id, ordinal, text, attribute, source, retired) as typed preferences; retired rows stay, inactive."""
    hard = F.col("source").isin("hard_constraint", "override", "exclusion")
    return evidence.select("session_id", "ordinal", F.coalesce("attribute", F.lit("other")).alias("attribute"), F.lower("text").alias("value"), hard.alias("hard"), F.when(F.col("source") == "exclusion", -1).otherwise(1).alias("polarity"), (~F.col("retired")).alias("active"))


def request_key(session: Column, turn: Column, message: Column, top_k: Column, runtime: Column) -> Column:
    """A digest of all that decides a turn's answer; another runtime (configuration or model) makes another key."""
    return F.sha2(F.to_json(F.struct(session.alias("session"), turn.alias("turn"), F.coalesce(message, F.lit("")).alias("message"), top_k.alias("top_k"), runtime.alias("runtime"))), 256)


def answered(requests: DataFrame) -> DataFrame:
    """requests (session_id, turn, message, top_k, runtime, seq) with outcome: computed, cached (an exact retry of the session's last turn) or rejected (an older or changed turn)."""
    w = Window.partitionBy("session_id").orderBy("seq")
    key = request_key(F.col("session_id"), F.col("turn"), F.col("message"), F.col("top_k"), F.col("runtime"))
    keyed = requests.withColumn("key", key).withColumn("latest", F.max("turn").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("session_id", "key").orderBy("seq")))
    out = F.when(F.col("latest").isNull() | (F.col("turn") > F.col("latest")), "computed").when((F.col("nth") > 1) & (F.col("turn") == F.col("latest")), "cached").otherwise("rejected")
    return first.withColumn("outcome", out).drop("latest", "nth")


def receipts(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, receipt, top, n_evidence, unmet): what a turn rested on.  ranked: (query_id, doc_id, rank, tokens); evidence: (query_id, text, tokens)."""
    top = ranked.filter("rank <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("top"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("seen"))
    e = evidence.join(top.select("query_id", "seen"), "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_list(F.when(F.size(F.array_except("tokens", "seen")) > 0, F.col("text")))).alias("unmet"))
    return top.join(e, "query_id").select("query_id", F.sha2(F.array_join("top", ","), 256).alias("receipt"), "top", "n_evidence", "unmet")


def affordable(limit: int, budget: Column, elapsed: Column, cost: Column) -> Column:
    """How many candidates the rest of a turn's seconds can pay for; all without a budget or a known cost, none when it is spent."""
    left = budget - elapsed
    return F.when((budget <= 0) | cost.isNull() | (cost <= 0), F.lit(limit)).when(left <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(limit), F.floor((left + 1e-9) / cost).cast("int"))))


def running_cost(measured: DataFrame) -> DataFrame:
    """Rows (session_id, turn, seconds, candidates) with cost: the running mean that halves the weight of all that is older.

    64 rows decide it: what is older weighs less than the last bit of a double.
    """
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-63, 0)
    each = F.col("seconds") / F.col("candidates")
    rows = measured.filter("candidates >= 1 AND seconds >= 0").withColumn("__all", F.collect_list(each).over(w))
    return rows.withColumn("cost", F.aggregate(F.slice("__all", 2, 63), F.col("__all")[0], lambda a, x: (a + x) / 2)).drop("__all")


def frontier(ranked: DataFrame, scored: DataFrame, step: int) -> DataFrame:
    """(query_id, doc_id): the next step candidates that have no logit yet, in rank order."""
    left = ranked.join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return left.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("i") <= step).select("query_id", "doc_id")
