"""Catalog vocabularies, title neighbours and their contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def aliases(votes: DataFrame, *, least_support: int = 5, least_share: float = 0.80) -> DataFrame:
    """(attribute, alias, canonical, support, confidence, margin) of votes (attribute, alias, canonical).

    An alias goes to its commonest canonical value if that has the support and
    the share; margin is its lead over the runner-up in share.
    """
    counts = votes.groupBy("attribute", "alias", "canonical").agg(F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy("attribute", "alias").orderBy(F.desc("support"), "canonical")
    total = F.sum("support").over(Window.partitionBy("attribute", "alias"))
    ranked = counts.withColumn("i", F.row_number().over(w)).withColumn("next", F.lead("support", 1, 0).over(w)).withColumn("total", total)
    share = F.col("support") / F.col("total")
    return ranked.filter("i = 1").filter((F.col("support") >= least_support) & (share >= least_share)).select("attribute", "alias", "canonical", "support", F.round(share, 9).alias("confidence"), F.round((F.col("support") - F.col("next")) / F.col("total"), 9).alias("margin"))


def title_neighbors(tokens: DataFrame, *, rare: int = 6, most_df: int = 1000, posting_cap: int = 256, k: int = 8) -> DataFrame:
    """(doc_id, neighbor, similarity, rank): idf-weighted Jaccard over each title's rarest tokens that other titles share.

    tokens: distinct (doc_id, token).  Tokens of one document or of more than
    most_df are left out, and a token's posting keeps its posting_cap smallest
    ids: these limits are the operator's definition.
    """
    n = tokens.agg(F.countDistinct("doc_id").alias("n_docs"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") > 1) & (F.col("df") <= most_df))
    w = Window.partitionBy("doc_id").orderBy("df", "token")
    weighted = tokens.join(df, "token").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= rare).crossJoin(F.broadcast(n)).select("doc_id", "token", F.log(1 + F.col("n_docs") / F.col("df")).alias("idf"))
    cap = F.row_number().over(Window.partitionBy("token").orderBy("doc_id"))
    capped = weighted.withColumn("p", cap).filter(F.col("p") <= posting_cap).drop("p")
    sums = weighted.groupBy("doc_id").agg(F.sum("idf").alias("total"))
    shared = capped.alias("a").join(capped.alias("b"), "token").filter("a.doc_id <> b.doc_id").groupBy(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("neighbor")).agg(F.sum("a.idf").alias("shared"))
    both = shared.join(sums, "doc_id").join(sums.select(F.col("doc_id").alias("neighbor"), F.col("total").alias("other")), "neighbor")
    scored = both.select("doc_id", "neighbor", F.round(F.col("shared") / (F.col("total") + F.col("other") - F.col("shared")), 9).alias("similarity"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "neighbor")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def product_neighbors(titles: DataFrame, *, rare: int = 6, most_df: int = 1000, posting_cap: int = 256, k: int = 8) -> DataFrame:
    """(doc_id, neighbor, similarity, rank): idf-weighted Jaccard over all tokens of titles (doc_id, tokens).

    Every title asks with its rare rarest tokens that other titles share and at
    most most_df hold.  Only the candidates are capped: each of those tokens
    offers the posting_cap smallest ids of all titles that hold it.
    """
    n = titles.agg(F.count(F.lit(1)).alias("n_docs"))
    tokens = titles.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = tokens.join(df, "token").crossJoin(F.broadcast(n)).withColumn("idf", F.log1p(F.col("n_docs") / F.col("df")))
    whole = weighted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias("w"))
    whole = whole.withColumn("total", F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x["idf"]))
    tellers = weighted.filter((F.col("df") > 1) & (F.col("df") <= most_df))
    asks = tellers.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token"))).filter(F.col("i") <= rare).select("doc_id", "token")
    cap = F.row_number().over(Window.partitionBy("token").orderBy("doc_id"))
    pool = tellers.withColumn("p", cap).filter(F.col("p") <= posting_cap).select("token", F.col("doc_id").alias("neighbor"))
    pairs = asks.join(pool, "token").filter("doc_id <> neighbor").select("doc_id", "neighbor").distinct()
    other = whole.select(F.col("doc_id").alias("neighbor"), F.col("w.token").alias("held"), F.col("total").alias("other"))
    both = pairs.join(whole, "doc_id").join(other, "neighbor")
    shared = F.aggregate(F.filter("w", lambda x: F.array_contains(F.col("held"), x["token"])), F.lit(0.0), lambda acc, x: acc + x["idf"])
    scored = both.withColumn("shared", shared).select("doc_id", "neighbor", F.round(F.col("shared") / (F.col("total") + F.col("other") - F.col("shared")), 9).alias("similarity"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "neighbor")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def contrasts(neighbors: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, attribute, value, neighbors, support): a document's facts (doc_id, attribute, value) that fewer than half of its neighbours share."""
    count = neighbors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("neighbors"))
    own = facts.join(count, "doc_id")
    other = facts.select(F.col("doc_id").alias("neighbor"), "attribute", "value", F.lit(1).alias("has"))
    pairs = own.join(neighbors.select("doc_id", "neighbor"), "doc_id").join(other, ["neighbor", "attribute", "value"], "left")
    return pairs.groupBy("doc_id", "attribute", "value", "neighbors").agg(F.coalesce(F.sum("has"), F.lit(0)).alias("support")).filter(F.col("support") * 2 < F.col("neighbors"))


def suffix_paths(path: Column) -> Column:
    """Every suffix of a category path, longest first, joined by ' > '."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, i, F.size(path) - i + 1), " > "))).otherwise(F.array().cast("array<string>"))


def with_lane(found: DataFrame, *, least_share: float = 0.95, least_margin: float = 0.50) -> DataFrame:
    """aliases() with state: whether an alias is sure enough to change a session's state and not only its search."""
    return found.withColumn("state", (F.col("confidence") >= least_share) & (F.col("margin") >= least_margin))


def roles(names: DataFrame, patterns: dict[str, str], *, least_support: int = 5, other: str = "object") -> DataFrame:
    """(canonical, role, support) of taxonomy names (canonical), the role by the first pattern that a name holds."""
    role = F.lit(other)
    for name, pattern in reversed(patterns.items()):
        role = F.when(F.col("canonical").rlike(rf"\b(?:{pattern})\b"), F.lit(name)).otherwise(role)
    return names.groupBy("canonical").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least_support).withColumn("role", role)
