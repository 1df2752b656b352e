"""The default backend's candidate scoring and tiers, for batches of queries.

Products and compiled evidence meet in one row (query, product) with the
query's evidence as an array, so all scores are column expressions over both:
no row is expanded and no Python runs.  Unknown facts are null and decide
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parsing import budgets
from ..functions.text import FACETS, affirmed, denied, facet, has_sequence, terms
from .phrases import in_one_block
from .ranking import budget_allows, price_score, quality_prior, relative_violation

# Weights of the fields in re-ranking, and the buying policy.
FIELD_WEIGHTS = {"title": 4.0, "categories": 3.0, "features": 2.8, "details": 2.8, "store": 1.5, "description": 1.3}
BUYING = {"hard_coverage": 0.30, "hard_exact": 0.30, "hard_missing": 0.25, "soft_coverage": 0.0, "soft_exact": 0.0, "contradiction": 0.50, "budget": 0.50, "rating": 0.75}
BROWSING = {k: 0.0 for k in BUYING}
HARD = ("hard_constraint", "override")


def product_features(flat: DataFrame) -> DataFrame:
    """product_id, sequences (terms by field), affirmed, denied, weights (best field weight by term), body, facets, category, price, rating, reviews."""
    fields = list(FIELD_WEIGHTS)
    sequences = F.array(*[terms(f) for f in fields])
    weights = F.aggregate(
        F.array(*[F.struct(terms(f).alias("t"), F.lit(w).alias("w")) for f, w in sorted(FIELD_WEIGHTS.items(), key=lambda x: -x[1])]),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")),
        lambda m, x: F.map_concat(m, _weigh(F.array_except(x["t"], F.map_keys(m)), x["w"])),
    )
    denials = F.flatten(F.array(*[denied(f) for f in fields]))
    return flat.select("product_id", sequences.alias("sequences"), F.array(*[terms(affirmed(f)) for f in fields]).alias("affirmed"), denials.alias("denied"), weights.alias("weights"), F.array_join(F.flatten(sequences), " ").alias("body"), F.map_from_arrays(F.array(*[F.lit(f) for f in FACETS]), F.array(*[facet(F.concat_ws(" ", *fields), f) for f in FACETS])).alias("facets"), terms("categories").alias("category"), "price", "rating", "reviews")


def _weigh(tokens: Column, weight: Column) -> Column:
    return F.map_from_arrays(F.array_distinct(tokens), F.transform(F.array_distinct(tokens), lambda _: weight))


def compile_evidence(evidence: DataFrame) -> DataFrame:
    """(query_id, evidence, limits) of rows (query_id, text, source, weight).

    evidence: array of (tokens, phrase, source, weight, facets), facets by name; limits: array of (grp, branch, mode, amount, weight), the
    prices that texts state.  A text that states a price is a limit and no words.
    """
    facets = F.map_from_arrays(F.array(*[F.lit(f) for f in FACETS]), F.array(*[facet("text", f) for f in FACETS]))
    e = evidence.select("query_id", "text", "source", "weight", terms("text").alias("tokens"), facets.alias("facets"), budgets("text").alias("budgets"))
    e = e.filter((F.size("tokens") > 0) | (F.size("budgets") > 0))
    item = F.when(F.size("budgets") == 0, F.struct("tokens", F.array_join("tokens", " ").alias("phrase"), "source", "weight", "facets"))
    own = F.xxhash64("text")
    several = F.exists("budgets", lambda x: x["branch"] > 0)  # alternatives are one requirement, other prices each their own
    limit = F.transform("budgets", lambda x, i: F.struct(F.when(several, own).otherwise(own + i + 1).alias("grp"), x["branch"].alias("branch"), x["mode"].alias("mode"), x["amount"].alias("amount"), F.col("weight").alias("weight")))
    return e.groupBy("query_id").agg(F.collect_list(item).alias("evidence"), F.flatten(F.collect_list(limit)).alias("limits"))


def price_closeness() -> Column:
    """Sum over limits of 1.4 * weight * closeness of the price; 0 when it is unknown."""
    return F.aggregate("limits", F.lit(0.0), lambda a, x: a + price_score(F.col("price"), x["mode"], x["amount"], x["weight"]))


def _by_group(value) -> Column:
    """For each requirement on the price, value of the rows of each of its branches, as an array of arrays."""
    groups = F.array_distinct(F.transform("limits", lambda x: x["grp"]))

    def branches(g):
        own = F.filter("limits", lambda x: x["grp"] == g)
        return F.transform(F.array_distinct(F.transform(own, lambda x: x["branch"])), lambda b: value(F.filter(own, lambda x: x["branch"] == b)))

    return F.transform(groups, branches)


def budget_penalty(scale: float) -> Column:
    """What broken limits cost: of every requirement the branch that costs least, at most twice its weight a limit."""
    cost = _by_group(lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["weight"] * scale * F.least(relative_violation(F.col("price"), x["mode"], x["amount"]), F.lit(2.0))))
    return F.when(F.col("price").isNull(), 0.0).otherwise(-F.aggregate(F.transform(cost, lambda c: F.array_min(c)), F.lit(0.0), lambda a, x: a + x))


def breaks_budget() -> Column:
    """Whether a known price breaks a requirement in all its branches; targets are soft and never do."""
    fits = _by_group(lambda rows: F.forall(rows, lambda x: (x["mode"] == "around") | budget_allows(F.col("price"), x["mode"], x["amount"])))
    return F.col("price").isNotNull() & F.exists(fits, lambda branches: ~F.exists(branches, lambda ok: ok))


def _coverage(e: Column) -> Column:
    return F.size(F.filter(e["tokens"], lambda t: F.map_contains_key("weights", t))) / F.size(e["tokens"])


def _exact(e: Column) -> Column:
    return (F.size(e["tokens"]) >= 2) & F.contains(F.col("body"), e["phrase"])


def _clashes(e: Column, name: str) -> Column:
    """Whether a product states values of a facet, and none of those that the evidence names."""
    wanted, stated = F.try_element_at(e["facets"], F.lit(name)), F.try_element_at("facets", F.lit(name))
    return (F.size(wanted) > 0) & (F.size(stated) > 0) & ~F.arrays_overlap(wanted, stated)


def _excluded(e: Column) -> Column:
    return has_sequence(F.col("affirmed"), e["tokens"])


def constraint_score() -> Column:
    """Sum over evidence of weight * (1.9 coverage + 0.4 affinity), with phrase and completeness bonuses; matching exclusions subtract."""
    best = max(FIELD_WEIGHTS.values())

    def one(acc, e):
        n = F.size(e["tokens"])
        affinity = F.aggregate(e["tokens"], F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at("weights", t), F.lit(0.0))) / (n * best)
        cover = _coverage(e)
        s = e["weight"] * (1.9 * cover + 0.4 * affinity) + F.when(_exact(e), e["weight"] * F.least(F.lit(2.0), 0.55 + 0.22 * n)).otherwise(0.0) + F.when(cover >= 0.999, 0.45 * e["weight"]).otherwise(0.0)
        return acc + F.when(e["source"] != "exclusion", s).when(_excluded(e), -s).otherwise(0.0)

    return F.aggregate("evidence", F.lit(0.0), one)


def fit_adjustment(policy: dict[str, float]) -> Column:
    """Policy bonuses for covered must-haves, and penalties for missing ones and for excluded values."""

    def one(acc, e):
        cover, exact = _coverage(e), _exact(e).cast("double")
        soft = policy["soft_coverage"] * cover + policy["soft_exact"] * exact
        hard = policy["hard_coverage"] * cover - policy["hard_missing"] * (1 - cover) + policy["hard_exact"] * exact
        clashes = sum((_clashes(e, f).cast("int") for f in FACETS), F.lit(0))
        hard = hard - policy["contradiction"] * clashes
        s = F.when(e["source"].isin(*HARD), hard).when(e["source"] == "exclusion", F.when(_excluded(e), -soft).otherwise(0.0)).otherwise(soft)
        return acc + F.when(e["source"] == "category", 0.0).otherwise(e["weight"] * s)

    return F.aggregate("evidence", F.lit(0.0), one)


def _is_hard(e: Column) -> Column:
    return e["source"].isin(*HARD)


def tiers() -> dict[str, Column]:
    """The order above the score: category fit, violations, exact must-haves."""
    wanted = F.filter("evidence", lambda e: e["source"] == "category")
    asked = F.array_distinct(F.flatten(F.transform(wanted, lambda e: e["tokens"])))
    missing = F.size(F.array_except(asked, "category"))
    status = F.when((F.size(asked) == 0) | (F.size("category") == 0), 0).when(missing == 0, 1).otherwise(-1)
    violation = F.exists("evidence", lambda e: ((e["source"] == "exclusion") & _excluded(e)) | (_is_hard(e) & has_sequence(F.col("denied"), e["tokens"]) & ~_excluded(e)))
    violation = violation | breaks_budget()
    hard = F.filter("evidence", _is_hard)
    exact = F.size(F.filter(hard, lambda e: has_sequence(F.col("sequences"), e["tokens"]) & ~has_sequence(F.col("denied"), e["tokens"])))
    n = F.size(asked)
    leaf = (n > 0) & (F.slice(F.col("category"), F.greatest(F.lit(1), F.size("category") - n + 1), n) == asked)
    return {"category_status": status, "violation": violation, "all_hard": (F.size(hard) > 0) & (exact == F.size(hard)), "hard_exact": exact, "leaf": leaf, "in_block": in_one_block(F.col("evidence"), F.col("body"))}


def rank(candidates: DataFrame, products: DataFrame, evidence: DataFrame, *, policy: dict[str, float] = BUYING, rating_prior: float | None = None, k: int = 10) -> DataFrame:
    """(query_id, product_id, score, tiers ..., rank) of candidates (query_id, product_id, rrf[, exact_index, field_score, coherence, leaf_words]).

    Known-incompatible categories leave.  The order: category fit, violations, membership in the exact-constraint index, all
    must-haves exact, their number, leaf, one block, field score, coherence, leaf words, score, id; what candidates do not bring is equal for all.
    """
    given = {"exact_index": F.lit(False), "field_score": F.lit(0.0), "coherence": F.lit(0.0), "leaf_words": F.lit(0)}
    for name, default in given.items():
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, default)
    rows = candidates.join(products, "product_id").join(compile_evidence(evidence), "query_id")
    align = F.lit(0.0) if rating_prior is None else F.coalesce(F.when((F.col("rating") > 0) & (F.col("rating") <= 5), 1 - F.abs(F.col("rating") - rating_prior) / 4), F.lit(0.0))
    score = 85.0 * F.col("rrf") + constraint_score() + price_closeness() + quality_prior(F.coalesce("rating", F.lit(0.0)), F.coalesce("reviews", F.lit(0))) + fit_adjustment(policy) + budget_penalty(policy["budget"]) + policy["rating"] * align
    scored = rows.select("query_id", "product_id", F.round(score, 9).alias("score"), *given, *[c.alias(n) for n, c in tiers().items()]).filter("category_status >= 0")
    order = [F.desc("category_status"), F.asc("violation"), F.desc("exact_index"), F.desc("all_hard"), F.desc("hard_exact"), F.desc("leaf"), F.desc("in_block"), F.desc("field_score"), F.desc("coherence"), F.desc("leaf_words"), F.desc("score"), F.asc("product_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
