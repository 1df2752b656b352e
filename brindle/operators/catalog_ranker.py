"""Linear rankers over fields: the features of a candidate against a query, as columns, for re-ordering inside tiers and for admission.

items: array of (tokens, source, facets) with facets as a map from name to values; sequences: the affirmed terms of a product's fields, in FIELDS order.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions.text import FACETS, facet, has_sequence
from .evidence import held

FIELDS = ("title", "categories", "features", "details", "store", "description")
TOKEN_FIELDS = ("title", "features", "details", "description")
# The features of the catalog ranker, in the order of its weights.
FEATURES = (*[f"{f}_token_coverage" for f in TOKEN_FIELDS], *[f"{f}_phrase_support" for f in TOKEN_FIELDS], "whole_field_support", "best_field_coverage", "cross_field_coverage", "missing_information", "facet_contradiction", "exclusion_match", "category_coverage")
ADMISSION = ("bm25_normalized", "rank_reciprocal", "route_agreement", "title_coverage", "category_coverage", "feature_coverage", "detail_coverage", "description_coverage", "all_field_coverage", "object_agreement", "positive_coverage", "negative_compatibility", "hard_compatibility", "metadata_completeness", "price_compatibility")


def share(wanted: Column, there: Column) -> Column:
    """Share of different wanted tokens that stand there; 0 for none wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.array_distinct(wanted), there)) / F.size(F.array_distinct(wanted))).otherwise(0.0)


def field_features(items: Column, sequences: Column, category: Column, category_tokens: Column) -> Column:
    """struct of FEATURES: means over positive items, the share of exclusions that a product holds, and how much of the category fits."""
    told = F.filter(items, lambda e: ~e["source"].isin("category", "exclusion") & (F.size(e["tokens"]) > 0))
    barred = F.filter(items, lambda e: (e["source"] == "exclusion") & (F.size(e["tokens"]) > 0))
    every = F.array_distinct(F.flatten(sequences))
    text = F.array_join(F.transform(sequences, lambda s: F.array_join(s, " ")), " ; ")

    def of(told):
        n = F.greatest(F.size(told), F.lit(1))
        mean = lambda f: F.aggregate(told, F.lit(0.0), lambda a, e: a + f(e).cast("double")) / n
        at = {name: sequences[FIELDS.index(name)] for name in TOKEN_FIELDS}
        clash = lambda e: F.greatest(*[((F.size(F.try_element_at(e["facets"], F.lit(x))) > 0) & (F.size(facet(text, x)) > 0) & ~F.arrays_overlap(F.try_element_at(e["facets"], F.lit(x)), facet(text, x))).cast("int") for x in FACETS])
        out = [mean(lambda e, s=s: share(e["tokens"], s)).alias(f"{n_}_token_coverage") for n_, s in at.items()]
        out += [mean(lambda e, s=s: has_sequence(F.array(s), e["tokens"])).alias(f"{n_}_phrase_support") for n_, s in at.items()]
        out += [
            mean(lambda e: F.exists(sequences, lambda s: s == e["tokens"])).alias("whole_field_support"),
            mean(lambda e: F.array_max(F.transform(sequences, lambda s: share(e["tokens"], s)))).alias("best_field_coverage"),
            mean(lambda e: share(e["tokens"], every)).alias("cross_field_coverage"),
            mean(lambda e: 1 - share(e["tokens"], every)).alias("missing_information"),
            mean(lambda e: F.coalesce(clash(e), F.lit(0))).alias("facet_contradiction"),
            (F.size(F.filter(barred, lambda e: F.size(F.array_except(e["tokens"], every)) == 0)) / F.greatest(F.size(barred), F.lit(1))).alias("exclusion_match"),
            share(category, category_tokens).alias("category_coverage"),
        ]
        return F.struct(*out)

    return held(told, of)


def score(features: str, weights: dict[str, float]) -> Column:
    """The weighted sum of named features of a struct column; weights beyond 8 are refused."""
    if set(weights) - set(FEATURES) or any(abs(w) > 8 for w in weights.values()):
        raise ValueError("unknown feature or weight out of range")
    return sum((F.col(f"{features}.{n}") * float(w) for n, w in weights.items()), F.lit(0.0))


def admission_features(terms: Column, fields: dict[str, Column], *, routes: Column, positive: Column, negative: Column, hard: Column, price_fit: Column, agreement: Column, price: Column) -> list[Column]:
    """The fifteen ADMISSION features of rows (query_id, rank, score); fields: token arrays by name; the mean evidences and the object agreement (-1, 0, 1) come in."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    every = F.array_distinct(F.concat(*fields.values()))
    filled = sum(((F.size(c) > 0).cast("int") for c in fields.values()), F.lit(0)) + price.isNotNull().cast("int")
    values = [
        F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0), 1 / F.col("rank"), F.least(F.lit(1.0), routes / 3),
        *[share(terms, fields[n]) for n in ("title", "categories", "features", "details", "description")], share(terms, every), agreement, positive, negative, hard, filled / 7, price_fit,
    ]
    return [F.round(v.cast("double"), 9).alias(n) for n, v in zip(ADMISSION, values)]
