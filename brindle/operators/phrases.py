"""Phrases of evidence against catalog fields: search expressions, alternatives, tie-breaks and rare-phrase admission.

Evidence is an array of structs (tokens, weight, turn, source, grp); fields are an array of token arrays, so everything but rarity is a column expression of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import has_sequence
from .evidence import held

# Bounds of the rare-phrase route and its score.
MOST_DOCS, MOST_SHARE, MOST_ADMITTED, BONUS = 64, 0.01, 32, 0.08


def chunks(evidence: DataFrame, *, k: int = 4, most: int = 14) -> DataFrame:
    """(query_id, phrases): the k strongest chunks of a query as phrases of at most ``most`` terms; more different terms, then weight, then the later turn first."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.size(F.array_distinct("tokens"))), F.desc("weight"), F.desc("turn"), F.array_join("tokens", " "))
    top = evidence.filter(F.size("tokens") > 0).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k)
    phrase = F.array_join(F.slice("tokens", 1, most), " ")
    return top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", phrase.alias("p")))), lambda x: x["p"]).alias("phrases"))


def resolved(evidence: Column, fields: Column) -> Column:
    """Evidence with one branch of each group of alternatives (rows of one grp): the one that a product supports best, by phrase, then covered share, then order."""
    every = F.array_distinct(F.flatten(fields))

    def support(e):
        cover = F.size(F.array_intersect(F.array_distinct(e["tokens"]), every)) / F.greatest(F.size(F.array_distinct(e["tokens"])), F.lit(1))
        return F.struct(has_sequence(fields, e["tokens"]).cast("int").alias("phrase"), cover.alias("cover"))

    groups = F.array_distinct(F.transform(evidence, lambda e: e["grp"]))

    def best(g):
        own = F.filter(evidence, lambda e: e["grp"] == g)
        ranked = F.transform(own, lambda e, i: F.struct(support(e).alias("s"), (-i).alias("i"), e.alias("e")))
        return F.array_max(ranked)["e"]

    return F.transform(groups, best)


def active_chunks(evidence: Column) -> Column:
    """The different token lists that count: no categories or exclusions, and none that another one holds whole."""
    told = F.filter(evidence, lambda e: ~e["source"].isin("category", "exclusion") & (F.size(e["tokens"]) > 0))
    lists = F.array_distinct(F.transform(told, lambda e: e["tokens"]))
    every = F.transform(F.filter(evidence, lambda e: F.size(e["tokens"]) > 0), lambda e: e["tokens"])
    return F.filter(lists, lambda c: ~F.exists(every, lambda o: (F.size(o) > F.size(c)) & has_sequence(F.array(o), c)))


def in_one_block(evidence: Column, body: Column) -> Column:
    """Whether two or more chunks stand in a product's text one right after the other, in the order told."""

    def joined(c):
        text = F.array_join(F.flatten(c), " ")
        return (F.size(c) >= 2) & (F.size(F.flatten(c)) >= 3) & F.contains(body, text)

    return held(active_chunks(evidence), joined)


def tie_break(evidence: Column, fields: Column, features: Column, rarity: Column, category: Column, requested: Column) -> Column:
    """struct(field_score, coherence, leaf): rarity-weighted chunks that stand in a field, the share of chunks that stand in the features, and how many last words of the category fit.

    rarity: map from token to ln(1 + candidates / candidates that hold it).
    """

    def scored(c):
        mean = lambda t: F.aggregate(F.array_distinct(t), F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(rarity, x), F.lit(0.0))) / F.size(F.array_distinct(t))
        field = F.aggregate(c, F.lit(0.0), lambda a, t: a + F.when(has_sequence(fields, t), mean(t) * (1 + F.least(F.size(t), F.lit(8)) / 8)).otherwise(0.0))
        coherent = F.when(F.size(c) > 0, F.size(F.filter(c, lambda t: has_sequence(F.array(features), t))) / F.size(c)).otherwise(0.0)
        fits = F.transform(F.sequence(F.lit(1), F.greatest(F.size(requested), F.lit(1))), lambda n: (F.size(requested) >= n) & (F.size(category) >= n) & (F.slice(category, F.greatest(F.size(category) - n + 1, F.lit(1)), n) == F.slice(requested, F.greatest(F.size(requested) - n + 1, F.lit(1)), n)))
        stop = F.array_position(fits, F.lit(False))
        return F.struct(F.round(field, 9).alias("field_score"), F.round(coherent, 9).alias("coherence"), F.when(stop == 0, F.size(fits)).otherwise(stop - 1).cast("int").alias("leaf"))

    return held(active_chunks(evidence), scored)


def rarity(candidates: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(query_id, rarity): a map from token to ln(1 + candidates / candidates that hold it)."""
    n = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    df = candidates.select("query_id", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("df"))
    value = F.log1p(F.col("n") / F.col("df"))
    return df.join(n, "query_id").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("token", value.alias("v")))).alias("rarity"))


def rare_phrase_admission(phrases: DataFrame, docs: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, doc_id, field, bonus): documents admitted by a phrase that few hold, each with its best witness.

    phrases: (query_id, phrase tokens); docs: (doc_id, field, tokens).  A phrase of two words or more counts when at most
    MOST_DOCS documents, and one percent of all, hold it in a field; a query admits MOST_ADMITTED documents at most: these bounds are the operator's definition.
    """
    tokens = docs.select("doc_id", "field", F.explode(F.array_distinct("tokens")).alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    wanted = phrases.filter(F.size("phrase") >= 2)
    rarest = wanted.select("query_id", "phrase", F.explode("phrase").alias("token")).join(df, "token").groupBy("query_id", "phrase").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    maybe = rarest.join(tokens, "token").join(docs, ["doc_id", "field"])
    hits = maybe.filter(has_sequence(F.array("tokens"), F.col("phrase"))).select("query_id", "phrase", "doc_id", "field").distinct()
    sizes = hits.groupBy("query_id", "phrase").agg(F.countDistinct("doc_id").alias("docs"))
    few = hits.join(sizes.filter(F.col("docs") <= min(MOST_DOCS, max(1, int(MOST_SHARE * n_docs)))), ["query_id", "phrase"])
    strength = F.log1p(F.lit(float(n_docs)) / F.col("docs")) / F.log1p(F.lit(float(n_docs)))
    best = few.withColumn("s", F.round(BONUS * strength, 9)).groupBy("query_id", "doc_id").agg(F.max(F.struct("s", "field")).alias("b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("b.s"), "doc_id")
    return best.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= MOST_ADMITTED).select("query_id", "doc_id", F.col("b.field").alias("field"), F.col("b.s").alias("bonus"))


def replacement_part(title: Column, asked: Column) -> Column:
    """Whether a title is a part for the thing that was asked for, and not the thing: straps, handles, laces and the like for, or as replacement of, it."""
    return F.regexp_like(F.lower(title), F.lit(r"\b(?:replacement|spare)\b|\b(?:strap|straps|handle|handles|laces|insoles|charm|charms|organizer|insert|hook)\b.*\bfor\b")) & ~F.regexp_like(F.lower(asked), F.lit(r"\b(?:replacement|spare|strap|handle|laces|insoles|charm|organizer|insert|hook)s?\b"))
