"""Evidence of several views: groups of alternatives vote together, and every preference names the fields that speak for or against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# How much an attribute counts, and others; a hard preference's strength; how much more a contradiction weighs.
WEIGHTS = {"category": 1.0, "material": 0.8, "color": 0.7, "style": 0.6, "use_case": 0.6, "feature": 0.6, "size": 0.4, "brand": 0.7, "budget": 0.8}
OTHER, HARD, AGAINST = 0.4, 1.25, 2.0


def assessed(signals: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, doc_id, score, violation) of signals (query_id, doc_id, grp, attribute, signal, hard, confidence).

    A signal is -1 to 1, 0 where nothing is known.  Of a group of alternatives (rows of one grp) the best vote counts, and it is
    violated only if every one of it is hard and contradicted; a document is in violation if some group is.
    """
    weight = F.coalesce(F.get(F.array(*[F.lit(w) for w in weights.values()]), (F.array_position(F.array(*map(F.lit, weights)), F.col("attribute")) - 1).cast("int")), F.lit(OTHER))
    strength = F.when(F.col("hard"), F.lit(HARD)).otherwise(F.col("confidence")) * F.when(F.col("signal") < 0, AGAINST).otherwise(1.0)
    vote = F.col("signal") * strength * F.when(F.array_contains(F.array(*map(F.lit, weights)), F.col("attribute")), weight).otherwise(OTHER)
    group = signals.groupBy("query_id", "doc_id", "grp").agg(F.max(vote).alias("vote"), F.bool_and(F.col("hard") & (F.col("signal") < 0)).alias("violated"))
    return group.groupBy("query_id", "doc_id").agg(F.sum("vote").alias("score"), F.bool_or("violated").alias("violation"))


def explained(fields: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, pref, status, signal, fields, what a preference has in keep) of signals by field (query_id, doc_id, pref, field, signal): what is known of each preference and which fields say so.

    The strongest signal counts; signals of both signs leave a preference unknown.  A field is named if its own signal has the sign of the whole.
    """
    g = fields.groupBy("query_id", "doc_id", "pref", *keep).agg(F.max("signal").alias("top"), F.min("signal").alias("low"), F.collect_list(F.struct("field", "signal")).alias("all"))
    whole = F.when((F.col("top") > 0) & (F.col("low") < 0), 0.0).when(F.col("top") > 0, F.col("top")).otherwise(F.col("low"))
    named = F.array_sort(F.transform(F.filter("all", lambda x: x["signal"] * F.col("signal") > 0), lambda x: x["field"]))
    status = F.when(F.col("signal") > 0, "supported").when(F.col("signal") < 0, "contradicted").otherwise("unknown")
    return g.withColumn("signal", whole).select("query_id", "doc_id", "pref", status.alias("status"), "signal", named.alias("fields"), *keep)
