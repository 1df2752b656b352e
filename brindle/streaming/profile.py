"""Long-term preference profiles: confirmed preferences of a customer across sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def learned(observations: DataFrame, *, least: int = 2) -> DataFrame:
    """(profile_id, attribute, value, confirmations, confidence, first_turn, latest_turn) of rows (profile_id, turn, attribute, value, kind).

    kind: said (learned at the second time), durable (at once), replace (at
    once, and other values of the attribute end), reject (the value ends).  What
    was said before the latest end of a value does not count for it.
    """
    o = observations.filter("attribute <> 'category'").withColumn("value", F.lower(F.trim("value"))).filter("value <> ''")
    ends = o.filter("kind = 'replace'").groupBy("profile_id", "attribute").agg(F.max_by("value", "turn").alias("new_value"), F.max("turn").alias("replaced"))
    gone = o.filter("kind = 'reject'").groupBy("profile_id", "attribute", "value").agg(F.max("turn").alias("rejected"))
    live = o.filter("kind <> 'reject'").join(ends, ["profile_id", "attribute"], "left").join(gone, ["profile_id", "attribute", "value"], "left")
    live = live.filter((F.col("replaced").isNull() | (F.col("value") == F.col("new_value")) | (F.col("turn") > F.col("replaced"))) & (F.col("rejected").isNull() | (F.col("turn") > F.col("rejected"))))
    g = live.groupBy("profile_id", "attribute", "value").agg(F.count(F.lit(1)).alias("confirmations"), F.bool_or(F.col("kind").isin("durable", "replace")).alias("strong"), F.min("turn").alias("first_turn"), F.max("turn").alias("latest_turn"))
    times = F.col("confirmations") - F.when(F.col("strong"), 1).otherwise(least)
    confidence = F.least(F.lit(0.90), F.when(F.col("strong"), 0.75).otherwise(0.70) + 0.10 * times)
    return g.filter(F.col("strong") | (F.col("confirmations") >= least)).select("profile_id", "attribute", "value", "confirmations", F.round(confidence, 6).alias("confidence"), "first_turn", "latest_turn")


def decayed(preferences: DataFrame, half_life: float = 4.0) -> DataFrame:
    """Soft preferences fade by half every half_life turns before the session's latest turn."""
    latest = F.max("turn").over(Window.partitionBy("session_id"))
    return preferences.withColumn("weight", F.col("weight") * F.pow(F.lit(0.5), (latest - F.col("turn")) / half_life))
