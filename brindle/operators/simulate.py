"""The offline customer: messages and disclosure as DataFrame steps, one job a turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import FACETS


def constraint_kind(value: Column) -> Column:
    """The attribute a constraint text belongs to, by ordered keywords."""
    v = F.lower(value)
    # The keywords of each attribute, in the order they are tried.
    return (
        F.when(v.contains("budget") | v.rlike(r"(?:\$|<=|under)\s*\d"), "budget")
        .when(v.rlike(FACETS["material"]), "material")
        .when(v.rlike("color|black|white|blue|red|pink|green"), "color")
        .when(v.rlike("size|sizing|width|wide|narrow"), "size")
        .when(v.rlike("department|style|fit|sleeve|neck"), "style")
        .when(v.rlike("hiking|running|gym|winter|outdoor|work"), "use_case")
        .otherwise("feature")
    )


def opening(scenario: Column, category: Column, hard: Column, old: Column) -> Column:
    start = F.concat(F.lit("I'm looking for "), category)
    return F.when((scenario == "buying") & hard.isNotNull(), F.concat(start, F.lit(". A key requirement is: "), hard, F.lit("."))).when(scenario == "intent_override", F.concat(start, F.lit(". "), old)).otherwise(F.concat(start, F.lit(", but I'm still exploring.")))


def reply(asked: Column, constraints: Column, disclosed: Column) -> Column:
    """struct(message, matches): up to two undisclosed constraints of the asked attribute."""
    matches = F.slice(F.filter(constraints, lambda c: ~F.array_contains(disclosed, c) & ((asked == "other") | (constraint_kind(c) == asked))), 1, 2)
    message = (
        F.when(asked.isNull(), "Those options are not quite right yet. Ask me about one specific attribute.")
        .when(F.size(matches) == 0, F.concat(F.lit("I don't have an additional preference for "), asked, F.lit(".")))
        .otherwise(F.concat(F.lit("For that, what matters is: "), F.array_join(matches, "; "), F.lit(".")))
    )
    return F.struct(message.alias("message"), F.when(asked.isNull(), F.array().cast("array<string>")).otherwise(matches).alias("matches"))


def run(sessions: DataFrame, respond: Callable[[DataFrame, int], DataFrame], *, turns: int = 10, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(sample_id, first_hit_turn, best_rank): all sessions advance a turn at a time.

    sessions: (sample_id, target, message, constraints, disclosed).  respond
    gets the open sessions and the turn, and returns (sample_id, ids, ask).
    keep writes and rereads each turn's state on a cluster.
    """
    now = sessions.withColumn("first_hit_turn", F.lit(None).cast("int")).withColumn("best_rank", F.lit(None).cast("int"))
    for turn in range(1, turns + 1):
        answer = respond(now.filter("first_hit_turn IS NULL"), turn)
        j = now.join(answer, "sample_id", "left")
        place = F.array_position(F.col("ids"), F.col("target")).cast("int")
        hit = F.col("first_hit_turn").isNull() & (F.coalesce(place, F.lit(0)) > 0)
        said = reply(F.col("ask"), F.col("constraints"), F.col("disclosed"))
        now = keep(
            j.withColumn("said", said).select(
                "sample_id", "target", F.col("said.message").alias("message"), "constraints", F.array_union("disclosed", "said.matches").alias("disclosed"),
                F.when(hit, F.lit(turn)).otherwise(F.col("first_hit_turn")).alias("first_hit_turn"), F.when(hit, place).otherwise(F.col("best_rank")).alias("best_rank"),
            )
        )
    return now.select("sample_id", "first_hit_turn", "best_rank")
