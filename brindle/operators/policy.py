"""Clarification questions, result width and intent policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .evaluation import at_places

# How readily customers answer a question about an attribute.
ANSWERABILITY = {"feature": 1.0, "material": 0.95, "color": 0.90, "budget": 0.80, "size": 0.70, "style": 0.65, "use_case": 0.60, "category": 0.30, "brand": 0.20}


def facet_entropy(masses: DataFrame) -> DataFrame:
    """(query_id, attribute, coverage, gain) of rows (query_id, attribute, signature, p).

    Known signatures partition the candidates; gain is coverage times the
    entropy of the known part, at most the entropy of all rows.  A null
    signature is unknown and reduces nothing.
    """
    prior = masses.groupBy("query_id", "attribute").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")))).alias("prior"))
    groups = masses.filter("signature is not null").groupBy("query_id", "attribute", "signature").agg(F.sum("p").alias("mass")).filter("mass > 0")
    w = Window.partitionBy("query_id", "attribute")
    share = groups.withColumn("coverage", F.sum("mass").over(w)).withColumn("q", F.col("mass") / F.col("coverage"))
    known = share.groupBy("query_id", "attribute").agg(F.max("coverage").alias("coverage"), (-F.sum(F.col("q") * F.log("q"))).alias("entropy"))
    both = prior.join(known, ["query_id", "attribute"], "left")
    gain = F.least(F.col("prior"), F.coalesce(F.col("coverage") * F.col("entropy"), F.lit(0.0)))
    return both.select("query_id", "attribute", F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"), F.round(F.greatest(gain, F.lit(0.0)), 9).alias("gain"))


def top_examples(masses: DataFrame, k: int = 3) -> DataFrame:
    """The k known signatures of most mass of each attribute, ties by signature."""
    groups = masses.filter("signature is not null").groupBy("query_id", "attribute", "signature").agg(F.round(F.sum("p"), 9).alias("mass"))
    w = Window.partitionBy("query_id", "attribute").orderBy(F.desc("mass"), "signature")
    return groups.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k)


def best_question(gains: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The attribute of most gain * answerability / (1 + 0.85 * times asked), ties by name."""
    prior = F.lit(0.50)
    for name, value in ANSWERABILITY.items():
        prior = F.when(F.col("attribute") == name, F.lit(value)).otherwise(prior)
    rows = gains if asked is not None else gains.withColumn("asked", F.lit(0))
    if asked is not None:
        rows = gains.join(asked, ["query_id", "attribute"], "left").fillna(0, ["asked"])
    scored = rows.withColumn("value", F.round(F.col("gain") * prior / (1 + 0.85 * F.col("asked")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("value"), "attribute")
    return scored.withColumn("i", F.row_number().over(w)).filter("i = 1").select("query_id", "attribute", "value")


def quartiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Cut points at places n/4, n/2 and 3n/4 of the sorted values, not interpolated; none for groups under four."""
    found = at_places(rows, group, value, {f"q{k}": (lambda n, k=k: F.floor(n * k / 4)) for k in (1, 2, 3)})
    return found.filter("n >= 4").select(group, "q1", "q2", "q3")


def margin_and_entropy(scored: DataFrame, first: int = 10) -> DataFrame:
    """(query_id, n, margin, entropy): relative lead of the best over the second, and normalised entropy of the first places' exponentiated scores."""
    top = scored.filter(F.col("rank") <= first)
    s = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("score", -F.col("rank")).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.max_by("score", F.col("rank")).alias("last"))
    scale = F.greatest(F.abs("s1"), F.abs("last"), F.lit(1.0)) * 0.05
    w = Window.partitionBy("query_id")
    e = top.join(s, "query_id").withColumn("e", F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(0.0), (F.col("score") - F.col("s1")) / scale)))).withColumn("p", F.col("e") / F.sum("e").over(w))
    h = e.groupBy("query_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    margin = F.greatest(F.lit(0.0), (F.col("s1") - F.col("s2")) / F.greatest(F.abs("s1"), F.abs("s2"), F.lit(1.0)))
    return s.join(h, "query_id").select("query_id", "n", F.round(F.coalesce(margin, F.lit(0.0)), 9).alias("margin"), F.round(F.when(F.col("n") < 2, 0.0).otherwise(F.col("h") / F.log(F.col("n").cast("double"))), 9).alias("entropy"))


def width(margin: Column, entropy: Column, turn: Column, requested: Column, *, hard_left: Column, question_value: Column) -> Column:
    """How many results to show: one for a clear leader or a question worth asking, all when ambiguous, a few else."""
    ambiguous = (margin <= 0.01) | (entropy >= 0.98)
    asks, valuable = question_value.isNotNull(), F.coalesce(question_value >= 0.20, F.lit(False))
    left = F.greatest(F.lit(0), 10 - turn)
    return (
        F.when(requested == 1, requested)
        .when(asks & ~valuable, F.when(ambiguous | hard_left, requested).otherwise(F.least(requested, F.lit(5))))
        .when(~asks & (turn == 3), F.least(requested, F.lit(5)))
        .when(~asks & (left <= 6), requested)
        .when(~hard_left & (margin >= 0.08) & (entropy <= 0.80), F.lit(1))
        .when(valuable & (left > 1), F.lit(1))
        .when(ambiguous | hard_left, requested)
        .otherwise(F.least(requested, F.lit(2)))
    )


def score_gap(scored: DataFrame, near: int = 20, far: int = 30) -> DataFrame:
    """(query_id, gap, depth): far unless the score falls clearly between the two places."""
    s = scored.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == near, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == far, F.col("score"))).alias("b"))
    gap = F.coalesce((F.col("a") - F.col("b")) / F.greatest(F.abs("top"), F.lit(1e-9)), F.lit(0.0))
    return s.select("query_id", F.round(gap, 9).alias("gap"), F.when(gap > 0.05, near).otherwise(far).alias("depth"))


def answer_entropy(candidates: DataFrame) -> DataFrame:
    """(query_id, attribute, entropy, unknown) in bits of rows (query_id, attribute, answers array): a candidate's share is split among its answers, none is unknown."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "attribute"))
    rows = candidates.withColumn("n", n).withColumn("k", F.greatest(F.size("answers"), F.lit(1)))
    mass = rows.select("query_id", "attribute", F.explode(F.when(F.size("answers") > 0, F.col("answers")).otherwise(F.array(F.lit(None).cast("string")))).alias("answer"), (1 / F.col("n") / F.col("k")).alias("m")).groupBy("query_id", "attribute", "answer").agg(F.sum("m").alias("m"))
    return mass.groupBy("query_id", "attribute").agg(F.round(F.greatest(F.lit(0.0), -F.sum(F.col("m") * F.log2("m"))), 9).alias("entropy"), F.round(F.coalesce(F.sum(F.when(F.col("answer").isNull(), F.col("m"))), F.lit(0.0)), 9).alias("unknown"))


def discriminating(candidates: DataFrame, *, first: int = 30, coverage: float = 0.60, second: float = 0.15, largest: float = 0.75) -> DataFrame:
    """(query_id, attribute): the attribute that splits the first candidates (query_id, rank, attribute, answers) best: known for most, two groups at least, none too large."""
    top = candidates.filter(F.col("rank") <= first)
    total = top.groupBy("query_id", "attribute").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("answers") > 0).cast("int")).alias("present"))
    groups = top.select("query_id", "attribute", F.explode("answers").alias("a")).groupBy("query_id", "attribute", "a").agg(F.count(F.lit(1)).alias("c"))
    two = groups.groupBy("query_id", "attribute").agg(F.reverse(F.array_sort(F.collect_list("c"))).alias("cs"))
    j = total.join(two, ["query_id", "attribute"]).withColumn("cover", F.col("present") / F.col("n")).withColumn("top", F.col("cs")[0] / F.col("present"))
    fit = j.filter((F.col("cover") >= coverage) & (F.size("cs") >= 2) & (F.get("cs", F.lit(1)) / F.col("n") >= second) & (F.col("top") <= largest))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("cover") * (1 - F.col("top")), 9)), F.desc("attribute"))
    return fit.withColumn("i", F.row_number().over(w)).filter("i = 1").select("query_id", "attribute")


# How a question about an attribute is asked.
QUESTION = {"material": "What material or fabric would you prefer?", "color": "Which color would you prefer?", "size": "What size, width, or fit do you need?", "style": "What style would work best for you?", "use_case": "What activity or occasion will you use it for?", "budget": "What price range would you like to stay within?", "other": "What other feature or requirement matters most to you?"}


def question_text(attribute: Column, examples: Column) -> Column:
    """The question for an attribute, with up to three example answers behind it."""
    out = F.lit(QUESTION["other"])
    for name, text in QUESTION.items():
        out = F.when(attribute == name, F.lit(text)).otherwise(out)
    some = F.slice(examples, 1, 3)
    return F.when(F.size(some) > 0, F.concat(out, F.lit(" For example: "), F.array_join(some, ", "), F.lit("."))).otherwise(out)
