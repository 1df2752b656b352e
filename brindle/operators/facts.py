"""A ledger of facts in versions: what a session holds true, since when and until when.

Statements about an attribute end older facts by rules that look at one statement and one fact only, so no session needs
to be folded in order: a fact's end is the first later statement of each kind that ends it, found by windows over the session's
statements of its attribute, its value or its owner.  Facts that hang on an owner ("two pockets" on "pockets") fall when no version of the owner
stands any more, which is a join of intervals.  The same rules as a fold of one turn after the other serve a stream.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

ANY = "any"
# Attributes whose values stand beside one another; attributes that only an explicit replacement clears.
OPEN, STICKY = ("feature", "use_case", "other"), ("material",)
MODES = ("ledger", "latest", "history")


@dataclass(frozen=True)
class Cues:
    """Words of a clause that turn its statements: denial before a value, neutral or relaxing words right behind it, quantities right before it, and words anywhere."""

    denial: tuple[str, ...] = ("no", "not", "never", "without", "avoid", "excluding", "hate", "dislike")
    neutral: tuple[str, ...] = ("whatever", "regardless", "irrelevant")
    relaxed: tuple[str, ...] = ("optional", "unnecessary", "unimportant")
    quantities: tuple[str, ...] = ("two", "three", "four", "five", "six", "several", "many")
    additive: tuple[str, ...] = ("also", "either", "or", "too")
    replacement: tuple[str, ...] = ("actually", "instead", "rather", "change", "switch", "replace", "swap")


def statements(messages: DataFrame, vocabulary: DataFrame, cues: Cues = Cues(), *, clause: str = r"[.;!?\n]+", word: str = r"[\p{L}\p{N}_]+") -> DataFrame:
    """(session_id, turn, clause, place, attribute, value, polarity, additive, replacement, owner_attribute, owner_value) of messages (session_id, turn, text).

    vocabulary: (word, attribute, value).  A value is denied (-1) behind a denial of its clause, left open (0) before a relaxing
    word, and gives way to "any" before a neutral word.  A quantity right before a value adds the statement "quantity value" of the attribute "other", which hangs on
    that value.  Null texts state nothing.
    """
    parts = messages.filter("text is not null").select("session_id", "turn", F.posexplode(F.split(F.lower("text"), clause)).alias("clause", "said"))
    cut = parts.select("session_id", "turn", "clause", F.regexp_extract_all("said", F.lit(word), 0).alias("w"))
    holds = lambda words: F.arrays_overlap("w", F.array(*map(F.lit, words))) if words else F.lit(False)
    first = [F.nullif(F.array_position("w", F.lit(x)), F.lit(0)) for x in cues.denial]
    denied_from = F.array_min(F.array(*first)) if first else F.lit(None)
    near = F.transform("w", lambda x, i: F.struct((i + 1).alias("place"), x.alias("word"), F.get("w", i - 1).alias("prior"), F.get("w", i + 1).alias("next")))
    each = cut.select("session_id", "turn", "clause", holds(cues.additive).alias("additive"), holds(cues.replacement).alias("replacement"), denied_from.alias("denied"), F.explode(near).alias("x"))
    said = each.join(vocabulary.select(F.col("word").alias("known"), "attribute", "value"), F.col("x.word") == F.col("known"))
    has = lambda c, words: F.coalesce(F.col(c).isin(*words), F.lit(False)) if words else F.lit(False)
    neutral = has("x.next", cues.neutral)
    polarity = F.when(neutral | has("x.next", cues.relaxed), 0).when(F.col("denied") < F.col("x.place"), -1).otherwise(1)
    own = F.struct(F.col("attribute"), F.when(neutral, F.lit(ANY)).otherwise(F.col("value")).alias("value"), polarity.alias("polarity"), F.lit(None).cast("string").alias("owner_attribute"), F.lit(None).cast("string").alias("owner_value"))
    counted = F.struct(F.lit("other").alias("attribute"), F.concat_ws(" ", "x.prior", "value").alias("value"), F.when(F.col("denied") < F.col("x.place"), -1).otherwise(1).alias("polarity"), F.col("attribute").alias("owner_attribute"), F.col("value").alias("owner_value"))
    every = F.when(has("x.prior", cues.quantities) & ~neutral, F.array(own, counted)).otherwise(F.array(own))
    return said.select("session_id", "turn", "clause", F.col("x.place").alias("place"), F.explode(every).alias("s"), "additive", "replacement").select("session_id", "turn", "clause", "place", "s.attribute", "s.value", "s.polarity", "additive", "replacement", "s.owner_attribute", "s.owner_value")


def _within(*keys: str):
    return Window.partitionBy("session_id", *keys)


def _later(condition: Column, keys: Iterable[str]) -> Column:
    """The first later step with a statement that meets the condition, among those with equal keys."""
    w = _within(*keys).orderBy("step").rangeBetween(1, Window.unboundedFollowing)
    return F.min(F.when(condition, F.col("step"))).over(w)


def versions(said: DataFrame, mode: str = "ledger") -> DataFrame:
    """(session_id, attribute, value, polarity, owner_attribute, owner_value, version, since, until): every version of every fact that statements() makes; until is null while it stands.

    since and until are turns.  A step is a clause in mode "ledger", else a turn; statements of one attribute in a step act together, in the order of
    clause and place, and those before the last "any" do not count (but in "history").  By mode, a later step ends a fact

    * "history": if it states the same fact again;
    * "latest": if it states anything of the attribute;
    * "ledger": if it states the same value again or with another polarity; if it says "any" of the attribute; if the
      fact is an "any"; if it asserts values of the attribute and is neither additive nor about an attribute of OPEN (of STICKY only if it
      replaces and denies nothing), for asserted facts; if it counts the fact's owner anew; and, for facts of
      "other", if it denies words that stand in the value.

    An asserted fact with an owner ends, in every mode, with the first step behind which no assertion of the owner stands.  Sessions are
    windows, not groups of rows in memory; repeated statements of one step are one.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    order = [F.col("turn"), F.col("clause")] if mode == "ledger" else [F.col("turn")]
    placed = said.withColumn("step", F.dense_rank().over(_within().orderBy(*order))).withColumn("at", F.struct("clause", "place"))
    group = _within("step", "attribute")
    flags = placed.withColumn("replaces", F.max("replacement").over(group)).withColumn("adds", F.max("additive").over(group) & ~F.col("replaces"))
    if mode != "history":
        last_any = F.max(F.when((F.col("value") == ANY) & (F.col("polarity") == 0), F.col("at"))).over(group)
        ranked = flags.withColumn("any_at", last_any).withColumn("last_at", F.max("at").over(group))
        flags = ranked.filter(F.col("any_at").isNull() | (F.col("at") > F.col("any_at")) | ((F.col("at") == F.col("any_at")) & (F.col("value") == ANY) & (F.col("last_at") == F.col("any_at"))))
    key = ["session_id", "step", "attribute", "value", "polarity", "owner_attribute", "owner_value"]
    facts = flags.groupBy(*key).agg(F.max("turn").alias("turn"), F.first("replaces").alias("replaces"), F.first("adds").alias("adds"))
    if mode == "latest":
        until = _later(F.lit(True), ["attribute"])
    elif mode == "history":
        until = _later(F.lit(True), key[2:])
    else:
        asserts = F.max((F.col("polarity") == 1).cast("int")).over(group) == 1
        denies = F.max((F.col("polarity") == -1).cast("int")).over(group) == 1
        slot = asserts & ~F.col("adds") & ~F.col("attribute").isin(*OPEN) & (~F.col("attribute").isin(*STICKY) | (F.col("replaces") & ~denies))
        any_ = (F.col("value") == ANY) & (F.col("polarity") == 0)
        facts = facts.withColumn("slot", slot).withColumn("any", any_)
        until = F.least(
            _later(F.lit(True), ["attribute", "value"]), _later(F.col("any"), ["attribute"]), F.when(F.col("polarity") == 1, _later(F.col("slot"), ["attribute"])),
            F.when(F.col("any"), _later(F.lit(True), ["attribute"])), F.when(F.col("owner_value").isNotNull(), _later(F.lit(True), ["attribute", "owner_attribute", "owner_value"])),
        )
    ended = facts.withColumn("until", until)
    if mode == "ledger":
        ended = _denied_words(ended)
    ended = _with_owners(ended)
    turns = facts.groupBy("session_id", F.col("step").alias("until")).agg(F.max("turn").alias("until_turn"))
    told = ended.join(turns, ["session_id", "until"], "left")
    number = F.row_number().over(_within(*key[2:]).orderBy("step"))
    return told.select("session_id", "attribute", "value", "polarity", "owner_attribute", "owner_value", number.alias("version"), F.col("turn").alias("since"), F.col("until_turn").alias("until"))


def _denied_words(facts: DataFrame) -> DataFrame:
    """Facts of "other" also end with the first later denial, of the same attribute, of words in their value: an equal phrase is looked up among all runs of words of the value."""
    w = F.split("value", " ")
    n = F.size(w)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(w, i, k), " "))))
    other = facts.filter("attribute = 'other' and polarity = 1")
    asked = other.select("session_id", "step", "value", "owner_attribute", "owner_value", F.explode(F.array_distinct(runs)).alias("phrase"), F.lit(False).alias("denial"))
    said = facts.filter("attribute = 'other' and polarity = -1").select("session_id", "step", "value", "owner_attribute", "owner_value", F.col("value").alias("phrase"), F.lit(True).alias("denial"))
    found = asked.unionByName(said).withColumn("hit", _later(F.col("denial"), ["phrase"])).filter(~F.col("denial") & F.col("hit").isNotNull())
    first = found.groupBy("session_id", "step", "value", F.coalesce("owner_attribute", F.lit("")).alias("oa"), F.coalesce("owner_value", F.lit("")).alias("ov")).agg(F.min("hit").alias("hit"))
    keyed = facts.withColumn("oa", F.coalesce("owner_attribute", F.lit(""))).withColumn("ov", F.coalesce("owner_value", F.lit("")))
    joined = keyed.join(first.withColumn("attribute", F.lit("other")).withColumn("polarity", F.lit(1)), ["session_id", "step", "attribute", "value", "polarity", "oa", "ov"], "left")
    return joined.withColumn("until", F.least("until", "hit")).drop("hit", "oa", "ov")


def _with_owners(facts: DataFrame) -> DataFrame:
    """Ends asserted facts with an owner where no assertion of the owner stands.

    Versions of an owner that follow one another at once are one stretch; a fact falls at the end of the stretch that holds the
    step it was stated in, or at once if there is none: the last stretch that begins by then, in one sorted run of stretches and facts.
    """
    owner = facts.filter("polarity = 1 and owner_value is null")
    w = _within("attribute", "value").orderBy("step")
    far = F.lit(2**31 - 1)
    held = owner.withColumn("stop", F.coalesce("until", far)).withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begun = held.withColumn("stretch", F.sum((F.col("reach").isNull() | (F.col("step") > F.col("reach"))).cast("int")).over(w))
    stretch = begun.groupBy("session_id", F.col("attribute").alias("oa"), F.col("value").alias("ov"), "stretch").agg(F.min("step").alias("at"), F.max("stop").alias("stop"))
    hangs = F.col("owner_value").isNotNull() & (F.col("polarity") == 1)
    own = facts.filter(hangs).withColumn("id", F.struct("step", "attribute", "value"))
    rows = own.select("session_id", F.col("owner_attribute").alias("oa"), F.col("owner_value").alias("ov"), F.col("step").alias("at"), F.lit(None).cast("int").alias("stop"), "id").unionByName(stretch.select("session_id", "oa", "ov", "at", F.col("stop").cast("int").alias("stop"), F.lit(None).cast(own.schema["id"].dataType).alias("id")))
    last = F.last("stop", ignorenulls=True).over(_within("oa", "ov").orderBy("at", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    stands = rows.withColumn("stop", last).filter("id is not null")
    falls = stands.withColumn("falls", F.when(F.col("stop") > F.col("at"), F.nullif("stop", far)).otherwise(F.col("at"))).select("session_id", F.col("id.step").alias("step"), F.col("id.attribute").alias("attribute"), F.col("id.value").alias("value"), F.col("oa").alias("owner_attribute"), F.col("ov").alias("owner_value"), F.lit(1).alias("polarity"), "falls")
    keys = ["session_id", "step", "attribute", "value", "owner_attribute", "owner_value", "polarity"]
    return facts.join(falls, keys, "left").withColumn("until", F.least("until", "falls")).drop("falls")


def standing(history: DataFrame) -> DataFrame:
    """The facts that stand after a session's last turn."""
    return history.filter("until is null").drop("until")
