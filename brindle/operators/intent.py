"""What a customer is about: routing modes, retrieval plans, hypotheses, and how much work a turn deserves."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Wording by which a message is judged, and the weights of what it shows.
COMMITTED = r"(?i)\b(?:must|require|exactly|under|below|at most|without|avoid|non[- ]negotiable|deal[- ]?breaker)\b"
NOT_COMMITTED = r"(?i)\bwithout\s+(?:choosing|committing|settling|deciding)\b"
DIRECT = r"(?i)\b(?:i\s+(?:need|want)|i(?:'m| am)\s+(?:looking for|after)|find me|show me|please find)\b"
EXPLORING = r"(?i)\b(?:ideas?|explor(?:e|ing)|browse|browsing|inspiration|suggestions?|not sure|figuring out|open to|maybe|might|possibly|considering)\b"
OCCASION = r"(?i)\b(?:something for|gift(?:s|ing)?|occasion)\b"
VAGUE = r"(?i)\b(?:something|anything|ideas?|suggestions?|help)\b"
MIXED = r"(?i)\b(?:surprise me|flexible|torn between|somewhere between|don't know which|do not know which|other (?:options|ideas|solutions|alternatives)|show alternatives|better options even if|if (?:that|one) exists|one .* for both|(?:heavy|substantial).*(?:weightless|no heft))\b"
RELAXING = r"(?i)\b(?:forget|drop|remove|release|does(?:n't| not) matter|no preference|anything is fine|whatever works|any (?:color|material|style|brand|size))\b"
CORRECTING = r"(?i)\b(?:not that|i meant|correction|scratch that|don't want|do not want)\b"
RULES = {"object": 0.20, "slots": 0.25, "hard": 0.00, "buying_language": 0.20, "browsing_language": 0.50, "use_without_object": 0.25, "unresolved": 0.25, "sparse": 0.50}
# Objects that an activity suggests, in order.
USES = {"running": "sneakers", "walking": "shoes", "hiking": "boots", "swimming": "swimwear", "wedding": "dresses jewelry", "work": "shirts bags", "travel": "bags shoes", "yoga": "leggings", "cycling": "shorts", "gym": "tops shoes", "winter": "coats boots", "summer": "shirts sandals", "beach": "swimwear sandals", "party": "dresses jewelry"}
# Weights of routes by mode.
ROUTES = {"buying": {"broad": 0.8, "field_union": 1.0, "factored": 1.2}, "browsing": {"broad": 1.2, "field_union": 1.0, "factored": 0.6}, "mixed": {"broad": 1.0, "field_union": 1.0, "factored": 1.0}}


def search_mode(sources: Column, opening: Column) -> Column:
    """struct(mode, reason) from the evidence sources of a session and its first message."""
    has = lambda s: F.array_contains(sources, F.lit(s))
    rules = [(has("hard_constraint") | has("override"), "buying", "explicit_requirement"), (opening.rlike(r"(?i)\bi(?:'m| am) still exploring\b"), "browsing", "open_ended_start"), (has("initial_preference"), "buying", "stated_preference"), (F.size(F.array_remove(sources, "category")) > 0, "buying", "specific_evidence")]
    mode, reason = F.lit("browsing"), F.lit("category_only")
    for holds, m, why in reversed(rules):
        mode, reason = F.when(F.coalesce(holds, F.lit(False)), m).otherwise(mode), F.when(F.coalesce(holds, F.lit(False)), why).otherwise(reason)
    return F.struct(mode.alias("mode"), reason.alias("reason"))


def shopping_intent(message: Column, preferences: Column, removed: Column, added: Column, *, buying: float = 0.50, browsing: float = 0.50, general: float = 0.35, confident: float = 0.65, rules: dict[str, float] = RULES) -> Column:
    """struct(mode, specificity, confidence, over_general, event, action): mode by scores of live preferences (attribute, polarity, hard) and wording; action is mixed where the scores are too close.

    removed and added count the preferences that the message ended and brought.
    """
    yes = F.filter(preferences, lambda p: p["polarity"] == 1)
    kinds = F.array_distinct(F.transform(yes, lambda p: p["attribute"]))
    has = lambda name: F.array_contains(kinds, F.lit(name))
    number = lambda c: c.cast("double")
    obj, unresolved, hard = has("category"), has("other"), F.exists(preferences, lambda p: p["hard"] & (p["polarity"] != 0))
    slots = F.size(F.array_remove(kinds, "other"))
    committed = message.rlike(COMMITTED) & ~message.rlike(NOT_COMMITTED)
    browses = message.rlike(EXPLORING) | (message.rlike(OCCASION) & ~obj)
    asks = message.rlike(DIRECT)
    buys = committed | (asks & ~browses & (obj | ~message.rlike(VAGUE)))
    buy = rules["object"] * number(obj) + rules["slots"] * F.least(slots, F.lit(3)) + rules["hard"] * number(hard) + rules["buying_language"] * number(buys)
    look = rules["browsing_language"] * number(browses) + rules["use_without_object"] * number(has("use_case") & ~obj) + rules["unresolved"] * number(unresolved) + rules["sparse"] * number(~obj & (slots <= 1))
    specific = F.least(F.lit(1.0), (number(obj) + F.least(slots, F.lit(3)) / 3 + number(hard) + number(~unresolved)) / 4)
    event = F.when(message.rlike(RELAXING) | ((removed > 0) & (added == 0)), "relaxation").when(message.rlike(CORRECTING) & (removed == 0), "correction").when((removed > 0) & (added > 0), "override").otherwise("continue")
    mixed = (message.rlike(MIXED) & (obj | committed | asks | (slots > 0))) | (browses & committed & (obj | hard))
    mode = F.when((event == "relaxation") & browses & ~committed, "browsing").when(mixed, "mixed").when((buy >= buying) & (look < browsing), "buying").when((look >= browsing) & (buy < buying), "browsing").otherwise("mixed")
    sure = F.abs(buy - look) / F.greatest(buy, look, F.lit(buying), F.lit(browsing))
    return F.struct(mode.alias("mode"), F.round(specific, 9).alias("specificity"), F.round(sure, 9).alias("confidence"), ((specific < general) & ((look > 0) | ~obj)).alias("over_general"), event.alias("event"), F.when(sure >= confident, mode).otherwise("mixed").alias("action"))


def needs_escalation(confidence: Column, overlap: Column, candidates: Column, objects: Column, margin: Column, *, low_confidence: float = 0.5, low_overlap: float = 0.2, many: int = 150, low_margin: float = 0.05, threshold: float = 0.5) -> Column:
    """struct(uncertainty, escalate): whether a turn deserves a deeper re-ranking; unknown overlaps and margins add nothing."""
    signals = [(confidence < low_confidence, 0.30), (overlap < low_overlap, 0.30), (candidates >= many, 0.20), (objects == 0, 0.20), (margin < low_margin, 0.30)]
    total = F.least(F.lit(1.0), sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in signals), F.lit(0.0)))
    return F.struct(F.round(total, 9).alias("uncertainty"), (F.round(total, 9) >= threshold).alias("escalate"))


def sufficiency(turn: Column, informative: Column, over_general: Column, specificity: Column, settled: Column, deferred: Column, open_questions: Column, *, least: float = 0.35, most_deferred: int = 1, action: str = "clarify_first") -> Column:
    """struct(action, reason): search now, or ask first while too little is known and a question is left."""
    ladder = [(turn >= 10, "final_turn"), (deferred >= most_deferred, "defer_budget_exhausted"), ((turn > 1) & informative, "productive_answer"), (~over_general | (specificity >= least), "sufficient_specificity"), (settled, "object_or_hard_constraint"), (open_questions == 0, "no_productive_question")]
    act, why = F.lit(action), F.lit("over_general")
    for holds, reason in reversed(ladder):
        act, why = F.when(holds, "retrieve").otherwise(act), F.when(holds, reason).otherwise(why)
    return F.struct(act.alias("action"), why.alias("reason"))


def retrieval_plan(preferences: Column) -> Column:
    """struct(objects, uses, positive, negative, must, must_not, preferred, budgets) of preferences (attribute, value, polarity, hard), each in order without repeats."""

    def listed(keep):
        return F.array_distinct(F.transform(F.filter(preferences, keep), lambda p: p["value"]))

    yes, no = (lambda p: p["polarity"] == 1), (lambda p: p["polarity"] == -1)
    kind = lambda p, name: p["attribute"] == name
    return F.struct(
        listed(lambda p: yes(p) & kind(p, "category")).alias("objects"), listed(lambda p: yes(p) & kind(p, "use_case")).alias("uses"), listed(yes).alias("positive"), listed(no).alias("negative"),
        listed(lambda p: yes(p) & p["hard"] & ~kind(p, "budget")).alias("must"), listed(lambda p: no(p) & p["hard"]).alias("must_not"),
        listed(lambda p: yes(p) & ~p["hard"] & ~kind(p, "use_case")).alias("preferred"), listed(lambda p: yes(p) & kind(p, "budget")).alias("budgets"),
    )


def hypotheses(plan: Column, most: int = 2) -> Column:
    """Array of (query, reason), at most ``most``: one for each object named, or the open request; then objects that an activity suggests."""
    row = "array<struct<query:string,reason:string>>"
    words = lambda parts: F.array_join(F.array_distinct(parts), " ")
    named = F.transform(plan["objects"], lambda o: F.struct(words(F.concat(F.array(o), plan["positive"])).alias("query"), F.lit("explicit_object").alias("reason")))
    base = words(F.concat(plan["objects"], plan["uses"], plan["positive"]))
    first = F.when(F.size(plan["objects"]) > 0, named).when(base != "", F.array(F.struct(base.alias("query"), F.lit("open_request").alias("reason")))).otherwise(F.array().cast(row))
    known = F.map_from_arrays(F.array(*[F.lit(u) for u in USES]), F.array(*[F.split(F.lit(v), " ") for v in USES.values()]))
    more = F.flatten(F.transform(plan["uses"], lambda u: F.transform(F.coalesce(F.try_element_at(known, u), F.array().cast("array<string>")), lambda o: F.struct(words(F.concat(F.array(o, u), plan["positive"])).alias("query"), F.concat(F.lit("use_case:"), u).alias("reason")))))
    new = F.filter(more, lambda m: ~F.exists(first, lambda f: f["query"] == m["query"]))
    return F.slice(F.concat(first.cast(row), new.cast(row)), 1, most)


def route_weight(mode: Column, route: Column) -> Column:
    out = F.lit(1.0)
    for m, weights in ROUTES.items():
        for r, w in weights.items():
            out = F.when((mode == m) & (route == r), F.lit(w)).otherwise(out)
    return out
