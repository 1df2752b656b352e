"""Three-valued evidence of typed preferences: support, contradiction or nothing known.

Preferences stand in a row's array column of structs (attribute, value, polarity, hard, confidence, alternative_group);
a product's wording in an array of (text, confidence).  Scores are column expressions over both, so nothing is exploded or shuffled; guards are windows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Weight of an attribute; what negates or qualifies a value right before it; the families of products and their parts.
WEIGHTS = {"category": 1.1, "material": 0.65, "color": 0.55, "use_case": 0.65, "style": 0.45, "feature": 0.65, "size": 0.3, "brand": 0.5, "budget": 0.5}
OTHER_WEIGHT = 0.4
NEGATES = r"(?:no|not|non|without|faux|imitation|synthetic|avoid(?:s|ing)?|avoidance\s+of)"
FAMILIES = {
    "footwear": "shoes shoe sneakers sneaker boots boot sandals sandal",
    "bag": "bags bag handbag purse backpack backpacks tote",
    "watch": "watch watches",
    "jewelry": "ring rings necklace necklaces earring earrings bracelet bracelets jewelry jewellery",
    "clothing": "shirt shirts dress dresses jacket jackets coat coats pants jeans sweater sweaters hoodie hoodies",
}
PARTS = {"footwear": "laces|lace|insoles|insole|shoe inserts|heel grips", "bag": "replacement strap|bag strap|purse strap|handles|bag handles", "watch": "watch band|watch strap|replacement band"}
ACCESSORY = r"\b(?:accessor(?:y|ies)|replacement|spare|attachment|add-on)\b"
OWNERS = "body lining handle handles strap straps zipper sole lace laces sleeve sleeves collar cuff cuffs pocket pockets".split()
PREFERENCE = "struct<attribute:string,value:string,polarity:int,hard:boolean,confidence:double,alternative_group:string>"


def _literal(value: Column) -> Column:
    return F.concat(F.lit("\\Q"), value, F.lit("\\E"))


def variants(value: Column) -> Column:
    """A pattern for a value in lower case, its singular and its plural; grey for gray."""
    v = F.replace(F.lower(value), F.lit("gray"), F.lit("grey"))
    bare = F.when(v.endswith("ies"), F.concat(F.substring(v, F.lit(1), F.length(v) - 3), F.lit("y"))).when(v.endswith("s") & ~v.endswith("ss"), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(F.concat(v, F.lit("s")))
    short = F.when(v.endswith("ses"), F.substring(v, F.lit(1), F.length(v) - 2)).otherwise(v)
    return F.concat(F.lit("(?:"), _literal(v), F.lit("|"), _literal(bare), F.lit("|"), _literal(short), F.lit(")"))


def held(value: Column, then) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.transform(F.array(value), then)[0]


def signals(text: Column, value: Column) -> Column:
    """struct(yes, no): whether a text states a value, and whether it denies or qualifies it."""
    t, v = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("gray"), F.lit("grey")), variants(value)
    every = F.regexp_count(t, F.concat(F.lit(r"(?<!\w)"), v, F.lit(r"(?!\w)")))
    denied = F.regexp_count(t, F.concat(F.lit(rf"\b{NEGATES}\s*[- ]?"), v, F.lit(r"(?!\w)|(?<!\w)"), v, F.lit(r"[- ]free\b")))
    return F.struct((every > denied).alias("yes"), (denied > 0).alias("no"))


def budget_evidence(price: Column, lower_bound: Column, value: Column) -> Column:
    """1, -1 or 0 of a price for limits such as '<= 40', '>= 20' and '20 40'; a price that is only a lower bound never proves a maximum."""
    numbers = F.transform(F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), 0), lambda x: x.cast("double"))
    low = F.when((F.size(numbers) == 2) | value.startswith(">="), numbers[0]).otherwise(0.0)
    high = F.when(F.size(numbers) == 2, F.get(numbers, F.lit(1))).when(~value.startswith(">="), numbers[0])
    known = price.isNotNull() & (F.size(numbers) > 0)
    fits = (price >= low) & (high.isNull() | (price <= high))
    return F.when(~known, 0.0).when(high.isNotNull() & (price > high), -1.0).when(lower_bound, F.when(high.isNull() & (price >= low), 1.0).otherwise(0.0)).when(fits, 1.0).otherwise(-1.0)


def soft_budget(price: Column, lower_bound: Column, value: Column) -> Column:
    """Closeness of a price to a target, from 1 to -1; a range's middle is its target."""
    numbers = F.array_sort(F.transform(F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), 0), lambda x: x.cast("double")))
    two = F.size(numbers) == 2
    target = F.when(two, (F.get(numbers, F.lit(0)) + F.get(numbers, F.lit(1))) / 2).otherwise(F.get(numbers, F.lit(0)))
    scale = F.greatest(F.when(two, (F.get(numbers, F.lit(1)) - F.get(numbers, F.lit(0))) / 2).otherwise(0.0), target, F.lit(1.0))
    return F.when(price.isNull() | lower_bound | (price < 0) | target.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), 1 - 2 * F.abs(price - target) / scale))


def preference_signal(p: Column, sources: Column, price: Column, lower_bound: Column) -> Column:
    """Support (to 1), contradiction (to -1) or 0 for nothing known or both, turned by the preference's polarity."""
    seen = F.transform(sources, lambda s: F.struct(signals(s["text"], p["value"]).alias("x"), s["confidence"].alias("c")))

    def weighed(rows):
        best = F.struct(*[F.coalesce(F.array_max(F.transform(F.filter(rows, lambda s: s["x"][w]), lambda s: s["c"])), F.lit(0.0)).alias(w) for w in ("yes", "no")])
        return held(best, lambda b: F.when((b["yes"] > 0) & (b["no"] > 0), 0.0).otherwise(b["yes"] - b["no"]))

    words = held(seen, weighed)
    return F.when(p["attribute"] == "budget", budget_evidence(price, lower_bound, p["value"])).otherwise(words) * p["polarity"]


def _weight(attribute: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, w in WEIGHTS.items():
        out = F.when(attribute == name, F.lit(w)).otherwise(out)
    return out


def evidence_score(preferences: Column, sources: Column, price: Column, lower_bound: Column) -> Column:
    """Sum over groups of the best member: alternatives of a facet count once, features and exclusions each.  Contradictions weigh twice, hard ones a quarter more."""

    def one(p):
        key = F.when((p["polarity"] == 1) & p["alternative_group"].isNotNull(), F.concat_ws("|", p["attribute"], p["alternative_group"])).when((p["attribute"] == "feature") | (p["polarity"] < 0), F.concat_ws(":", p["attribute"], p["value"], p["polarity"].cast("string"))).otherwise(p["attribute"])
        strength = _weight(p["attribute"]) * F.when(p["hard"], 1.25).otherwise(p["confidence"])
        value = held(preference_signal(p, sources, price, lower_bound), lambda s: s * F.when(s < 0, 2.0).otherwise(1.0) * strength)
        return F.struct(key.alias("key"), value.alias("v"))

    def summed(rows):
        best = F.transform(F.array_distinct(F.transform(rows, lambda r: r["key"])), lambda k: F.array_max(F.transform(F.filter(rows, lambda r: r["key"] == k), lambda r: r["v"])))
        return F.aggregate(best, F.lit(0.0), lambda a, x: a + x)

    return held(F.transform(F.filter(preferences, lambda p: p["polarity"] != 0), one), summed)


def contradicts(preferences: Column, sources: Column, price: Column, lower_bound: Column) -> Column:
    """Whether a hard requirement is contradicted; alternatives are one requirement, hard if any of them is, met by its best member."""
    grouped = lambda p: (p["polarity"] == 1) & p["alternative_group"].isNotNull()
    signal = lambda p: preference_signal(p, sources, price, lower_bound)
    alone = F.exists(preferences, lambda p: p["hard"] & (p["polarity"] != 0) & ~grouped(p) & (signal(p) < 0))
    names = F.array_distinct(F.transform(F.filter(preferences, lambda p: grouped(p) & p["hard"]), lambda p: F.concat_ws("|", p["attribute"], p["alternative_group"])))
    group = F.exists(names, lambda k: F.array_max(F.transform(F.filter(preferences, lambda p: grouped(p) & (F.concat_ws("|", p["attribute"], p["alternative_group"]) == k)), signal)) < 0)
    return alone | group


def soft_negatives(preferences: Column, sources: Column, price: Column, lower_bound: Column, weight: float) -> Column:
    """A bounded demotion for exclusions that are not hard."""
    avoided = F.filter(preferences, lambda p: (p["polarity"] == -1) & ~p["hard"])
    return weight * F.aggregate(avoided, F.lit(0.0), lambda a, p: a + F.least(F.lit(0.0), preference_signal(p, sources, price, lower_bound)) * p["confidence"])


def guard(rows: DataFrame, marked: str, *, query: str = "query_id", score: str = "score", penalty: str = "penalty") -> DataFrame:
    """rows with marked candidates shifted below all others of their query by one offset, which column penalty keeps.

    The stored penalty is replaced, not added up; where marks and penalties agree and all marked stand below, nothing changes, so guarding twice is guarding once.
    """
    w = Window.partitionBy(query)
    old = F.coalesce(F.col(penalty), F.lit(0.0)) if penalty in rows.columns else F.lit(0.0)
    hit = F.coalesce(F.col(marked), F.lit(False))
    settled = F.min(((old > 0) == hit).cast("int")).over(w) == 1
    below = F.max(F.when(hit, F.col(score))).over(w) < F.min(F.when(~hit, F.col(score))).over(w)
    keep = settled & F.coalesce(below, F.lit(True))
    base = F.col(score) + old
    shift = F.max(base).over(w) - F.min(base).over(w) + 1
    any_hit = F.max(hit.cast("int")).over(w) == 1
    moved = rows.withColumn("__keep", keep | ~any_hit).withColumn("__base", base).withColumn("__shift", shift)
    now = F.when(F.col("__keep"), old).when(hit, F.col("__shift")).otherwise(0.0)
    done = moved.withColumn("__now", now).withColumn(score, F.when(F.col("__keep"), F.col(score)).otherwise(F.col("__base") - F.col("__now")))
    return done.withColumn(penalty, F.col("__now")).drop("__keep", "__base", "__shift", "__now")


def _named(text: Column, words: str) -> Column:
    return F.regexp_like(F.lower(text), F.lit(rf"(?<!\w)(?:{words})(?!\w)"))


def family(text: Column) -> Column:
    """The product family that a request names; null for none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(FAMILIES.items()):
        out = F.when(_named(text, words.replace(" ", "|")), F.lit(name)).otherwise(out)
    return out


def product_role(title: Column, categories: Column) -> Column:
    """struct(role, fits): object, accessory, component or unknown, and the family that an accessory goes with."""
    text = F.concat_ws(" ", F.lower(categories), F.lower(title))
    part = F.lit(None).cast("string")
    for name, words in reversed(PARTS.items()):
        part = F.when(_named(text, words), F.lit(name)).otherwise(part)
    spare = F.regexp_like(text, F.lit(ACCESSORY))
    role = F.when(part.isNotNull(), F.when(spare | F.contains(text, F.lit("laces")) | F.contains(text, F.lit("insoles")), "component").otherwise("accessory")).when(F.regexp_like(F.lower(categories), F.lit(ACCESSORY)), "accessory").when(family(categories).isNotNull(), "object").otherwise("unknown")
    return F.struct(role.alias("role"), F.coalesce(part, F.when(role == "accessory", family(text))).alias("fits"))


def accessory_mismatch(title: Column, categories: Column, requested: Column) -> Column:
    """Whether an accessory or component stands where its own family was asked for."""
    r = product_role(title, categories)
    return F.coalesce(r["role"].isin("accessory", "component") & (r["fits"] == family(requested)), F.lit(False))


def scoped_evidence(text: Column, value: str, scope: str) -> Column:
    """0.8 where a value stands beside its component, -0.8 where it stands by another one, 0 else."""
    t, v, s = F.lower(F.coalesce(text, F.lit(""))), value.lower(), scope.lower()
    both = F.regexp_like(t, F.lit(rf"(?<!\w){v}(?!\w)")) & F.regexp_like(t, F.lit(rf"(?<!\w){s}(?!\w)"))
    beside = F.regexp_like(t, F.lit(rf"\b{v}\b(?:\s+\w+)?\s+\b{s}\b|\b{s}\b(?:\s+\w+)?\s+\b{v}\b"))
    others = "|".join(o for o in OWNERS if o != s)
    reach = len(v) + 12
    near = F.regexp_like(t, F.lit(rf"(?s)(?<!\w){v}(?!\w)(?=.{{0,12}}(?<!\w)(?:{others})(?!\w))|(?<!\w)(?:{others})(?!\w).{{0,{reach}}}?(?<!\w){v}(?!\w)"))
    return F.when(~both, 0.0).when(beside, 0.8).when(near, -0.8).otherwise(0.0)


def role_evidence(text: Column, wanted: list[tuple[str, str]]) -> Column:
    """0.15 for every wanted (material, role) that a text names side by side, 0.30 at most."""
    hits = sum((F.regexp_like(F.lower(text), F.lit(rf"(?<!\w){m}\s+{r}(?!\w)")).cast("int") for m, r in wanted), F.lit(0))
    return F.least(F.lit(0.30), 0.15 * hits)


def composition_evidence(text: Column, percent: int, material: str) -> Column:
    """0.010 where a text states exactly that share of a material."""
    return F.when(F.regexp_like(F.lower(text), F.lit(rf"(?<!\w){percent}\s*%\s+{material}(?!\w)")), 0.010).otherwise(0.0)


def review_signal(rating: Column, reviews: Column, mode: str, *, saturation: int = 500_000, pseudo: float = 20.0) -> Column:
    """count, raw_stars, stars, mixed or none: catalog-only quality between -1 and 1; missing ratings are neutral."""
    popular = F.least(F.lit(1.0), F.log1p(F.coalesce(reviews, F.lit(0)).cast("double")) / F.log1p(F.lit(float(saturation))))
    raw = F.coalesce(F.when(rating.between(1, 5), (rating - 3) / 2), F.lit(0.0))
    stars = raw * F.coalesce(reviews, F.lit(0)) / (F.coalesce(reviews, F.lit(0)) + pseudo)
    return {"none": F.lit(0.0), "count": popular, "raw_stars": raw, "stars": stars, "mixed": 0.5 * popular + 0.5 * stars}[mode]


def review_prior(rows: DataFrame, mode: str, weight: float, *, query: str = "query_id") -> DataFrame:
    """rows (query, score, penalty, rating, reviews) with score moved by weight * signal; the weight shrinks so that guarded candidates stay below the clean ones."""
    w = Window.partitionBy(query)
    gap = F.min(F.when(F.col("penalty") == 0, F.col("score"))).over(w) - F.max(F.when(F.col("penalty") > 0, F.col("score"))).over(w)
    held = F.when(gap.isNull(), F.lit(weight)).otherwise(F.least(F.lit(weight), F.greatest(F.lit(0.0), gap) * 0.499999))
    return rows.withColumn("__w", held).withColumn("score", F.col("score") + F.col("__w") * review_signal(F.col("rating"), F.col("reviews"), mode)).drop("__w")


def profile_prior(text: Column, tags: Column, weight: float) -> Column:
    """weight * share of a profile's tags that a product's text states."""
    hits = F.size(F.filter(tags, lambda t: signals(text, t)["yes"]))
    return F.when(F.size(tags) > 0, weight * hits / F.size(tags)).otherwise(0.0)


def profile_bonus(weights: Column, learned: Column, closed: Column, cap: float) -> Column:
    """min(cap, sum of 0.35 * confidence * coverage) over learned preferences (attribute, tokens, confidence) whose attribute the session has not closed."""
    open_ = F.filter(learned, lambda p: ~F.array_contains(closed, p["attribute"]) & (F.size(p["tokens"]) > 0))
    total = F.aggregate(open_, F.lit(0.0), lambda a, p: a + 0.35 * p["confidence"] * F.size(F.filter(p["tokens"], lambda t: F.array_contains(weights, t))) / F.size(p["tokens"]))
    return F.least(F.lit(cap), total)


def vector_bonus(similarity: Column, score: Column, best: Column, confident: Column, has_exact: Column, is_exact: Column, *, least: float = 0.616618, most: float = 85 * 0.2 / 61) -> Column:
    """The bounded part of a vector hit: only of a confident search, similar enough, near the best score, and exact where any candidate is."""
    opened = confident & (similarity >= least) & (best - score <= most) & (~has_exact | is_exact)
    return F.when(opened, F.least(F.lit(most), F.greatest(F.lit(0.0), similarity) * most)).otherwise(0.0)
