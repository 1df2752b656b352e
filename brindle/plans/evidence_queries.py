"""Typed evidence, guards and priors over the catalog stand-in."""

from pyspark.sql import Window, functions as F

from ..operators import evidence as e, retrieval as r
from .ranking_queries import RANKED, _ranked
from .registry import query

#: wording that some products have beside their title
WORDING = ["without red", "red-free", "faux leather", "60% cotton lining", "leather upper with strap", "replacement strap", "grey rods"]
PREFERENCES = [("color", "red", 1, False, 0.9, None), ("material", "leather", 1, True, 1.0, "m"), ("material", "cotton", 1, False, 0.8, "m"), ("feature", "gear", -1, True, 1.0, None), ("style", "small", -1, False, 0.7, None), ("budget", "<= 950", 1, True, 1.0, None), ("other", "rod", 1, False, 0.5, None)]


def _items(spark, sf_dir):
    extra = F.array(*[F.lit(w) for w in WORDING])
    said = F.get(extra, (F.col("size") % 7).cast("int"))
    rows = _ranked(spark, sf_dir).withColumn("features", said).withColumn("lower_bound", F.col("size") % 9 == 0)
    sources = F.array(F.struct(F.col("title").alias("text"), F.lit(0.6).alias("confidence")), F.struct(F.col("features").alias("text"), F.lit(0.4).alias("confidence")))
    prefs = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, ("attribute", "value", "polarity", "hard", "confidence", "alternative_group"))]) for p in PREFERENCES]).cast(f"array<{e.PREFERENCE}>")
    return rows.withColumn("sources", sources).withColumn("preferences", prefs)




def _args():
    return F.col("preferences"), F.col("sources"), F.col("price"), F.col("lower_bound")


def _q(x):
    return "NULL" if x is None else str(x) if isinstance(x, (int, float, bool)) else f"'{x}'"


def _variants(v):
    bare = v[:-3] + "y" if v.endswith("ies") else v[:-1] if v.endswith("s") and not v.endswith("ss") else v + "s"
    return f"(?:{v}|{bare})"


_NEG = r"(?:no|not|non|without|faux|imitation|synthetic|avoid(?:s|ing)?|avoidance\s+of)"
ITEMS = f"""{RANKED}, it AS (SELECT *, [{', '.join(map(_q, WORDING))}][size % 7 + 1] AS features, size % 9 = 0 AS lower_bound FROM rk),
    pf(k, attribute, value, polarity, hard, confidence, grp, pat) AS (VALUES {', '.join('(' + ', '.join(map(_q, (i, *p, _variants(p[1])))) + ')' for i, p in enumerate(PREFERENCES))}),
    sr AS (SELECT query_id, doc_id, lower(title) AS t, 0.6::DOUBLE AS c FROM it UNION ALL SELECT query_id, doc_id, lower(features), 0.4::DOUBLE FROM it),
    ct AS (SELECT query_id, doc_id, k, c, len(regexp_extract_all(t, '\\b' || pat || '\\b')) AS n, len(regexp_extract_all(t, '\\b{_NEG}\\s*[- ]?' || pat || '\\b|\\b' || pat || '[- ]free\\b')) AS d FROM sr, pf WHERE attribute <> 'budget'),
    bs AS (SELECT query_id, doc_id, k, coalesce(max(c) FILTER (n > d), 0) AS y, coalesce(max(c) FILTER (d > 0), 0) AS x FROM ct GROUP BY 1, 2, 3),
    sg AS (SELECT b.query_id, b.doc_id, pf.*, CASE WHEN y > 0 AND x > 0 THEN 0 ELSE y - x END * polarity AS s FROM bs b JOIN pf USING (k)
           UNION ALL SELECT query_id, doc_id, pf.*, CASE WHEN price > 950 THEN -1 WHEN lower_bound THEN 0 ELSE 1 END FROM it, pf WHERE attribute = 'budget')"""
_W = "CASE attribute WHEN 'material' THEN 0.65::DOUBLE WHEN 'color' THEN 0.55::DOUBLE WHEN 'style' THEN 0.45::DOUBLE WHEN 'feature' THEN 0.65::DOUBLE WHEN 'budget' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END"
_KEY = "CASE WHEN polarity = 1 AND grp IS NOT NULL THEN attribute || '|' || grp WHEN attribute = 'feature' OR polarity < 0 THEN attribute || value || polarity ELSE attribute END"
SCORES = f"""{ITEMS}, ev AS (SELECT query_id, doc_id, sum(v) AS evidence FROM (SELECT query_id, doc_id, {_KEY} AS g, max({_W} * s * CASE WHEN hard THEN 1.25::DOUBLE ELSE confidence END * CASE WHEN s < 0 THEN 2 ELSE 1 END) AS v FROM sg GROUP BY ALL) GROUP BY 1, 2),
    hd AS (SELECT query_id, doc_id, bool_or(best < 0) AS bad FROM (SELECT query_id, doc_id, CASE WHEN polarity = 1 AND grp IS NOT NULL THEN grp ELSE k::VARCHAR END AS g, max(s) AS best, bool_or(hard) AS hard FROM sg GROUP BY ALL) WHERE hard GROUP BY 1, 2),
    gd AS (SELECT query_id, doc_id, rank, rating, reviews, score - CASE WHEN bad THEN max(score) OVER w - min(score) OVER w + 1 ELSE 0 END AS score, CASE WHEN bad THEN max(score) OVER w - min(score) OVER w + 1 ELSE 0 END AS penalty
           FROM it JOIN hd USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id))"""


@query(f"WITH {ITEMS} SELECT query_id, doc_id, attribute, value, round(s, 9) AS signal FROM sg")
def preference_evidence(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("p", F.explode("preferences"))
    signal = e.preference_signal(F.col("p"), F.col("sources"), F.col("price"), F.col("lower_bound"))
    return rows.select("query_id", "doc_id", "p.attribute", "p.value", F.round(signal, 9).alias("signal"))


@query(f"WITH {SCORES} SELECT * FROM (SELECT query_id, doc_id, round(score + evidence, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score + evidence, 9) DESC, doc_id) AS rank FROM it JOIN ev USING (query_id, doc_id)) WHERE rank <= 20")
def evidence_ranking(spark, sf_dir):
    scored = _items(spark, sf_dir).select("query_id", "doc_id", F.round(F.col("score") + e.evidence_score(*_args()), 9).alias("score"))
    return r.top_k(scored, 20)


@query(f"WITH {SCORES} SELECT query_id, doc_id, bad AS contradicted FROM hd")
def hard_contradictions(spark, sf_dir):
    return _items(spark, sf_dir).select("query_id", "doc_id", e.contradicts(*_args()).alias("contradicted"))


def _guarded(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("bad", e.contradicts(*_args()))
    return e.guard(rows, "bad")


@query(f"WITH {SCORES} SELECT query_id, doc_id, round(score, 9) AS score, round(penalty, 9) AS penalty FROM gd")
def guard_is_idempotent(spark, sf_dir):
    """The hard-constraint guard applied twice."""
    return e.guard(_guarded(spark, sf_dir), "bad").select("query_id", "doc_id", F.round("score", 9).alias("score"), F.round("penalty", 9).alias("penalty"))


@query(f"""WITH {SCORES}, wt AS (SELECT *, CASE WHEN gap IS NULL THEN 0.3::DOUBLE ELSE least(0.3::DOUBLE, greatest(0, gap) * 0.499999::DOUBLE) END AS w
        FROM (SELECT *, min(score) FILTER (penalty = 0) OVER (PARTITION BY query_id) - max(score) FILTER (penalty > 0) OVER (PARTITION BY query_id) AS gap FROM gd)),
    sn AS (SELECT *, least(1, ln(1 + reviews) / ln(500001)) AS popular, CASE WHEN rating BETWEEN 1 AND 5 THEN (rating - 3) / 2 ELSE 0 END AS raw FROM wt)
    SELECT query_id, doc_id, round(score + w * popular, 9) AS by_count, round(score + w * raw, 9) AS by_raw_stars, round(score + w * raw * reviews / (reviews + 20), 9) AS by_stars, round(score + w * (0.5::DOUBLE * popular + 0.5::DOUBLE * raw * reviews / (reviews + 20)), 9) AS by_mixed FROM sn""")
def review_prior_modes(spark, sf_dir):
    g = _guarded(spark, sf_dir).select("query_id", "doc_id", "score", "penalty", "rating", "reviews")
    out = g.select("query_id", "doc_id")
    for mode in ("count", "raw_stars", "stars", "mixed"):
        out = out.join(e.review_prior(g, mode, 0.3).select("query_id", "doc_id", F.round("score", 9).alias(f"by_{mode}")), ["query_id", "doc_id"])
    return out


@query(f"WITH {ITEMS} SELECT query_id, doc_id, round(score + coalesce(0.2::DOUBLE * sum(least(0, s) * confidence) FILTER (polarity = -1 AND NOT hard), 0), 9) AS score FROM it JOIN sg USING (query_id, doc_id) GROUP BY query_id, doc_id, score")
def soft_exclusions(spark, sf_dir):
    return _items(spark, sf_dir).select("query_id", "doc_id", F.round(F.col("score") + e.soft_negatives(*_args(), 0.2), 9).alias("score"))


_BUDGETS = ["<= 950", ">= 910", "905 920", "about 930", "none"]


@query(f"""WITH {ITEMS}, b(value, low, high, target, scale) AS (VALUES ('<= 950', 0, 950, 950, 950), ('>= 910', 910, NULL, 910, 910), ('905 920', 905, 920, 912.5, 912.5), ('about 930', 0, 930, 930, 930), ('none', NULL, NULL, NULL, NULL))
    SELECT query_id, doc_id, value, (CASE WHEN low IS NULL THEN 0 WHEN price > high THEN -1 WHEN lower_bound THEN CASE WHEN high IS NULL AND price >= low THEN 1 ELSE 0 END WHEN price >= low THEN 1 ELSE -1 END)::DOUBLE AS firm,
           round(CASE WHEN target IS NULL OR lower_bound THEN 0 ELSE greatest(-1, 1 - 2 * abs(price - target) / scale) END::DOUBLE, 9) AS soft FROM it, b""")
def budget_evidence_modes(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("value", F.explode(F.array(*[F.lit(b) for b in _BUDGETS])))
    firm, soft = (f(F.col("price"), F.col("lower_bound"), F.col("value")) for f in (e.budget_evidence, e.soft_budget))
    return rows.select("query_id", "doc_id", "value", firm.alias("firm"), F.round(soft, 9).alias("soft"))


@query(f"""WITH {ITEMS}, ro AS (SELECT *, lower(categories || ' ' || title || ' ' || features) AS t, regexp_matches(lower(title), '\\bring\\b') AS ring FROM it)
    SELECT query_id, doc_id, CASE WHEN t LIKE '%replacement strap%' THEN 'component' WHEN ring THEN 'object' ELSE 'unknown' END AS role, CASE WHEN t LIKE '%replacement strap%' THEN 'bag' END AS fits, t LIKE '%replacement strap%' AS mismatch FROM ro""")
def product_roles(spark, sf_dir):
    """Products by role, with the noun of the title as their category, for a request that names a bag."""
    rows = _items(spark, sf_dir)
    title, noun = F.concat_ws(" ", "title", "features"), F.element_at(F.split("title", " "), -1)
    role = e.product_role(title, noun)
    return rows.select("query_id", "doc_id", role["role"].alias("role"), role["fits"].alias("fits"), e.accessory_mismatch(title, noun, F.lit("a large tote")).alias("mismatch"))


@query(f"""WITH {ITEMS} SELECT query_id, doc_id, (CASE features WHEN '60% cotton lining' THEN 0.8 ELSE 0 END)::DOUBLE AS cotton_lining, (CASE features WHEN 'leather upper with strap' THEN 0.8 ELSE 0 END)::DOUBLE AS leather_upper,
    (CASE features WHEN '60% cotton lining' THEN -0.8 ELSE 0 END)::DOUBLE AS cotton_zipper, (CASE features WHEN 'leather upper with strap' THEN 0.15 ELSE 0 END)::DOUBLE AS role_score, (CASE features WHEN '60% cotton lining' THEN 0.01 ELSE 0 END)::DOUBLE AS composition FROM it""")
def component_evidence(spark, sf_dir):
    text = F.col("features")
    far = F.regexp_replace(text, "with strap", "of that kind, with strap")
    return _items(spark, sf_dir).select("query_id", "doc_id", e.scoped_evidence(text, "cotton", "lining").alias("cotton_lining"), e.scoped_evidence(text, "leather", "upper").alias("leather_upper"), e.scoped_evidence(F.concat(text, F.lit(" and a long zipper")), "cotton", "zipper").alias("cotton_zipper"), e.role_evidence(far, [("leather", "upper"), ("cotton", "shell")]).alias("role_score"), e.composition_evidence(text, 60, "cotton").alias("composition"))


@query(f"""WITH {ITEMS} SELECT query_id, doc_id, round(0.06::DOUBLE * (regexp_matches(title, '\\bred\\b')::INT + regexp_matches(title, '\\bgears?\\b')::INT + regexp_matches(title, '\\bsmalls?\\b')::INT) / 3, 9) AS prior,
    round(least(0.4::DOUBLE, 0.35::DOUBLE * (0.9::DOUBLE * regexp_matches(title, '\\bred\\b')::INT + 0.8::DOUBLE * (regexp_matches(title, '\\bsmall\\b')::INT + regexp_matches(title, '\\bgear\\b')::INT) / 2)), 9) AS bonus FROM it""")
def profile_priors(spark, sf_dir):
    """A profile's tags, and its learned preferences beside a session that has closed the material."""
    tags = F.array(F.lit("red"), F.lit("gear"), F.lit("small"))
    learned = F.array(*[F.struct(F.lit(a).alias("attribute"), F.array(*[F.lit(t) for t in ts]).alias("tokens"), F.lit(c).alias("confidence")) for a, ts, c in (("color", ["red"], 0.9), ("style", ["small", "gear"], 0.8), ("material", ["ring"], 0.9))])
    bonus = e.profile_bonus(F.split("title", " "), learned, F.array(F.lit("material")), 0.4)
    return _items(spark, sf_dir).select("query_id", "doc_id", F.round(e.profile_prior(F.col("title"), tags, 0.06), 9).alias("prior"), F.round(bonus, 9).alias("bonus"))


@query(f"""WITH {RANKED}, x AS (SELECT query_id, doc_id, score, (size % 100) / 60.0::DOUBLE AS sim, max(score) OVER (PARTITION BY query_id) AS best, size % 4 = 0 AS exact, bool_or(size % 4 = 0) OVER (PARTITION BY query_id) AS any_exact, query_id LIKE '%1%' AS sure FROM rk)
    SELECT query_id, doc_id, round(CASE WHEN sure AND sim >= 0.616618::DOUBLE AND best - score <= 85 * 0.2::DOUBLE / 61 AND (NOT any_exact OR exact) THEN least(85 * 0.2::DOUBLE / 61, sim * 85 * 0.2::DOUBLE / 61) ELSE 0 END, 9) AS bonus FROM x""")
def vector_contribution(spark, sf_dir):
    """The four gates of a vector hit, on stand-in similarities."""
    w = Window.partitionBy("query_id")
    exact = F.col("size") % 4 == 0
    rows = _ranked(spark, sf_dir).withColumn("best", F.max("score").over(w)).withColumn("any_exact", F.max(exact.cast("int")).over(w) == 1)
    bonus = e.vector_bonus(F.col("size") % 100 / F.lit(60.0), F.col("score"), F.col("best"), F.contains("query_id", F.lit("1")), F.col("any_exact"), exact)
    return rows.select("query_id", "doc_id", F.round(bonus, 9).alias("bonus"))
