"""Intent, presentation, comparison and long-term profile queries."""

from pyspark.sql import Window, functions as F

from ..operators import admission, evaluation as ev, intent, presentation as show, simulate
from ..streaming import profile
from .ranking_queries import RANKED, _ranked
from .registry import CATALOG, OUTCOMES, catalog, outcomes, query, table

MESSAGES = [  # message, preferences (attribute, value, polarity, hard), removed, added; and mode, event
    ("I need running shoes under $50", [("category", "shoes", 1, False), ("budget", "<= 50", 1, True), ("use_case", "running", 1, False)], 0, 3, "buying", "continue"),
    ("just exploring ideas for a gift", [], 0, 0, "browsing", "continue"),
    ("I'm flexible, surprise me with boots", [("category", "boots", 1, False)], 0, 1, "mixed", "continue"),
    ("forget the color, maybe something for travel", [("use_case", "travel", 1, False), ("color", "red", -1, True)], 1, 0, "browsing", "relaxation"),
    ("find me a black wool coat", [("category", "coat", 1, False), ("color", "black", 1, False), ("material", "wool", 1, True)], 1, 1, "buying", "override"),
]
PREFERENCE = "array<struct<attribute:string,value:string,polarity:int,hard:boolean>>"


def _messages(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(m).alias("message"), F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value"), F.lit(x).alias("polarity"), F.lit(h).alias("hard")) for a, v, x, h in p]).cast(PREFERENCE).alias("preferences"), F.lit(r).alias("removed"), F.lit(n).alias("added")) for m, p, r, n, _, _ in MESSAGES])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(rows, F.pmod("p_partkey", F.lit(len(MESSAGES))).cast("int")).alias("m")).select("id", "m.*")


@query("""WITH r(i, mode, event, specificity, confidence, action) AS (VALUES (0, 'buying', 'continue', 1.0, 1.0, 'buying'), (1, 'browsing', 'continue', 0.25, 1.0, 'browsing'), (2, 'mixed', 'continue', 0.583333333, 0.1, 'mixed'),
        (3, 'browsing', 'relaxation', 0.583333333, 0.8, 'browsing'), (4, 'buying', 'override', 1.0, 1.0, 'buying'))
    SELECT p_partkey AS id, mode, event, specificity::DOUBLE AS specificity, action FROM part JOIN r ON i = p_partkey % 5""")
def shopping_intent(spark, sf_dir):
    d = intent.shopping_intent(F.col("message"), F.col("preferences"), F.col("removed"), F.col("added"))
    return _messages(spark, sf_dir).withColumn("d", d).select("id", "d.mode", "d.event", "d.specificity", "d.action")


@query("""WITH r(i, mode, reason) AS (VALUES (0, 'buying', 'explicit_requirement'), (1, 'browsing', 'open_ended_start'), (2, 'buying', 'stated_preference'), (3, 'buying', 'specific_evidence'), (4, 'browsing', 'category_only'))
    SELECT p_partkey AS id, mode, reason FROM part JOIN r ON i = p_partkey % 5""")
def search_mode(spark, sf_dir):
    said = [(["category", "override"], "x"), (["category", "clarification"], "I am still exploring"), (["initial_preference"], "x"), (["category", "clarification"], "x"), (["category"], "x")]
    rows = F.array(*[F.struct(F.array(*[F.lit(x) for x in s]).alias("s"), F.lit(m).alias("m")) for s, m in said])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(rows, F.pmod("p_partkey", F.lit(5)).cast("int")).alias("r"))
    return p.withColumn("d", intent.search_mode(F.col("r.s"), F.col("r.m"))).select("id", "d.mode", "d.reason")


@query("""WITH x AS (SELECT p_partkey AS id, (p_size % 10) / 10.0::DOUBLE AS confidence, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 7) / 10.0::DOUBLE END AS overlap, p_size * 5 AS candidates, p_size % 3 AS objects, CASE WHEN p_size % 4 = 0 THEN 0.01::DOUBLE END AS margin FROM part),
    u AS (SELECT id, round(least(1, CASE WHEN confidence < 0.5::DOUBLE THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN overlap < 0.2::DOUBLE THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN candidates >= 150 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN objects = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN margin IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END), 9) AS uncertainty FROM x)
    SELECT id, uncertainty, uncertainty >= 0.5::DOUBLE AS escalate FROM u""")
def compute_escalation(spark, sf_dir):
    s = F.col("p_size")
    d = intent.needs_escalation(s % 10 / F.lit(10.0), F.when(s % 7 != 0, s % 7 / F.lit(10.0)), s * 5, s % 3, F.when(s % 4 == 0, 0.01))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), d.alias("d")).select("id", "d.*")


@query("""SELECT p_partkey AS id, CASE WHEN p_size >= 45 THEN 'retrieve' WHEN p_size % 5 >= 1 THEN 'retrieve' WHEN p_size % 2 = 0 AND p_size > 5 THEN 'retrieve' WHEN p_size % 3 > 0 THEN 'retrieve' ELSE 'clarify_first' END AS action,
    CASE WHEN p_size >= 45 THEN 'final_turn' WHEN p_size % 5 >= 1 THEN 'defer_budget_exhausted' WHEN p_size % 2 = 0 AND p_size > 5 THEN 'productive_answer' WHEN p_size % 3 > 0 THEN 'sufficient_specificity' ELSE 'over_general' END AS reason FROM part""")
def retrieval_sufficiency(spark, sf_dir):
    s = F.col("p_size")
    d = intent.sufficiency(F.when(s >= 45, 10).when(s > 5, 2).otherwise(1), s % 2 == 0, s % 3 == 0, F.lit(0.2), F.lit(False), s % 5, F.lit(2))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), d.alias("d")).select("id", "d.*")


@query("""WITH r(i, must, preferred, budgets, first, second) AS (VALUES (0, '', 'shoes', '<= 50', 'shoes <= 50 running', 'sneakers running shoes <= 50'), (1, '', '', '', NULL, NULL), (2, '', 'boots', '', 'boots', NULL), (3, '', '', '', 'travel', 'bags travel'), (4, 'wool', 'coat;black', '', 'coat black wool', NULL))
    SELECT p_partkey AS id, must, preferred, budgets, first, second FROM part JOIN r ON i = p_partkey % 5""")
def plans_and_hypotheses(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("p", intent.retrieval_plan(F.col("preferences"))).withColumn("h", intent.hypotheses(F.col("p")))
    text = lambda n: F.array_join(f"p.{n}", ";").alias(n)
    return m.select("id", text("must"), text("preferred"), text("budgets"), F.get("h", F.lit(0))["query"].alias("first"), F.get("h", F.lit(1))["query"].alias("second"))


@query("""WITH w(mode, route, weight) AS (VALUES ('buying', 'broad', 0.8), ('buying', 'field_union', 1.0), ('buying', 'factored', 1.2), ('browsing', 'broad', 1.2), ('browsing', 'field_union', 1.0), ('browsing', 'factored', 0.6)),
    r AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, ['broad', 'field_union', 'factored'][l_linenumber % 3 + 1] AS route, l_linenumber AS rank, CASE WHEN l_orderkey % 2 = 0 THEN 'buying' ELSE 'browsing' END AS mode FROM lineitem),
    f AS (SELECT query_id, doc_id, route, mode, min(rank) AS rank FROM r GROUP BY ALL) SELECT query_id, doc_id, round(sum(weight::DOUBLE / (60 + rank)), 9) AS score FROM f JOIN w USING (mode, route) GROUP BY 1, 2""")
def route_plan_fusion(spark, sf_dir):
    """Routes weighted by the mode of their query, fused by reciprocal ranks."""
    from ..operators import fusion

    li = table(spark, sf_dir, "lineitem")
    route = F.get(F.array(F.lit("broad"), F.lit("field_union"), F.lit("factored")), F.col("l_linenumber") % 3)
    rows = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), route.alias("route"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_orderkey") % 2 == 0, "buying").otherwise("browsing").alias("mode"))
    fused = fusion.reciprocal_rank(rows.withColumn("weight", intent.route_weight(F.col("mode"), F.col("route"))))
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"))


def _slates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = (F.floor(F.col("value")).cast("int") % 3) * 4
    ids = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (i + base) % 12)
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), ids.alias("ids"), (F.col("event_type") == "error").alias("reset"))


_SLATES = """sl AS (SELECT user_id AS session_id, event_id AS turn, (floor(value)::INT % 3) * 4 AS base, event_type = 'error' AS reset FROM events),
    sm AS (SELECT *, coalesce(lag(base) OVER w = base AND NOT reset, false) AS same FROM sl WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
    ru AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY session_id ORDER BY turn) AS run FROM sm),
    pa AS (SELECT *, least(2, row_number() OVER (PARTITION BY session_id, run ORDER BY turn) - 1)::INT AS page FROM ru)"""


@query(f"WITH {_SLATES} SELECT session_id, turn, page FROM pa")
def slate_pages(spark, sf_dir):
    return show.page_numbers(_slates(spark, sf_dir), first_turn=0, limit=4).select("session_id", "turn", "page")


@query(f"WITH {_SLATES} SELECT session_id, turn, CASE WHEN page = 0 THEN [base, base + 1, base + 2, base + 3] ELSE list_transform([5, 6, 7, 8], lambda i: (i + base) % 12) END AS slate, CASE WHEN reset OR NOT same THEN 'active_fact_change' WHEN page > 0 THEN 'explicit_rejection' ELSE 'no_explicit_rejection' END AS reason FROM pa")
def slates_past_rejection(spark, sf_dir):
    """Slates of the unseen, where the head and one more were seen, and the reason to move on."""
    p = show.page_numbers(_slates(spark, sf_dir), first_turn=0, limit=4)
    w = Window.partitionBy("session_id").orderBy("turn")
    changed = F.col("reset") | ~F.coalesce(F.lag("ids").over(w) == F.col("ids"), F.lit(False))
    seen, head = F.slice("ids", 1, 5), F.slice("ids", 1, 4)
    r = p.withColumn("changed", changed).withColumn("r", show.after_rejection(F.col("ids"), head, F.col("page") > 0, F.col("changed"), 4))
    return r.select("session_id", "turn", show.unseen_first(F.col("ids"), seen, F.col("page"), 4).alias("slate"), "r.reason")


@query(f"""WITH {RANKED}, s AS (SELECT *, round((size % 4) / 10.0::DOUBLE, 9) AS field_score, size % 2 AS coherence, (categories = 'SMALL')::INT AS leaf, price > 980 AS violation FROM rk)
    SELECT a.query_id, a.field_score = b.field_score AND a.coherence = b.coherence AND a.leaf = b.leaf AS deferred, a.field_score = b.field_score AND a.coherence = b.coherence AND a.leaf = b.leaf AND NOT a.violation AS tentative FROM s a JOIN s b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2""")
def sibling_deferral(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select("query_id", "rank", F.round(F.col("size") % 4 / F.lit(10.0), 9).alias("field_score"), (F.col("size") % 2).alias("coherence"), (F.col("categories") == "SMALL").cast("int").alias("leaf"), F.lit(1).alias("hard_exact"), (F.col("price") > 980).alias("violation"))
    return show.siblings(rows)


@query(f"""WITH {RANKED}, x AS (SELECT query_id, doc_id, rank, price > 960 AS violation, size % 5 = 0 AS rejected FROM rk),
    p AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY violation, rejected, rank) AS place FROM x)
    SELECT 'explicit_rejection' AS policy, * FROM p WHERE place <= 10 UNION ALL SELECT 'tentative_top1', query_id, doc_id, rank FROM x WHERE rank = 1 AND NOT violation UNION ALL SELECT 'raw10', query_id, doc_id, rank FROM x WHERE rank <= 10""")
def presentation_policies(spark, sf_dir):
    x = _ranked(spark, sf_dir).select("query_id", "doc_id", "rank", (F.col("price") > 960).alias("violation"), (F.col("size") % 5 == 0).alias("rejected"))
    out = [show.presented(x, p).select(F.lit(p).alias("policy"), "query_id", "doc_id", "place") for p in ("explicit_rejection", "tentative_top1", "raw10")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {RANKED}, d AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 30 THEN row_number() OVER (PARTITION BY query_id, rank > 30 ORDER BY price > 960, rating DESC, rank) ELSE rank END AS new_rank FROM rk)
    SELECT query_id, doc_id, rank, new_rank FROM d""")
def tiered_prefix_rerank(spark, sf_dir):
    """The first 30 places by tier and logit (rating stands in); a membership change would show as extra rows."""
    ranked = _ranked(spark, sf_dir)
    out = show.rerank_prefix(ranked.withColumn("logit", F.col("rating")), tier=[F.col("price") > 960]).select("query_id", "doc_id", "rank", "new_rank")
    wrong = show.same_members(ranked, out).select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("rank"), F.lit(0).alias("new_rank"))
    return out.unionByName(wrong)


@query(f"""WITH {RANKED}, m AS (SELECT query_id, doc_id, rank, round(score + CASE WHEN size % 6 = 0 THEN 0.5::DOUBLE ELSE 0 END, 9) AS score FROM rk) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM m""")
def field_evidence_deltas(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    return show.apply_deltas(r.select("query_id", "doc_id", "score", "rank"), r.filter("size % 6 = 0").select("query_id", "doc_id", F.lit(0.5).alias("delta")))


@query(f"""WITH {RANKED}, f AS (SELECT query_id, doc_id, rank FROM rk WHERE rank <= 4), h AS (SELECT product_id AS doc_id FROM cat ORDER BY 1 LIMIT 20), q AS (SELECT DISTINCT query_id FROM f),
    e AS (SELECT * FROM f UNION ALL SELECT query_id, doc_id, 1 << 30 FROM q, h WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM f))
    SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS place FROM e) WHERE place <= 10""")
def small_catalog_tail(spark, sf_dir):
    return show.with_tail(_ranked(spark, sf_dir, 4), catalog(spark, sf_dir).select(F.col("product_id").alias("doc_id")), 10)


@query(f"""WITH {RANKED}, p AS (SELECT a.query_id, b.doc_id, (a.categories <> b.categories)::INT AS role_confusion, len(list_intersect(string_split(a.title, ' '), string_split(b.title, ' '))) AS title_overlap, b.size % 3 AS missing FROM rk a JOIN rk b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank > 1)
    SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY role_confusion DESC, title_overlap DESC, missing DESC, doc_id) AS place FROM p) WHERE place <= 4""")
def mined_negatives(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    top = r.filter("rank = 1").select("query_id", F.col("categories").alias("c"), F.col("title").alias("t"))
    p = r.filter("rank > 1").join(top, "query_id").select("query_id", "doc_id", (F.col("c") != F.col("categories")).cast("int").alias("role_confusion"), F.size(F.array_intersect(F.split("t", " "), F.split("title", " "))).alias("title_overlap"), (F.col("size") % 3).alias("missing"))
    return show.hard_negatives(p).select("query_id", "doc_id", "place")


@query(f"""WITH {RANKED}, g AS (SELECT query_id, rank, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap, max(score) OVER w - min(score) OVER w AS spread FROM rk WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, min(rank) FILTER (rank >= 3 AND spread > 0 AND gap >= 0.05::DOUBLE * spread) AS boundary FROM g GROUP BY 1""")
def score_breaks(spark, sf_dir):
    return admission.score_break(_ranked(spark, sf_dir), share=0.05)


@query(f"""WITH {RANKED}, w AS (SELECT query_id, doc_id, rank, 1 / sqrt(rank) AS v FROM rk) SELECT query_id, doc_id, round(v / sum(v) OVER (PARTITION BY query_id), 9) AS p FROM w""")
def rank_prior(spark, sf_dir):
    v = 1 / F.sqrt(F.col("rank"))
    return _ranked(spark, sf_dir).select("query_id", "doc_id", F.round(v / F.sum(v).over(Window.partitionBy("query_id")), 9).alias("p"))


# ---- comparisons of runs


@query("""WITH a AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS x, max(l_extendedprice * (1 - l_discount)) AS y FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc_id) AS rx, row_number() OVER (PARTITION BY query_id ORDER BY y DESC, doc_id) AS ry FROM a),
    q AS (SELECT query_id, max(abs(x - y)) AS d, bool_and(rx = ry) AS same, sum((rx <= 3 AND ry <= 3)::INT) / least(3, count(*)) AS o FROM r GROUP BY 1)
    SELECT count(*) AS queries, round(max(d), 6) AS max_delta, sum(same::INT)::BIGINT AS same_order, round(avg(o), 9) AS overlap_k FROM q""")
def scorer_agreement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"))
    a, b = li.agg(F.max("l_extendedprice").alias("score")), li.agg(F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"))
    return ev.scorer_agreement(a, b, 3).select("queries", F.round("max_delta", 6).alias("max_delta"), "same_order", F.round("overlap_k", 9).alias("overlap_k"))


@query("""SELECT user_id AS sid, event_id AS turn, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'kind' END, CASE WHEN value > 20 THEN 'value' END], lambda x: x IS NOT NULL)) AS field FROM events WHERE event_id % 50 > 0
    UNION ALL SELECT user_id, event_id, 'presence' FROM events WHERE event_id % 50 = 0""")
def run_parity(spark, sf_dir):
    """Field-by-field differences of two runs over the same turns; the second lacks every fiftieth."""
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("turn"), F.col("event_type").alias("kind"), "value")
    b = a.filter("turn % 50 > 0").select("sid", "turn", F.when(F.col("kind") == "error", "fault").otherwise(F.col("kind")).alias("kind"), F.when(F.col("value") > 20, None).otherwise(F.col("value")).alias("value"))
    return ev.run_differences(a, b, ["sid", "turn"], ["kind", "value"])


@query("""WITH e AS (SELECT DISTINCT l_shipyear AS arm, l_orderkey AS case_id, l_linestatus AS value FROM (SELECT *, l_linenumber % 2 AS l_shipyear FROM lineitem)), p AS (SELECT DISTINCT l_linenumber % 2 AS arm, l_orderkey AS case_id, l_linestatus AS value FROM lineitem WHERE l_quantity > 10),
    j AS (SELECT coalesce(e.arm, p.arm) AS arm, e.arm IS NOT NULL AS ee, p.arm IS NOT NULL AS pp FROM e FULL JOIN p ON e.arm = p.arm AND e.case_id = p.case_id AND e.value = p.value)
    SELECT arm, count(*) FILTER (ee AND pp) AS tp, count(*) FILTER (NOT ee) AS fp, count(*) FILTER (NOT pp) AS fn, round(count(*) FILTER (ee AND pp) / count(*) FILTER (ee), 9) AS recall FROM j GROUP BY 1""")
def slot_quality(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2).alias("arm"), F.col("l_orderkey").alias("case_id"), F.lit("status").alias("attribute"), F.col("l_linestatus").alias("value"), "l_quantity")
    return ev.slot_quality(li, li.filter("l_quantity > 10")).select("arm", "tp", "fp", "fn", F.round("recall", 9).alias("recall"))


@query("""SELECT user_id AS dataset, CASE WHEN bool_or(event_type = 'purchase') THEN 'consumed' WHEN bool_or(event_type = 'click') THEN 'attempt_recorded' ELSE 'unknown' END AS status FROM events GROUP BY 1""")
def exposure_audit(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "consumed").when(F.col("event_type") == "click", "attempt").otherwise("other")
    return ev.exposure_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("dataset"), kind.alias("kind")))


@query("""WITH a AS (SELECT l_suppkey AS query_id, l_partkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS ra, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_tax) DESC, l_partkey) AS rb FROM lineitem GROUP BY 1, 2),
    s AS (SELECT query_id, count(*) FILTER (ra <= 20 AND rb <= 20) AS both_n, count(*) FILTER (ra <= 20 OR rb <= 20) AS any_n, count(*) FILTER (ra <= 10 AND rb <= 10) AS top FROM a GROUP BY 1) SELECT query_id, round(both_n / any_n, 9) AS jaccard, round(top / 10, 9) AS overlap FROM s""")
def metamorphic_overlap(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"))
    w = Window.partitionBy("query_id")
    r = g.withColumn("ra", F.row_number().over(w.orderBy(F.desc("q"), "doc_id"))).withColumn("rb", F.row_number().over(w.orderBy(F.desc("t"), "doc_id")))
    return ev.variant_overlap(r, 20, 10).select("query_id", F.round("jaccard", 9).alias("jaccard"), F.round("overlap", 9).alias("overlap"))


@query("""WITH g AS (SELECT l_suppkey AS query_id, l_partkey, sum(l_quantity) AS a, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1, 2)
    SELECT query_id, count(*) AS n, CASE WHEN count(*) > 1 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN round(corr(a, b), 9) END AS pearson FROM g GROUP BY 1""")
def metamorphic_correlation(spark, sf_dir):
    """How far two scores of the same candidates go together, for every query."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.sum("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b"))
    return ev.variant_correlation(g).withColumn("pearson", F.round("pearson", 9))


@query("""WITH r AS (SELECT o_orderpriority AS run, o_orderkey, o_totalprice AS v FROM orders), s AS (SELECT run, v, row_number() OVER (PARTITION BY run ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM r)
    SELECT run, max(n) AS turns, max(v) FILTER (i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(v) FILTER (i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, max(v) AS most FROM s GROUP BY 1""")
def suite_rows(spark, sf_dir):
    """One row a run: turns, latency percentiles and maximum."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_totalprice").alias("v"))
    p = ev.percentile_at(o, "run", "v", {"p50": 0.5, "p95": 0.95})
    return p.join(o.groupBy("run").agg(F.max("v").alias("most")), "run").select("run", F.col("n").alias("turns"), "p50", "p95", "most")


@query(f"""WITH {OUTCOMES}, told AS (SELECT scenario_type, avg(hit::INT) AS hit_rate, avg(reciprocal_rank) AS mrr FROM out GROUP BY 1),
    l AS (SELECT o_orderpriority AS scenario_type, o_orderkey, max(l_returnflag = 'R' AND l_linenumber <= 3) AS hit, max(CASE WHEN l_returnflag = 'R' AND l_linenumber <= 3 THEN 1.0::DOUBLE / (l_suppkey % 10 + 1) ELSE 0 END) AS rr FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    again AS (SELECT scenario_type, avg(coalesce(hit, FALSE)::INT) AS h, avg(coalesce(rr, 0)) AS m FROM l GROUP BY 1)
    SELECT scenario_type, round(hit_rate - h, 5) AS hit_gap, round(mrr - m, 5) AS mrr_gap, abs(hit_rate - h) > 1e-6 OR abs(mrr - m) > 1e-6 AS wrong FROM told JOIN again USING (scenario_type)""")
def reverified_metrics(spark, sf_dir):
    """Told scenario metrics against those of the first three lines alone: what a hit on a later line adds is reported as a gap."""
    told = ev.by_scenario(outcomes(spark, sf_dir)).filter("scenario_type <> 'all'").select("scenario_type", "hit_rate", "mrr")
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_linenumber <= 3")
    first = line.groupBy("l_orderkey").agg(F.max(1 / (F.pmod("l_suppkey", F.lit(10)) + 1)).alias("rr"))
    o = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    again = o.groupBy(F.col("o_orderpriority").alias("scenario_type")).agg(F.avg(F.col("rr").isNotNull().cast("int")).alias("h"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("m"))
    gap = told.join(again, "scenario_type").select("scenario_type", (F.col("hit_rate") - F.col("h")).alias("a"), (F.col("mrr") - F.col("m")).alias("b"))
    return gap.select("scenario_type", F.round("a", 5).alias("hit_gap"), F.round("b", 5).alias("mrr_gap"), ((F.abs("a") > 1e-6) | (F.abs("b") > 1e-6)).alias("wrong"))


_NORMAL = "CASE WHEN {z} < 0 THEN {q} ELSE 1 - {q} END"


def _cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    series = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return _NORMAL.format(z=z, q=f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series})")


@query(f"""WITH s AS (SELECT l_suppkey AS id, count(*) AS n, avg(l_discount - l_tax) AS effect, stddev_samp(l_discount - l_tax) AS deviation FROM lineitem GROUP BY 1), z AS (SELECT *, abs(effect) / (deviation / sqrt(n)) AS z FROM s WHERE n > 1 AND deviation > 0),
    u AS (SELECT *, z - 1.959963984540054::DOUBLE AS a, -z - 1.959963984540054::DOUBLE AS b FROM z) SELECT id, n AS rows, round({_cdf_sql("a")} + {_cdf_sql("b")}, 5) AS power FROM u""")
def power_of_a_test(spark, sf_dir):
    """The power of a paired test of discount against tax with each supplier's lines."""
    d = F.col("l_discount") - F.col("l_tax")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.avg(d).alias("effect"), F.stddev_samp(d).alias("deviation")).filter("rows > 1 AND deviation > 0")
    return s.select("id", "rows", F.round(ev.power_of("effect", "deviation", "rows"), 5).alias("power"))


# ---- profiles and the simulated customer


@query("""WITH o AS (SELECT user_id AS profile_id, event_id AS turn, event_type AS value FROM events WHERE event_type IN ('view', 'click')) SELECT profile_id, value, count(*) AS confirmations, round(least(0.9::DOUBLE, 0.7::DOUBLE + 0.1::DOUBLE * (count(*) - 2)), 6) AS confidence, min(turn) AS first_turn, max(turn) AS latest_turn FROM o GROUP BY 1, 2 HAVING count(*) >= 2""")
def learned_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type IN ('view', 'click')")
    got = profile.learned(e.select(F.col("user_id").alias("profile_id"), F.col("event_id").alias("turn"), F.lit("style").alias("attribute"), F.col("event_type").alias("value"), F.lit("said").alias("kind")))
    return got.select("profile_id", "value", "confirmations", "confidence", "first_turn", "latest_turn")


@query("""WITH p AS (SELECT user_id AS session_id, event_id AS turn, value AS weight FROM events) SELECT session_id, turn, round(weight * pow(0.5::DOUBLE, (max(turn) OVER (PARTITION BY session_id) - turn) / 400.0::DOUBLE), 6) AS weight FROM p""")
def decayed_preferences(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.col("value").alias("weight"))
    return profile.decayed(e, 400.0).withColumn("weight", F.round("weight", 6))


@query("""SELECT p_partkey AS sample_id, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 2 END AS first_hit_turn, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 2 END AS best_rank FROM part""")
def simulated_sessions(spark, sf_dir):
    """Customers who disclose a material when asked: a quarter of them is served at once, a quarter after the answer."""
    p = table(spark, sf_dir, "part")
    sessions = p.select(F.col("p_partkey").alias("sample_id"), F.col("p_partkey").cast("string").alias("target"), F.concat(F.lit("size "), "p_size").alias("message"), F.when(F.col("p_size") % 4 == 1, F.array(F.lit("cotton"))).otherwise(F.array().cast("array<string>")).alias("constraints"), F.array().cast("array<string>").alias("disclosed"))

    def respond(open_, turn):
        at_once = F.col("sample_id").isin([]) if turn > 1 else F.pmod(F.regexp_extract("message", r"(\d+)$", 1).try_cast("int"), F.lit(4)) == 0
        told = F.contains("message", F.lit("cotton"))
        ids = F.when(F.coalesce(at_once, F.lit(False)), F.array("target")).when(told, F.array(F.lit("x"), F.col("target"))).otherwise(F.array(F.lit("x")))
        return open_.select("sample_id", ids.alias("ids"), F.lit("material").alias("ask"))

    return simulate.run(sessions, respond, turns=3)


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'I''m looking for ' || p_name || '. A key requirement is: cotton.' WHEN 1 THEN 'I''m looking for ' || p_name || '. red' ELSE 'I''m looking for ' || p_name || ', but I''m still exploring.' END AS message,
    CASE p_size % 4 WHEN 0 THEN 'material' WHEN 1 THEN 'color' WHEN 2 THEN 'budget' ELSE 'feature' END AS kind FROM part""")
def simulator_wording(spark, sf_dir):
    s = F.col("p_size")
    scenario = F.get(F.array(F.lit("buying"), F.lit("intent_override"), F.lit("browsing")), s % 3)
    text = F.get(F.array(F.lit("soft cotton"), F.lit("navy blue"), F.lit("under 30"), F.lit("warm")), s % 4)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), simulate.opening(scenario, F.col("p_name"), F.lit("cotton"), F.lit("red")).alias("message"), simulate.constraint_kind(text).alias("kind"))
