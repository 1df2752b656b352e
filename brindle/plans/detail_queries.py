"""Phrases, turns, questions and gates over the driver's tables."""

from pyspark.sql import Window, functions as F

from ..operators import evaluation as ev, learning, packs, phrases, policy, turns
from .ranking_queries import RANKED, _ranked
from .registry import catalog, query, table, terms_sql
from ..functions.text import terms

EVIDENCE = [(["red", "gear"], 3.8, 1, "hard_constraint", 0), (["gear"], 2.0, 2, "clarification", 1), (["small"], 2.5, 2, "clarification", 2), (["large"], 2.5, 2, "clarification", 2), (["old", "ring"], 3.0, 3, "exclusion", 3), (["rod"], 1.4, 1, "category", 4)]


def _evidence():
    return F.array(*[F.struct(F.array(*[F.lit(t) for t in ts]).alias("tokens"), F.lit(w).alias("weight"), F.lit(n).alias("turn"), F.lit(s).alias("source"), F.lit(g).alias("grp")) for ts, w, n, s, g in EVIDENCE])


def _products(spark, sf_dir):
    words = F.split("title", " ")
    return _ranked(spark, sf_dir).withColumn("evidence", _evidence()).withColumn("words", words).withColumn("fields", F.array(words, F.array(F.lower("categories"))))


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest([{{'t': w[1:3], 'n': 1}}, {{'t': w[2:8], 'n': 2}}, {{'t': w[1:16], 'n': 3}}, {{'t': w[1:1], 'n': 4}}, {{'t': w[4:6], 'n': 5}}]) AS e FROM (SELECT item_id, {terms_sql('text')} AS w FROM benchmark)),
    r AS (SELECT query_id, array_to_string(e.t[1:14], ' ') AS p, row_number() OVER (PARTITION BY query_id ORDER BY len(list_distinct(e.t)) DESC, e.n % 3 DESC, e.n DESC, array_to_string(e.t, ' ')) AS i FROM q WHERE len(e.t) > 0)
    SELECT query_id, list(p ORDER BY i) AS phrases FROM r WHERE i <= 4 GROUP BY 1""")
def phrase_expressions(spark, sf_dir):
    w = terms("text")
    parts = F.array(*[F.struct(F.slice(w, a, n).alias("tokens"), F.lit(i).alias("turn")) for i, (a, n) in enumerate(((1, 3), (2, 7), (1, 16), (1, 1), (4, 3)), 1)])
    e = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(parts).alias("e")).select("query_id", "e.*").withColumn("weight", F.col("turn") % 3)
    return phrases.chunks(e)


@query(f"""WITH {RANKED}, x AS (SELECT query_id, doc_id, title, string_split(title, ' ') || [lower(categories)] AS w FROM rk),
    c AS (SELECT query_id, doc_id, CASE WHEN list_contains(w, 'small') THEN 'small' WHEN list_contains(w, 'large') THEN 'large' ELSE 'small' END AS size_branch, w, title FROM x)
    SELECT query_id, doc_id, size_branch, false AS one_block FROM c""")
def alternatives_resolved(spark, sf_dir):
    """Small or large: the branch that each product supports; and whether all chunks stand in one block of its title."""
    p = _products(spark, sf_dir)
    best = F.filter(phrases.resolved(F.col("evidence"), F.col("fields")), lambda e: e["grp"] == 2)[0]["tokens"][0]
    return p.select("query_id", "doc_id", best.alias("size_branch"), phrases.in_one_block(F.col("evidence"), F.col("title")).alias("one_block"))


@query(f"""WITH {RANKED}, t AS (SELECT query_id, unnest(list_distinct(string_split(title, ' '))) AS token FROM rk), n AS (SELECT query_id, count(*) AS n FROM rk GROUP BY 1), d AS (SELECT query_id, token, ln(1 + any_value(n) / count(*)) AS r FROM t JOIN n USING (query_id) GROUP BY 1, 2),
    m AS (SELECT query_id, coalesce(max(r) FILTER (token = 'red'), 0) AS red, coalesce(max(r) FILTER (token = 'gear'), 0) AS gear, coalesce(max(r) FILTER (token = 'small'), 0) AS small, coalesce(max(r) FILTER (token = 'large'), 0) AS large FROM d GROUP BY 1)
    SELECT query_id, doc_id, round((title = 'red gear')::INT * (red + gear) / 2 * (1 + 2 / 8) + (title LIKE 'small %' OR categories = 'SMALL')::INT * small * (1 + 1 / 8) + (title LIKE 'large %' OR categories = 'LARGE')::INT * large * (1 + 1 / 8), 9) AS field_score,
        round(((title = 'red gear')::INT + (title LIKE 'small %')::INT + (title LIKE 'large %')::INT) / 3, 9) AS coherence, (title LIKE '% rod')::INT + (title = 'old rod')::INT AS leaf FROM rk JOIN m USING (query_id)""")
def catalog_tie_break(spark, sf_dir):
    p = _products(spark, sf_dir)
    r = phrases.rarity(p.select("query_id", F.col("words").alias("tokens")))
    t = phrases.tie_break(F.col("evidence"), F.col("fields"), F.col("words"), F.col("rarity"), F.col("words"), F.array(F.lit("old"), F.lit("rod")))
    return p.join(r, "query_id").select("query_id", "doc_id", t.alias("t")).select("query_id", "doc_id", "t.*")


@query(f"""WITH d AS (SELECT doc_id, {terms_sql('text')} AS w FROM documents), n AS (SELECT count(*) AS n FROM documents), q AS (SELECT item_id AS query_id, array_to_string({terms_sql('text')}[1:2], ' ') AS p, len({terms_sql('text')}[1:2]) AS k FROM benchmark),
    h AS (SELECT query_id, p, doc_id FROM q JOIN d ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' ') WHERE k >= 2), c AS (SELECT query_id, p, count(*) AS docs FROM h GROUP BY 1, 2),
    s AS (SELECT query_id, doc_id, 'text' AS field, round(0.08::DOUBLE * ln(1 + n / docs) / ln(1 + n), 9) AS bonus FROM h JOIN c USING (query_id, p), n WHERE docs <= least(64, greatest(1, floor(0.01::DOUBLE * n))))
    SELECT query_id, doc_id, field, bonus FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bonus DESC, doc_id) AS i FROM s) WHERE i <= 32""")
def rare_phrases(spark, sf_dir):
    """Documents admitted by the first two terms of a benchmark item, where few hold them."""
    d = table(spark, sf_dir, "documents")
    n = d.count()
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(terms("text"), 1, 2).alias("phrase"))
    return phrases.rare_phrase_admission(q, d.select("doc_id", F.lit("text").alias("field"), terms("text").alias("tokens")), n)


@query("""SELECT p_partkey AS id, p_size % 3 = 0 AS part_for FROM part""")
def replacement_parts(spark, sf_dir):
    title = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Replacement strap for "), "p_name")).otherwise(F.concat("p_name", F.lit(" with a strap")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), phrases.replacement_part(title, F.lit("a tote bag")).alias("part_for"))


_FACTS = """f AS (SELECT user_id AS session_id, event_id AS turn, list_sort(list_distinct(['category=' || (floor(value)::INT % 2), 'type=' || event_type] || CASE WHEN value > 8 THEN ['large=yes'] ELSE [] END)) AS facts FROM events)"""


@query(f"""WITH {_FACTS}, b AS (SELECT *, coalesce(lag(facts) OVER (PARTITION BY session_id ORDER BY turn), []) AS before FROM f),
    d AS (SELECT session_id, turn, list_sort(list_filter(facts, lambda x: NOT list_contains(before, x))) AS added, list_sort(list_filter(before, lambda x: NOT list_contains(facts, x))) AS removed, len(list_intersect(facts, before)) AS kept FROM b),
    k AS (SELECT *, list_intersect(list_transform(added, lambda x: split_part(x, '=', 1)), list_transform(removed, lambda x: split_part(x, '=', 1))) AS n FROM d)
    SELECT session_id, turn, len(added) AS added, len(removed) AS removed, kept, CASE WHEN list_contains(n, 'category') THEN 'category_change' WHEN len(n) > 0 THEN 'replacement' WHEN len(added) > 0 THEN 'addition' WHEN len(removed) > 0 THEN 'removal' ELSE 'none' END AS kind FROM k""")
def state_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = F.array(F.concat(F.lit("category="), (F.floor("value").cast("int") % 2).cast("string")), F.concat(F.lit("type="), "event_type"))
    facts = F.array_sort(F.when(F.col("value") > 8, F.concat(base, F.array(F.lit("large=yes")))).otherwise(base))
    c = turns.fact_changes(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), facts.alias("facts")))
    return c.select("session_id", "turn", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"), F.size("kept").cast("long").alias("kept"), "kind")


@query("""SELECT o_orderkey AS session_id, o_custkey AS ordinal, CASE o_orderstatus WHEN 'F' THEN 'color' ELSE 'other' END AS attribute, lower(o_orderpriority) AS value, o_orderstatus <> 'O' AS hard, CASE o_orderstatus WHEN 'P' THEN -1 ELSE 1 END AS polarity, o_totalprice <= 150000 AS active FROM orders""")
def typed_projection(spark, sf_dir):
    s = F.col("o_orderstatus")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("ordinal"), F.col("o_orderpriority").alias("text"), F.when(s == "F", "color").alias("attribute"), F.when(s == "F", "override").when(s == "P", "exclusion").otherwise("clarification").alias("source"), (F.col("o_totalprice") > 150000).alias("retired"))
    return turns.typed(e)


@query("""WITH r AS (SELECT event_id AS seq, user_id AS session_id, event_id // 3 AS turn, event_type AS message FROM events), w AS (SELECT *, max(turn) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest, row_number() OVER (PARTITION BY session_id, turn, message ORDER BY seq) AS nth FROM r)
    SELECT session_id, seq, CASE WHEN latest IS NULL OR turn > latest THEN 'computed' WHEN nth > 1 AND turn = latest THEN 'cached' ELSE 'rejected' END AS outcome FROM w""")
def retried_turns(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 3).alias("turn"), F.col("event_type").alias("message"), F.lit(10).alias("top_k"), F.lit("v1").alias("runtime"))
    return turns.answered(r).select("session_id", "seq", "outcome")


@query(f"""WITH {RANKED}, t AS (SELECT query_id, list(doc_id::VARCHAR ORDER BY rank) AS top, list_distinct(flatten(list(string_split(title, ' ')))) AS seen FROM rk WHERE rank <= 10 GROUP BY 1)
    SELECT query_id, sha256(array_to_string(top, ',')) AS receipt, len(top) AS shown, 3 AS n_evidence, list_filter(['gear', 'red', 'zinc'], lambda x: NOT list_contains(seen, x)) AS unmet FROM t""")
def turn_receipts(spark, sf_dir):
    r = _ranked(spark, sf_dir).withColumn("tokens", F.split("title", " "))
    e = r.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("red"), F.lit("gear"), F.lit("zinc"))).alias("text")).withColumn("tokens", F.array("text"))
    got = turns.receipts(r, e)
    return got.select("query_id", "receipt", F.size("top").cast("long").alias("shown"), F.col("n_evidence").cast("int").alias("n_evidence"), "unmet")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 30 WHEN 0.02::DOUBLE * p_size >= 0.8::DOUBLE THEN 0 ELSE greatest(0, least(30, floor((0.8::DOUBLE - 0.02::DOUBLE * p_size + 1e-9) / 0.05::DOUBLE)))::INT END AS candidates FROM part""")
def affordable_prefix(spark, sf_dir):
    cost = F.when(F.col("p_size") % 5 != 0, F.lit(0.05))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), turns.affordable(30, F.lit(0.8), 0.02 * F.col("p_size"), cost).cast("int").alias("candidates"))


@query(f"""WITH {RANKED} SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM rk WHERE size % 3 <> 0) WHERE i <= 12""")
def rerank_frontier(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    return turns.frontier(r, r.filter("size % 3 = 0"), 12)


_ANSWERS = f"""WITH {RANKED}, a AS (SELECT query_id, rank, 'noun' AS attribute, [string_split(title, ' ')[2]] AS answers FROM rk UNION ALL SELECT query_id, rank, 'size', CASE size % 4 WHEN 0 THEN [] WHEN 1 THEN ['s', 'm'] ELSE ['l'] END FROM rk)"""


def _answers(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    size = F.when(F.col("size") % 4 == 0, F.array().cast("array<string>")).when(F.col("size") % 4 == 1, F.array(F.lit("s"), F.lit("m"))).otherwise(F.array(F.lit("l")))
    noun = r.select("query_id", "rank", F.lit("noun").alias("attribute"), F.array(F.element_at(F.split("title", " "), -1)).alias("answers"))
    return noun.unionByName(r.select("query_id", "rank", F.lit("size").alias("attribute"), size.alias("answers")))


@query(f"""{_ANSWERS}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id, attribute) AS n FROM a), m AS (SELECT query_id, attribute, answer, sum(1 / n / greatest(len(answers), 1)) AS m FROM (SELECT *, unnest(CASE WHEN len(answers) = 0 THEN [NULL] ELSE answers END) AS answer FROM n) GROUP BY 1, 2, 3)
    SELECT query_id, attribute, round(greatest(0, -sum(m * log2(m))), 9) AS entropy, round(coalesce(sum(m) FILTER (answer IS NULL), 0), 9) AS unknown FROM m GROUP BY 1, 2""")
def answer_entropy(spark, sf_dir):
    return policy.answer_entropy(_answers(spark, sf_dir))


@query(f"""{_ANSWERS}, t AS (SELECT * FROM a WHERE rank <= 30), n AS (SELECT query_id, attribute, count(*) AS n, count(*) FILTER (len(answers) > 0) AS present FROM t GROUP BY 1, 2),
    g AS (SELECT query_id, attribute, x, count(*) AS c FROM (SELECT query_id, attribute, unnest(answers) AS x FROM t) GROUP BY 1, 2, 3), l AS (SELECT query_id, attribute, list(c ORDER BY c DESC) AS cs FROM g GROUP BY 1, 2),
    s AS (SELECT query_id, attribute, round(present / n * (1 - cs[1] / present), 9) AS v FROM n JOIN l USING (query_id, attribute) WHERE present / n >= 0.6::DOUBLE AND len(cs) >= 2 AND cs[2] / n >= 0.15::DOUBLE AND cs[1] / present <= 0.75::DOUBLE)
    SELECT query_id, attribute FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, attribute DESC) AS i FROM s) WHERE i = 1""")
def discriminating_attribute(spark, sf_dir):
    return policy.discriminating(_answers(spark, sf_dir))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Which color would you prefer? For example: ' || array_to_string(string_split(p_name, ' '), ', ') || '.' WHEN 1 THEN 'What price range would you like to stay within?' ELSE 'What other feature or requirement matters most to you?' END AS question FROM part""")
def question_wording(spark, sf_dir):
    s = F.col("p_size") % 3
    attribute = F.when(s == 0, "color").when(s == 1, "budget").otherwise("weather")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), policy.question_text(attribute, F.when(s == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))).alias("question"))


@query("""WITH r AS (SELECT l_orderkey AS g, (l_returnflag = 'R')::INT AS label, l_discount, l_tax, l_quantity / 50 AS q FROM lineitem), s(setting, a, b, c) AS (VALUES (0, 1.0, 0.0, 0.0), (1, 5.0, 5.0, 0.0), (2, 0.0, 0.0, 0.8), (3, 2.0, 2.0, 0.3))
    SELECT setting, round(avg(((a * l_discount + b * l_tax + c * q > 0.5)::INT = label)::INT), 9) AS accuracy FROM r, s GROUP BY 1""")
def rule_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 50).alias("c"))
    grid = [{"a": 1.0, "b": 0.0, "c": 0.0}, {"a": 5.0, "b": 5.0, "c": 0.0}, {"a": 0.0, "b": 0.0, "c": 0.8}, {"a": 2.0, "b": 2.0, "c": 0.3}]
    return ev.rule_search(rows, grid).select("setting", "accuracy")


@query("""WITH g AS (SELECT o_orderstatus AS model, avg(o_totalprice) AS score, max(o_custkey) AS pairs, max(o_orderkey) AS assets FROM orders GROUP BY 1) SELECT model, round(score, 4) AS score, round(score - (SELECT score FROM g WHERE model = 'O'), 4) AS delta, pairs, assets FROM g""")
def model_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_totalprice").alias("score"), F.col("o_custkey").alias("pairs"), F.col("o_orderkey").alias("assets"))
    return ev.model_comparison(o, "O").withColumn("score", F.round("score", 4)).withColumn("delta", F.round("delta", 4))


@query("""WITH c AS (SELECT l_shipmode AS g, ok FROM (SELECT l_linenumber AS l_shipmode, CASE WHEN l_quantity = 25 THEN NULL ELSE l_quantity > l_linenumber END AS ok FROM lineitem))
    SELECT g AS "group", count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS unknown, bool_and(coalesce(ok, false)) AS all_passed FROM c GROUP BY 1""")
def check_tallies(spark, sf_dir):
    ok = F.when(F.col("l_quantity") != 25, F.col("l_quantity") > F.col("l_linenumber"))
    return ev.check_tallies(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("group"), ok.alias("ok")))


@query("""SELECT c_custkey AS run, list_filter([CASE WHEN NOT c_acctbal >= 0 THEN 'c_acctbal' END, CASE WHEN NOT c_nationkey <= 20 THEN 'c_nationkey' END], lambda x: x IS NOT NULL) AS broken, c_acctbal >= 0 AND c_nationkey <= 20 AS admitted FROM customer""")
def acceptance_gates(spark, sf_dir):
    g = ev.gates(table(spark, sf_dir, "customer"), {"c_acctbal": 0.0}, {"c_nationkey": 20})
    return g.select(F.col("c_custkey").alias("run"), "broken", "admitted")


_HASH = "sha256(concat_ws(chr(0), '{seed}', {x}::VARCHAR))"


@query(f"""WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, {_HASH.format(seed='s1', x='o_orderkey')}) AS s FROM orders GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_HASH.format(seed='s1', x='o_custkey')}) AS i FROM f)
    SELECT o_orderkey, CASE WHEN i <= CASE s WHEN 'F' THEN 100 WHEN 'O' THEN 50 ELSE 0 END THEN 'validation' ELSE 'train' END AS split FROM orders JOIN p USING (o_custkey)""")
def stratified_split(spark, sf_dir):
    """Customers' orders dealt whole to two splits, with quotas by status."""
    o = table(spark, sf_dir, "orders")
    return packs.stratified_split(o, "o_orderkey", "o_orderstatus", {"F": 100, "O": 50}, "s1", group="o_custkey").select("o_orderkey", "split")


@query(f"""WITH p AS (SELECT p_partkey AS id, p_brand AS bucket, row_number() OVER (PARTITION BY p_brand ORDER BY {_HASH.format(seed='u', x='p_partkey')}) AS ordinal FROM part) SELECT id, bucket, ['buying', 'browsing', 'override'][(ordinal - 1) % 3 + 1] AS scenario, ordinal FROM p WHERE ordinal <= 7""")
def unseen_sessions(spark, sf_dir):
    got = packs.unseen_sessions(table(spark, sf_dir, "part"), "p_partkey", "p_brand", 7, ("buying", "browsing", "override"), "u")
    return got


@query()
def intent_training(spark, sf_dir):
    """A multinomial classifier of event types by hour, value and user, as accuracy on a hash-dealt fold."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("group"), F.hour("ts").cast("double").alias("hour"), "value", (F.col("user_id") % 7).cast("double").alias("kind"))
    return learning.intent_model(e, ["hour", "value", "kind"], "label", "group")
