"""Question values, rendered documents, evidence by view, and rule weights by coordinate search."""

from pyspark.sql import Window, functions as F

from ..functions.dealing import spread
from ..operators import admission, evaluation as ev, outcomes, render, views
from .registry import query, table

# ---- questions by what their answers would change

_POOL = """pl AS (SELECT * FROM (SELECT p_size AS query_id, p_partkey AS doc_id, p_retailprice / 1000 AS score, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank, string_split(p_name, ' ')[1] AS adj, string_split(p_name, ' ')[2] AS noun, lower(p_type) AS kind FROM part) WHERE rank <= 40),
    f AS (SELECT query_id, doc_id, rank, score, unnest(['style', 'category', 'size']) AS attribute, unnest([CASE WHEN adj IN ('red', 'blue', 'green') THEN NULL ELSE adj END, noun, kind]) AS answer FROM pl),
    w AS (SELECT query_id, doc_id, 1 / sqrt(rank) / sum(1 / sqrt(rank)) OVER (PARTITION BY query_id) AS weight FROM pl),
    k AS (SELECT f.*, weight FROM f JOIN w USING (query_id, doc_id)),
    a AS (SELECT *, sum(mass) OVER (PARTITION BY query_id, attribute) AS known, row_number() OVER (PARTITION BY query_id, attribute ORDER BY round(residual, 12) DESC, round(mass, 12) DESC, answer) AS i FROM (SELECT query_id, attribute, answer, sum(weight) AS mass, sum(CASE WHEN rank > 10 THEN weight ELSE 0 END) AS residual FROM k WHERE answer IS NOT NULL GROUP BY 1, 2, 3)),
    t AS (SELECT *, sum(mass) OVER (PARTITION BY query_id, attribute) AS modelled FROM a WHERE i <= 4),
    m AS (SELECT t.query_id, t.attribute, t.answer, k.rank, CASE WHEN k.answer = t.answer THEN weight ELSE 0 END AS part, row_number() OVER (PARTITION BY t.query_id, t.attribute, t.answer ORDER BY round(score + CASE WHEN k.answer = t.answer THEN 1 WHEN k.answer IS NULL THEN 0 ELSE -1 END * 0.2::DOUBLE, 9) DESC, rank) AS place FROM t JOIN k ON k.query_id = t.query_id AND k.attribute = t.attribute),
    g AS (SELECT query_id, attribute, sum(CASE WHEN rank > 10 AND place <= 10 THEN 0.65::DOUBLE * part / place ELSE 0 END) AS rg, sum(CASE WHEN rank > 10 AND place <= 10 THEN 0.65::DOUBLE * part ELSE 0 END) AS cg FROM m GROUP BY 1, 2),
    rr AS (SELECT query_id, attribute, rank, bool_and(reach = rank) AS same FROM (SELECT *, max(place) OVER (PARTITION BY query_id, attribute, answer ORDER BY rank) AS reach, count(*) OVER (PARTITION BY query_id, attribute, answer) AS n FROM m) WHERE rank >= 3 AND rank < least(10, n) GROUP BY 1, 2, 3),
    st AS (SELECT query_id, attribute, list(rank ORDER BY rank) AS stable FROM rr WHERE same GROUP BY 1, 2),
    mo AS (SELECT g.query_id, g.attribute, rg, cg, 0.3::DOUBLE * rg + 0.5::DOUBLE * cg AS value, 0.65::DOUBLE * any_value(modelled) AS modelled, 0.65::DOUBLE * greatest(0, any_value(known) - any_value(modelled)) AS unmodelled, coalesce(any_value(stable), []) AS stable FROM g JOIN t USING (query_id, attribute) LEFT JOIN st USING (query_id, attribute) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_POOL} SELECT query_id, attribute, round(rg, 9) AS rank_gain, round(cg, 9) AS recovery_gain, round(value, 9) AS value, round(modelled, 9) AS modelled, round(unmodelled, 9) AS unmodelled, array_to_string(stable, ',') AS stable FROM mo")
def question_outcomes(spark, sf_dir):
    """What each question would be worth: how its answers would move products into the slate."""
    pool, facets = _pool(spark, sf_dir)
    m = outcomes.models(pool, facets, gain=0.2)
    return m.select("query_id", "attribute", *[F.round(c, 9).alias(c) for c in ("rank_gain", "recovery_gain", "value", "modelled", "unmodelled")], F.array_join(F.transform("stable", lambda x: x.cast("string")), ",").alias("stable"))


def _pool(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = Window.partitionBy("p_size").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= outcomes.MAX_POOL)
    adj = F.element_at(F.split("p_name", " "), 1)
    told = {"style": F.when(~adj.isin("red", "blue", "green"), adj), "category": F.element_at(F.split("p_name", " "), 2), "size": F.lower("p_type")}
    facts = F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("answer")) for a, v in told.items()])
    facets = ranked.select(F.col("p_partkey").alias("doc_id"), F.inline(facts)).filter("answer is not null")
    return ranked.select(F.col("p_size").alias("query_id"), "rank", F.col("p_partkey").alias("doc_id"), (F.col("p_retailprice") / 1000).alias("score")), facets


@query(f"""WITH {_POOL}, n AS (SELECT query_id, least(count(*), 10) AS full_ FROM pl GROUP BY 1),
    dr AS (SELECT *, max(score) OVER z - min(score) OVER z AS spread, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS fall, count(*) OVER z AS c FROM pl WHERE rank <= 10 WINDOW z AS (PARTITION BY query_id)), gp AS (SELECT query_id, min(rank) AS gap FROM dr WHERE c >= 4 AND rank >= 3 AND spread > 0 AND fall >= 0.7::DOUBLE * spread GROUP BY 1),
    b AS (SELECT * FROM mo QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(value, 12) DESC, attribute DESC) = 1)
    SELECT n.query_id, CASE WHEN value > 0.0001::DOUBLE + 1e-12 THEN attribute END AS attribute, round(coalesce(value, 0), 9) AS value, CASE WHEN value > 0.0001::DOUBLE + 1e-12 AND list_contains(stable, gap) AND modelled >= 0.5 AND unmodelled <= 1e-12 THEN gap ELSE full_ END::INT AS size FROM n LEFT JOIN b USING (query_id) LEFT JOIN gp USING (query_id)""")
def question_by_outcome(spark, sf_dir):
    """The question worth most, if it is worth its turn, and the length of the slate shown with it."""
    pool, facets = _pool(spark, sf_dir)
    return outcomes.decided(pool, facets, gain=0.2, turn_cost=0.0001).withColumn("value", F.round("value", 9))


@query(f"""WITH RECURSIVE {_POOL}, c AS (SELECT query_id, list({{'doc': doc_id, 'rank': rank, 'facts': [adj, noun, kind]}}) AS pool FROM pl GROUP BY 1),
    cover AS (SELECT query_id, 0 AS place, NULL::BIGINT AS doc_id, []::VARCHAR[] AS seen, []::BIGINT[] AS taken FROM c
        UNION ALL SELECT query_id, place + 1, b.doc, list_distinct(list_concat(seen, b.facts)), list_append(taken, b.doc) FROM (
            SELECT cover.*, list_max(list_transform(list_filter(pool, lambda x: NOT list_contains(taken, x.doc)), lambda x: {{'new': len(list_filter(list_distinct(x.facts), lambda y: NOT list_contains(seen, y))), 'r': -x.rank, 'doc': x.doc, 'facts': x.facts}})) AS b FROM cover JOIN c USING (query_id) WHERE place < 8) WHERE b IS NOT NULL)
    SELECT query_id, doc_id, place FROM cover WHERE place > 0""")
def covering_candidates(spark, sf_dir):
    """Of each pool eight products that together show the most different facts, one after the other."""
    p = table(spark, sf_dir, "part").withColumn("rank", F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("p_retailprice"), "p_partkey")))
    facts = F.array(F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), 2), F.lower("p_type"))
    return admission.greedy_cover(p.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("doc_id"), "rank", facts.alias("facts")), 8, pool=outcomes.MAX_POOL)


# ---- rendered documents


@query(r"""WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, list_filter(list_distinct_in_order, lambda t: length(t) > 1) AS v FROM (SELECT item_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_in_order FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))),
    n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT doc_id, source, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS w, v FROM documents, n JOIN b ON i = doc_id % n),
    e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d), p AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(word), '[\pL\pN_]+')) AS part FROM e), f AS (SELECT doc_id, part, min(i) AS i FROM p GROUP BY 1, 2),
    q AS (SELECT doc_id, unnest(v) AS part, generate_subscripts(v, 1) AS o FROM d), h AS (SELECT doc_id, o, f.i FROM q JOIN f USING (doc_id, part)),
    s AS (SELECT doc_id, min(o) AS o, s FROM (SELECT h.doc_id, o, array_to_string(w[greatest(1, h.i - 10):h.i + 10], ' ') AS s FROM h JOIN d USING (doc_id)) GROUP BY doc_id, s),
    j AS (SELECT doc_id, string_agg('Text: ' || s, ' ' ORDER BY o) AS t FROM s GROUP BY 1),
    r AS (SELECT d.doc_id, 'Source: ' || source || coalesce(' ' || t, '') AS t, len(w) AS words FROM d LEFT JOIN j USING (doc_id))
    SELECT doc_id, words::INT AS words, sha256(array_to_string(string_split_regex(t, ' ')[1:160], ' ')) AS rendered FROM r""")
def rendered_documents(spark, sf_dir):
    """Whole documents as windows around the words of a benchmark item each, within 160 words."""
    item = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("asked"))
    ordered = item.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("item_id")) - 1)  # the stated query set, numbered
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(item.agg(F.count(F.lit(1)).alias("n"))))
    j = d.join(ordered, F.col("i") == F.col("doc_id") % F.col("n"))
    text = render.around_query(F.col("asked"), {"source": F.col("source")}, {"text": F.col("text")})
    return j.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("words"), F.sha2(text.cast("binary"), 256).alias("rendered"))


# ---- evidence by view

_PREFS = [(0, "red", "color", 0, True, 1.0), (1, "blue", "color", 0, True, 1.0), (2, "ring", "category", 1, True, 1.0), (3, "large", "size", 2, False, 0.8), (4, "economy", "material", 3, False, 0.6)]
_KINDS = {"color": ("red", "blue", "green"), "category": ("ring", "widget", "gear", "bolt", "rod"), "size": ("small", "large"), "material": ("economy", "standard", "promo")}
_SIGNAL = "CASE WHEN f.said IS NULL THEN 0 WHEN f.said = p.value THEN 1 ELSE -1 END"
_SIGNALS = f"""p(pref, value, attribute, grp, hard, confidence) AS (VALUES {", ".join(str(x) for x in _PREFS)}),
    kinds(attribute, value) AS (VALUES {", ".join(f"('{a}', '{v}')" for a, listed in _KINDS.items() for v in listed)}),
    x AS (SELECT p_size AS query_id, p_partkey AS doc_id, field, unnest(string_split(lower(said), ' ')) AS word FROM (SELECT p_size, p_partkey, unnest(['title', 'type']) AS field, unnest([p_name, p_type]) AS said FROM part)),
    o AS (SELECT query_id, doc_id, field, attribute, min(word) AS said FROM x JOIN kinds ON kinds.value = word GROUP BY 1, 2, 3, 4),
    sg AS (SELECT d.query_id, d.doc_id, d.field, p.*, coalesce(CASE WHEN o.said = p.value THEN 1.0::DOUBLE WHEN o.said IS NOT NULL THEN -1.0::DOUBLE END, 0) AS signal FROM (SELECT DISTINCT query_id, doc_id, field FROM x) d CROSS JOIN p LEFT JOIN o ON o.query_id = d.query_id AND o.doc_id = d.doc_id AND o.field = d.field AND o.attribute = p.attribute),
    e AS (SELECT query_id, doc_id, pref, value, attribute, grp, hard, confidence, CASE WHEN max(signal) > 0 AND min(signal) < 0 THEN 0 WHEN max(signal) > 0 THEN max(signal) ELSE min(signal) END AS signal, list({{'field': field, 'signal': signal}}) AS every FROM sg GROUP BY ALL)"""


def _signals(spark, sf_dir):
    """Signals by field of a few requirements, the given products being the stated set."""
    prefs = F.array(*[F.struct(F.lit(i).alias("pref"), F.lit(v).alias("value"), F.lit(a).alias("attribute"), F.lit(g).alias("grp"), F.lit(h).alias("hard"), F.lit(float(c)).alias("confidence")) for i, v, a, g, h, c in _PREFS])
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("said")) for n, c in (("title", "p_name"), ("type", "p_type"))])
    p = spread(table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_name", "p_type"), "doc_id")  # a product's groups stay in its task
    p = p.select("query_id", "doc_id", F.explode(fields).alias("f")).select("query_id", "doc_id", "f.field", F.split(F.lower("f.said"), " ").alias("w"))
    each = p.select("*", F.inline(prefs))
    own = F.lit(None).cast("string")
    for a, listed in _KINDS.items():
        own = F.when(F.col("attribute") == a, F.array_min(F.array_intersect("w", F.array(*map(F.lit, listed))))).otherwise(own)
    return each.withColumn("signal", F.when(own.isNull(), 0.0).when(own == F.col("value"), 1.0).otherwise(-1.0))


@query(f"""WITH {_SIGNALS}, v AS (SELECT query_id, doc_id, grp, max(signal * CASE WHEN hard THEN 1.25::DOUBLE ELSE confidence END * CASE WHEN signal < 0 THEN 2 ELSE 1 END * CASE attribute WHEN 'color' THEN 0.7::DOUBLE WHEN 'category' THEN 1 WHEN 'size' THEN 0.4::DOUBLE WHEN 'material' THEN 0.8::DOUBLE END) AS vote, bool_and(hard AND signal < 0) AS bad FROM e GROUP BY 1, 2, 3)
    SELECT query_id, doc_id, round(sum(vote), 9) AS score, bool_or(bad) AS violation FROM v GROUP BY 1, 2""")
def view_assessment(spark, sf_dir):
    """Products under alternatives and hard requirements: the best vote of each group, and whether a whole group is contradicted."""
    s = _signals(spark, sf_dir)
    return views.assessed(views.explained(s, keep=("attribute", "grp", "hard", "confidence"))).withColumn("score", F.round("score", 9))


@query(f"""WITH {_SIGNALS} SELECT query_id, doc_id, pref, CASE WHEN signal > 0 THEN 'supported' WHEN signal < 0 THEN 'contradicted' ELSE 'unknown' END AS status, signal, array_to_string(list_sort(list_transform(list_filter(every, lambda x: x.signal * e.signal > 0), lambda x: x.field)), ',') AS fields FROM e""")
def view_explanations(spark, sf_dir):
    """Which fields speak for or against each requirement."""
    s = _signals(spark, sf_dir).select("query_id", "doc_id", "pref", "field", "signal")
    return views.explained(s).withColumn("fields", F.array_join("fields", ","))


# ---- rule weights

_GRID, _START, _SWEEPS = [0.0, 0.25, 0.5, 0.75, 1.0], {"a": 0.5, "b": 0.5, "c": 0.5, "t": 0.5}, 3


def _search_sql() -> str:
    """Every step is a table of one row: the settings with one of them chosen anew."""
    steps, held = [f"h0 AS (SELECT {', '.join(f'{v}::DOUBLE AS {n}' for n, v in _START.items())})"], "h0"
    for k, name in enumerate(list(_START) * _SWEEPS, 1):
        use = {n: f"{held}.{n}" for n in _START} | {name: "v"}
        f1 = lambda c, suffix: f"CASE WHEN sum(tp{suffix}) > 0 THEN 2.0::DOUBLE * sum(tp{suffix}) / (2 * sum(tp{suffix}) + sum(miss)) ELSE 0 END"  # noqa: E731, ARG005
        steps += [
            f"s{k} AS (SELECT v, fold, {held}.{name} AS own, label, ({use['a']} * d + {use['b']} * x + {use['c']} * q > {use['t']})::INT AS said FROM r, {held}, (SELECT unnest({_GRID}::DOUBLE[]) AS v))",
            f"c{k} AS (SELECT v, fold, own, count(*) FILTER (label = 1 AND said = 1) AS tp1, count(*) FILTER (label = 0 AND said = 0) AS tp0, count(*) FILTER (label <> said) AS miss FROM s{k} GROUP BY 1, 2, 3)",
            f"f{k} AS (SELECT v, own, fold, ({f1('c', 1)} + {f1('c', 0)}) / 2 AS f FROM c{k} GROUP BY 1, 2, 3)",
            f"w{k} AS (SELECT v, ({f1('c', 1)} + {f1('c', 0)}) / 2 AS w FROM c{k} GROUP BY 1)",
            f"b{k} AS (SELECT v, round(avg(f), 9) AS cv FROM f{k} JOIN w{k} USING (v) GROUP BY v, own, w ORDER BY round(avg(f), 9) DESC, round(w, 9) DESC, abs(v - own), v LIMIT 1)",
            f"h{k} AS (SELECT {', '.join(f'b{k}.v AS {n}' if n == name else f'{held}.{n}' for n in _START)}, b{k}.cv FROM {held}, b{k})",
        ]
        held = f"h{k}"
    return "WITH r AS (SELECT l_orderkey % 5 AS fold, (l_returnflag = 'R')::INT AS label, l_discount * 10 AS d, l_tax * 10 AS x, l_quantity / 50 AS q FROM lineitem), " + ", ".join(steps) + f" SELECT a, b, c, t, cv FROM {held}"


@query(_search_sql())
def coordinate_search(spark, sf_dir):
    """Weights and threshold of a rule for returned lines, improved one after the other over five folds."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_orderkey") % 5).alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"), (F.col("l_quantity") / 50).alias("q"))
    decide = lambda s: (s["a"] * F.col("d") + s["b"] * F.col("x") + s["c"] * F.col("q") > s["t"]).cast("int")
    held, score = ev.coordinate_search(rows, decide, _START, _GRID, sweeps=_SWEEPS)
    return spark.createDataFrame([(*held.values(), score)], "a double, b double, c double, t double, cv double")
