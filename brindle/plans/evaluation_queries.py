"""Evaluation, dataset-pack and vocabulary queries."""

from pyspark.sql import Window, functions as F

from ..functions.text import FACETS, terms
from ..operators import evaluation as ev, packs, vocabulary as voc
from ..sources import catalog as sources
from .registry import CATALOG, OUTCOMES, catalog, outcomes, query, table, terms_sql

METRICS = """count(*) AS sessions, round(avg(hit::INT), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mean_turns,
    round(greatest(0, least(1, (11 - avg(coalesce(first_hit_turn, 11))) / 10)), 6) AS efficiency,
    round(0.5::DOUBLE * avg(hit::INT) + 0.3::DOUBLE * avg(reciprocal_rank) + 0.2::DOUBLE * greatest(0, least(1, (11 - avg(coalesce(first_hit_turn, 11))) / 10)), 6) AS technical_score"""


@query(f"WITH {OUTCOMES} SELECT {METRICS} FROM out")
def session_metrics(spark, sf_dir):
    return outcomes(spark, sf_dir).agg(*ev.session_metrics())


@query(f"WITH {OUTCOMES} SELECT coalesce(scenario_type, 'all') AS scenario_type, {METRICS} FROM out GROUP BY ROLLUP (scenario_type)")
def scenario_rollup(spark, sf_dir):
    return ev.by_scenario(outcomes(spark, sf_dir))


@query(f"WITH {OUTCOMES} SELECT scenario_type, round(0.5::DOUBLE * avg(hit::INT) + 0.3::DOUBLE * avg(reciprocal_rank) + 0.2::DOUBLE * greatest(0, least(1, (11 - avg(coalesce(first_hit_turn, 11))) / 10)), 6) AS technical_score FROM out GROUP BY 1")
def technical_score(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("scenario_type").agg(ev.session_metrics()[-1])


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2),
    t AS (SELECT l_orderkey AS query_id, max(l_partkey) AS doc_id FROM lineitem GROUP BY 1), f AS (SELECT query_id, coalesce(rank, 999) AS rank FROM t LEFT JOIN r USING (query_id, doc_id))
    SELECT count(*) AS n_queries, """ + ", ".join(f"round(avg((rank <= {k})::INT), 9) AS recall_{k}" for k in (1, 3, 5, 10)) + " FROM f")
def recall_at_k(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    return ev.recall_at(li.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")), li.groupBy("query_id").agg(F.max("doc_id").alias("doc_id")), (1, 3, 5, 10))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS n, max(value) FILTER (i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(value) FILTER (i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95 FROM s GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return ev.percentile_at(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query(f"""WITH {OUTCOMES}, b AS (SELECT l_orderkey AS sample_id, coalesce(1.0::DOUBLE / min(l_linenumber) FILTER (l_linestatus = 'F'), 0) AS rr FROM lineitem GROUP BY 1)
    SELECT scenario_type, count(*) AS pairs, round(avg(rr - reciprocal_rank), 9) AS mean_delta, count(*) FILTER (rr > reciprocal_rank) AS wins, count(*) FILTER (rr < reciprocal_rank) AS losses
    FROM out JOIN b USING (sample_id) GROUP BY 1""")
def paired_session_delta(spark, sf_dir):
    pairs = _deltas(spark, sf_dir)
    return pairs.groupBy("scenario_type").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("delta"), 9).alias("mean_delta"), F.count(F.when(F.col("delta") > 0, 1)).alias("wins"), F.count(F.when(F.col("delta") < 0, 1)).alias("losses"))


def _deltas(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.coalesce(1 / F.min(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))), F.lit(0.0)).alias("rr"))
    return outcomes(spark, sf_dir).join(b, "sample_id").select("sample_id", "scenario_type", (F.col("rr") - F.col("reciprocal_rank")).alias("delta"))


@query()
def bootstrap_ci(spark, sf_dir):
    d = _deltas(spark, sf_dir).select(F.col("sample_id").alias("id"), "delta")
    return ev.bootstrap_interval(d, resamples=200, seed=20260826).select(F.round("mean", 9).alias("mean"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


PROBS = "pl AS (SELECT l_discount * 8 + l_tax AS p, (l_returnflag = 'R')::INT AS label FROM lineitem)"


@query(f"""WITH {PROBS}, t AS (SELECT avg((p - label) ** 2) AS brier, -avg(label * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - label) * ln(1 - greatest(1e-12, least(1 - 1e-12, p)))) AS log_loss FROM pl),
    b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS c, avg(p) AS mp, avg(label) AS my FROM pl GROUP BY 1)
    SELECT round(brier, 9) AS brier, round(log_loss, 9) AS log_loss, round((SELECT sum(c * abs(mp - my)) / sum(c) FROM b), 9) AS ece FROM t""")
def calibration_ece(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 8 + F.col("l_tax")).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return ev.calibration(rows)


@query("""WITH x AS (SELECT o_orderstatus AS label, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS pred FROM orders),
    g AS (SELECT class, sum(t)::BIGINT AS tp, sum(p)::BIGINT AS predicted, sum(a)::BIGINT AS actual FROM (SELECT label AS class, 1 AS a, 0 AS p, (label = pred)::INT AS t FROM x UNION ALL SELECT pred, 0, 1, 0 FROM x) GROUP BY 1)
    SELECT *, round(coalesce(tp / nullif(predicted, 0), 0), 9) AS precision, round(coalesce(tp / nullif(actual, 0), 0), 9) AS recall,
        round(coalesce(2 * (tp / nullif(predicted, 0)) * (tp / nullif(actual, 0)) / nullif(tp / nullif(predicted, 0) + tp / nullif(actual, 0), 0), 0), 9) AS f1 FROM g""")
def confusion_macro_f1(spark, sf_dir):
    pred = F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 100000, "O").otherwise("P")
    return ev.macro_f1(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"), pred.alias("pred")))


STAGES = """sg AS (SELECT l_orderkey AS id, CASE WHEN NOT bool_or(l_returnflag = 'R') THEN 'retrieval' WHEN NOT bool_or(l_discount > 0.05::DOUBLE) THEN 'admission' WHEN NOT bool_or(l_tax > 0.04::DOUBLE) THEN 'ranking' ELSE 'hit' END AS stage FROM lineitem GROUP BY 1)"""


def _stages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_discount") > 0.05).alias("b"), F.bool_or(F.col("l_tax") > 0.04).alias("c"))
    return li.select("id", ev.stage_of([("a", "retrieval"), ("b", "admission"), ("c", "ranking")], "hit").alias("stage"))


@query(f"WITH {STAGES} SELECT stage, count(*) AS sessions FROM sg GROUP BY 1")
def stage_attribution(spark, sf_dir):
    return _stages(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("sessions"))


@query(f"WITH {STAGES} SELECT a.stage AS before, b.stage AS after, count(*) AS sessions FROM sg a JOIN sg b ON b.id = a.id + 1 GROUP BY 1, 2")
def stage_transitions(spark, sf_dir):
    s = _stages(spark, sf_dir)
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("stage").alias("after"))
    return s.withColumnRenamed("stage", "before").join(nxt, "id").groupBy("before", "after").agg(F.count(F.lit(1)).alias("sessions"))


@query("""SELECT o_orderstatus AS grp, count(*) AS n, count(*) FILTER (abs(o_totalprice - parts) <= 0.05::DOUBLE * o_totalprice) AS within, round(avg(abs(o_totalprice - parts)), 4) AS mean_gap
    FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def timing_reconciliation(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("parts"))
    gap = F.abs(F.col("o_totalprice") - F.col("parts"))
    j = table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_orderstatus").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(gap <= 0.05 * F.col("o_totalprice"), 1)).alias("within"), F.round(F.avg(gap), 4).alias("mean_gap"))


@query("""WITH f AS (SELECT l_orderkey AS session_id, l_partkey AS id, min(l_linenumber) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 40 GROUP BY 1, 2)
    SELECT session_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos, id) AS place FROM f) WHERE place <= 3""")
def recommendation_normalize(spark, sf_dir):
    """First valid different ids of every slate, three at most."""
    li, valid = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size < 40").select(F.col("p_partkey").alias("id"))
    f = li.select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("id"), "l_linenumber").join(valid, "id", "left_semi").groupBy("session_id", "id").agg(F.min("l_linenumber").alias("pos"))
    w = Window.partitionBy("session_id").orderBy("pos", "id")
    return f.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("session_id", "id", "place")


@query("""SELECT 'entry without product' AS problem, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
    UNION ALL SELECT 'product without entry', count(*) FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""")
def index_integrity_antijoin(spark, sf_dir):
    p, li = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").select("l_partkey")
    a = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.lit("entry without product").alias("problem"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(p.join(li, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.lit("product without entry").alias("problem"), F.count(F.lit(1)).alias("n")))


@query("SELECT p_name AS title, p_type AS categories, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def catalog_duplicate_check(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title"), F.col("p_type").alias("categories")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id")).filter("n > 1")


@query("""WITH c AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS w FROM conversations),
    p AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY conv_id ORDER BY turn), []) AS b FROM c)
    SELECT conv_id, turn, len(list_filter(w, lambda x: NOT list_contains(b, x)))::INT AS added, len(list_filter(b, lambda x: NOT list_contains(w, x)))::INT AS retired, len(list_filter(w, lambda x: list_contains(b, x)))::INT AS retained FROM p""")
def evidence_diff(spark, sf_dir):
    """What each turn adds to, retires from and keeps of the turn before."""
    from ..functions.text import words

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(words("text")).alias("w"))
    b = F.coalesce(F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    return c.withColumn("b", b).select("conv_id", "turn", F.size(F.array_except("w", "b")).alias("added"), F.size(F.array_except("b", "w")).alias("retired"), F.size(F.array_intersect("w", "b")).alias("retained"))


@query("SELECT user_id AS session_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) AS versions FROM events GROUP BY 1, 2")
def turn_dedupe_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id"), "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("versions"))


COLOR_RE = FACETS["color"]
FAMILY = f"""fam AS (SELECT p_partkey AS id, p_type AS category, p_brand, p_size AS size, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '\\b({COLOR_RE})\\b', ' ', 'g'), '\\d+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS family FROM part)"""


def _family(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), "p_brand", F.col("p_size").alias("size"), packs.family_key(F.concat_ws(" ", "p_name", "p_type"), loose=True).alias("family"))


@query(f"WITH {FAMILY} SELECT family, arg_min(id, sha256('seed' || chr(0) || id)) AS id, count(*) AS members FROM fam GROUP BY 1")
def title_family_dedupe(spark, sf_dir):
    return packs.one_per_family(_family(spark, sf_dir), "family", "id", "seed")


DEAL = f"""{FAMILY}, dealt AS (SELECT *, ['train', 'train', 'dev', 'test'][1 + (row_number() OVER (PARTITION BY category ORDER BY sha256('v1' || chr(0) || id), id) - 1) % 4] AS split FROM fam)"""


@query(f"WITH {DEAL} SELECT id, category, split FROM dealt")
def split_hash_deal(spark, sf_dir):
    return _dealt(spark, sf_dir).select("id", "category", "split")


def _dealt(spark, sf_dir):
    return packs.deal(_family(spark, sf_dir), "id", "v1", ("train", "train", "dev", "test"), "category")


@query(f"""WITH {DEAL} SELECT 'category' AS dimension, category AS value, count(DISTINCT split) AS splits FROM dealt GROUP BY 2 HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'family', family, count(DISTINCT split) FROM dealt GROUP BY 2 HAVING count(DISTINCT split) > 1""")
def split_overlap_audit(spark, sf_dir):
    return packs.overlap(_dealt(spark, sf_dir), ("category", "family"))


@query(f"WITH {DEAL}, prior AS (SELECT DISTINCT family FROM dealt WHERE split = 'test' AND size = 1) SELECT id, family FROM dealt WHERE family NOT IN (SELECT family FROM prior)")
def excluded_family_antijoin(spark, sf_dir):
    """Products that are neither earlier targets (here: test products of size 1) nor relatives of one."""
    d = _dealt(spark, sf_dir)
    prior = d.filter("split = 'test' AND size = 1").select("family").distinct()
    return d.join(prior, "family", "left_anti").select("id", "family")


@query(f"""WITH {FAMILY} SELECT id, category, i FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('rr' || chr(0) || id), id) AS i FROM fam) ORDER BY i, category LIMIT 100""")
def strata_round_robin(spark, sf_dir):
    return packs.round_robin(_family(spark, sf_dir), "category", "id", "rr", 100).select("id", "category", "i")


@query(f"""WITH {CATALOG}, b AS (SELECT CASE WHEN reviews < 5 THEN 0 WHEN reviews < 100 THEN 1 WHEN reviews < 1000 THEN 2 WHEN reviews < 5000 THEN 3 WHEN reviews < 20000 THEN 4 ELSE 5 END AS band, count(*) AS n FROM cat GROUP BY 1),
    x AS (SELECT *, n * 97.0::DOUBLE / sum(n) OVER () AS exact FROM b), l AS (SELECT *, floor(exact)::BIGINT AS low FROM x),
    o AS (SELECT *, 97 - sum(low) OVER () AS remaining, row_number() OVER (ORDER BY round(exact - low, 9) DESC, band) AS i FROM l)
    SELECT band, n, (low + (i <= remaining)::INT)::BIGINT AS quota FROM o""")
def popularity_band_quota(spark, sf_dir):
    counts = catalog(spark, sf_dir).groupBy(packs.band(F.col("reviews")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return packs.quotas(counts, 97)


VOTES = f"""vt AS (SELECT 'type' AS attribute, alias, p_type AS canonical FROM (SELECT p_type, unnest({terms_sql("p_name || ' ' || p_type")}) AS alias FROM part)),
    vc AS (SELECT attribute, alias, canonical, count(*) AS support FROM vt GROUP BY ALL),
    vr AS (SELECT *, row_number() OVER w AS i, lead(support, 1, 0) OVER w AS nxt, sum(support) OVER (PARTITION BY attribute, alias) AS total FROM vc WINDOW w AS (PARTITION BY attribute, alias ORDER BY support DESC, canonical))"""


def _votes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.lit("type").alias("attribute"), F.explode(terms(F.concat_ws(" ", "p_name", "p_type"))).alias("alias"), F.col("p_type").alias("canonical"))


@query(f"WITH {VOTES} SELECT attribute, alias, canonical, support, round(support / total, 9) AS confidence, round((support - nxt) / total, 9) AS margin FROM vr WHERE i = 1 AND support >= 5 AND support >= 0.8::DOUBLE * total")
def vocabulary_aliases(spark, sf_dir):
    return voc.aliases(_votes(spark, sf_dir))


@query(f"WITH {VOTES} SELECT attribute, alias, canonical, margin, margin >= 0.02::DOUBLE AS eligible FROM (SELECT *, round((support - nxt) / total, 9) AS margin FROM vr WHERE i = 1)")
def vocabulary_margin(spark, sf_dir):
    return voc.aliases(_votes(spark, sf_dir), least_support=1, least_share=0.0).select("attribute", "alias", "canonical", "margin", (F.col("margin") >= 0.02).alias("eligible"))


NEIGHBORS = f"""tt AS (SELECT DISTINCT doc_id, token FROM (SELECT item_id AS doc_id, unnest({terms_sql('text')}) AS token FROM benchmark)),
    nd AS (SELECT count(DISTINCT doc_id) AS n_docs FROM tt), dfr AS (SELECT token, count(*) AS df FROM tt GROUP BY 1 HAVING count(*) BETWEEN 2 AND 1000),
    ra AS (SELECT doc_id, token, ln(1 + n_docs / df) AS idf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, token) AS i FROM tt JOIN dfr USING (token)), nd WHERE i <= 6),
    cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS p FROM ra) WHERE p <= 256),
    sm AS (SELECT doc_id, sum(idf) AS total FROM ra GROUP BY 1),
    sh AS (SELECT a.doc_id, b.doc_id AS neighbor, sum(a.idf) AS shared FROM cp a JOIN cp b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    nb AS (SELECT sh.doc_id, neighbor, round(shared / (x.total + y.total - shared), 9) AS similarity FROM sh JOIN sm x ON x.doc_id = sh.doc_id JOIN sm y ON y.doc_id = neighbor),
    nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, neighbor) AS rank FROM nb) WHERE rank <= 8)"""


def _neighbors(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(F.array_distinct(terms("text"))).alias("token"))
    return tokens, voc.title_neighbors(tokens)


@query(f"WITH {NEIGHBORS} SELECT doc_id, neighbor, round(similarity, 6) AS similarity, rank FROM nr")
def title_neighbors(spark, sf_dir):
    return _neighbors(spark, sf_dir)[1].withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {NEIGHBORS}, c AS (SELECT doc_id, count(*) AS neighbors FROM nr GROUP BY 1),
    s AS (SELECT t.doc_id, t.token AS value, c.neighbors, count(o.token) AS support FROM tt t JOIN c USING (doc_id) JOIN nr ON nr.doc_id = t.doc_id LEFT JOIN tt o ON o.doc_id = nr.neighbor AND o.token = t.token GROUP BY 1, 2, 3)
    SELECT doc_id, 'term' AS attribute, value, neighbors, support FROM s WHERE support * 2 < neighbors""")
def contrast_differences(spark, sf_dir):
    tokens, n = _neighbors(spark, sf_dir)
    return voc.contrasts(n, tokens.select("doc_id", F.lit("term").alias("attribute"), F.col("token").alias("value")))


PRODUCT_NEIGHBORS = f"""pt AS (SELECT DISTINCT doc_id, token FROM (SELECT p_partkey AS doc_id, unnest({terms_sql('p_name')}) AS token FROM part)),
    pd AS (SELECT token, count(*) AS df FROM pt GROUP BY 1),
    pw AS (SELECT doc_id, token, df, ln(1 + (SELECT count(*) FROM part) / df) AS idf FROM pt JOIN pd USING (token)),
    ps AS (SELECT doc_id, sum(idf) AS total FROM pw GROUP BY 1),
    pa AS (SELECT doc_id, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, token) AS i FROM pw WHERE df BETWEEN 2 AND 1000) WHERE i <= 6),
    pp AS (SELECT doc_id, token FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS p FROM pw WHERE df BETWEEN 2 AND 1000) WHERE p <= 256),
    pc AS (SELECT DISTINCT pa.doc_id, pp.doc_id AS neighbor FROM pa JOIN pp USING (token) WHERE pa.doc_id <> pp.doc_id),
    ph AS (SELECT pc.doc_id, neighbor, sum(a.idf) AS shared FROM pc JOIN pw a ON a.doc_id = pc.doc_id JOIN pt b ON b.doc_id = neighbor AND b.token = a.token GROUP BY 1, 2),
    pb AS (SELECT ph.doc_id, neighbor, round(shared / (x.total + y.total - shared), 9) AS similarity FROM ph JOIN ps x ON x.doc_id = ph.doc_id JOIN ps y ON y.doc_id = neighbor),
    pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, neighbor) AS rank FROM pb) WHERE rank <= 8)"""


def _product_neighbors(spark, sf_dir):
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array_distinct(terms("p_name")).alias("tokens"))
    return titles, voc.product_neighbors(titles)


@query(f"WITH {PRODUCT_NEIGHBORS} SELECT doc_id, neighbor, round(similarity, 6) AS similarity, rank FROM pr")
def product_neighbors(spark, sf_dir):
    return _product_neighbors(spark, sf_dir)[1].withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {PRODUCT_NEIGHBORS}, c AS (SELECT doc_id, count(*) AS neighbors FROM pr GROUP BY 1),
    s AS (SELECT t.doc_id, t.token AS value, c.neighbors, count(o.token) AS support FROM pt t JOIN c USING (doc_id) JOIN pr ON pr.doc_id = t.doc_id LEFT JOIN pt o ON o.doc_id = pr.neighbor AND o.token = t.token GROUP BY 1, 2, 3)
    SELECT doc_id, 'term' AS attribute, value, neighbors, support FROM s WHERE support * 2 < neighbors""")
def product_contrasts(spark, sf_dir):
    titles, n = _product_neighbors(spark, sf_dir)
    return voc.contrasts(n, titles.select("doc_id", F.lit("term").alias("attribute"), F.explode("tokens").alias("value")))


@query("""WITH r AS (SELECT p_brand AS store, sha256('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}') AS h FROM part),
    l AS (SELECT store, i, sum(('0x' || substr(h, 1 + 15 * i, 15))::HUGEINT) AS s FROM r, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY 1, 2), n AS (SELECT store, count(*) AS n FROM r GROUP BY 1)
    SELECT store, sha256(string_agg(s, ',' ORDER BY i) || ',' || any_value(n)) AS fingerprint, any_value(n) AS n FROM l JOIN n USING (store) GROUP BY 1""")
def catalog_fingerprint(spark, sf_dir):
    """A digest of each store's rows, whatever their order."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("store"), "p_partkey", "p_name")
    return sources.fingerprints(rows, "store")
