"""Ranking, policy and paging queries over the catalog stand-in."""

from pyspark.sql import Window, functions as F

from ..functions.dealing import spread
from ..functions.text import facet, money
from ..operators import paging, policy, ranking as k, retrieval as r
from .registry import CATALOG, FACETS, catalog, facet_sql, query, table


def _ranked(spark, sf_dir, n=100):
    """Each store is a query; its products by quality and price are the candidates."""
    c = catalog(spark, sf_dir)
    score = F.round(k.quality_prior(F.col("rating"), F.col("reviews")) + F.col("price") / 100, 9)
    rows = c.withColumn("query_id", F.col("store")).withColumn("doc_id", F.col("product_id")).withColumn("score", score)
    return r.top_k(rows, n)


RANKED = f"""{CATALOG},
    sc AS (SELECT *, store AS query_id, product_id AS doc_id, round(greatest(0, least(5, rating)) * 0.02::DOUBLE + ln(1 + reviews) * 1.05::DOUBLE + price / 100, 9) AS score FROM cat),
    rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 100)"""


@query(f"WITH {CATALOG} SELECT product_id, round(greatest(0, least(5, rating)) * 0.02::DOUBLE + ln(1 + reviews) * 1.05::DOUBLE, 9) AS quality FROM cat")
def quality_prior(spark, sf_dir):
    return catalog(spark, sf_dir).select("product_id", F.round(k.quality_prior(F.col("rating"), F.col("reviews")), 9).alias("quality"))


@query(f"""WITH {CATALOG}, m AS (SELECT avg(rating) AS mean FROM cat)
    SELECT product_id, round(((rating * reviews + mean * 20) / (reviews + 20) - 1) / 4 * least(1, ln(1 + reviews) / ln(500001)), 9) AS prior FROM cat, m""")
def review_prior_shrinkage(spark, sf_dir):
    c = catalog(spark, sf_dir)
    mean = c.agg(F.avg("rating").alias("mean"))
    return c.crossJoin(F.broadcast(mean)).select("product_id", F.round(k.review_prior(F.col("rating"), F.col("reviews"), F.col("mean")), 9).alias("prior"))


@query("""WITH b AS (SELECT * FROM (VALUES (0, 0, 0, 'maximum', 950.0::DOUBLE), (0, 1, 0, 'minimum', 910.0::DOUBLE), (1, 0, 0, 'under', 905.0::DOUBLE), (1, 0, 1, 'over', 990.0::DOUBLE), (2, 0, 0, 'around', 700.0::DOUBLE)) t(query_id, grp, alt, mode, amount)),
    f AS (SELECT query_id, p_partkey AS doc_id, grp, alt, bool_and(CASE mode WHEN 'under' THEN p_retailprice < amount WHEN 'over' THEN p_retailprice > amount WHEN 'maximum' THEN p_retailprice <= amount
               WHEN 'minimum' THEN p_retailprice >= amount ELSE abs(p_retailprice - amount) <= greatest(amount, 10) * 0.35::DOUBLE END) AS ok FROM part, b GROUP BY ALL),
    g AS (SELECT query_id, doc_id, grp, bool_or(ok) AS ok FROM f GROUP BY ALL)
    SELECT query_id, doc_id, bool_and(ok) AS allowed FROM g GROUP BY 1, 2""")
def budget_range_filter(spark, sf_dir):
    b = [(0, 0, 0, "maximum", 950.0), (0, 1, 0, "minimum", 910.0), (1, 0, 0, "under", 905.0), (1, 0, 1, "over", 990.0), (2, 0, 0, "around", 700.0)]
    budgets = F.explode(F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(g).alias("grp"), F.lit(a).alias("alt"), F.lit(m).alias("mode"), F.lit(x).alias("amount")) for q, g, a, m, x in b]))
    p = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("price")), "doc_id")  # a product's groups stay in its task
    pairs = p.select("doc_id", "price", budgets.alias("b")).select("doc_id", "price", "b.*")
    return k.budgets_allow(pairs)


@query("""SELECT p_partkey AS product_id, round(1.4::DOUBLE * greatest(0, 1 - abs(p_retailprice - 950) / 950), 9) AS around,
    round(1.4::DOUBLE * greatest(0, 1 - CASE WHEN p_retailprice <= 920 THEN 0 ELSE greatest(abs(p_retailprice - 920) / 920, 0.001::DOUBLE) END), 9) AS maximum FROM part""")
def budget_soft_closeness(spark, sf_dir):
    price = F.col("p_retailprice")
    score = lambda mode, amount: F.round(k.price_score(price, F.lit(mode), F.lit(amount), F.lit(1.0)), 9).alias(mode)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), score("around", 950.0), score("maximum", 920.0))


@query("""WITH s AS (SELECT p_brand AS store, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT store, max(price) FILTER (i = n // 4) AS q1, max(price) FILTER (i = n * 2 // 4) AS q2, max(price) FILTER (i = n * 3 // 4) AS q3 FROM s WHERE n >= 4 GROUP BY 1""")
def price_bucket_quartiles(spark, sf_dir):
    return policy.quartiles(catalog(spark, sf_dir).select("store", "price"), "store", "price")


def _masses(spark, sf_dir):
    c = _ranked(spark, sf_dir).withColumn("p", k.softmax(F.col("score"), "query_id"))
    text = F.concat_ws(" ", "title", "categories")
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("attribute"), F.when(F.size(facet(text, f)) > 0, F.array_join(facet(text, f), " / ")).alias("signature")) for f in FACETS]))
    return c.select("query_id", "doc_id", "p", facets.alias("f")).select("query_id", "doc_id", "p", "f.*")


MASSES = f"""{RANKED}, sm AS (SELECT *, exp(greatest(-700, (score - max(score) OVER (PARTITION BY query_id)) / 5)) AS e FROM rk),
    pr AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM sm),
    ms AS ({" UNION ALL ".join(f"SELECT query_id, doc_id, p, '{f}' AS attribute, nullif(array_to_string({facet_sql("title || ' ' || categories", f)}, ' / '), '') AS signature FROM pr" for f in FACETS)}),
    pe AS (SELECT query_id, attribute, -sum(p * ln(p)) AS prior FROM ms GROUP BY 1, 2),
    gm AS (SELECT query_id, attribute, signature, sum(p) AS mass FROM ms WHERE signature IS NOT NULL GROUP BY 1, 2, 3),
    gc AS (SELECT query_id, attribute, sum(mass) AS coverage FROM gm GROUP BY 1, 2),
    ge AS (SELECT query_id, attribute, max(coverage) AS coverage, -sum(mass / coverage * ln(mass / coverage)) AS entropy FROM gm JOIN gc USING (query_id, attribute) GROUP BY 1, 2),
    gn AS (SELECT query_id, attribute, round(coalesce(coverage, 0), 9) AS coverage, round(greatest(least(prior, coalesce(coverage * entropy, 0)), 0), 9) AS gain FROM pe LEFT JOIN ge USING (query_id, attribute))"""


@query(f"WITH {MASSES} SELECT * FROM gn")
def facet_entropy(spark, sf_dir):
    return policy.facet_entropy(_masses(spark, sf_dir))


@query(f"""WITH {MASSES}, v AS (SELECT query_id, attribute, round(gain * CASE attribute WHEN 'material' THEN 0.95::DOUBLE WHEN 'color' THEN 0.90::DOUBLE WHEN 'size' THEN 0.70::DOUBLE WHEN 'style' THEN 0.65::DOUBLE ELSE 0.60::DOUBLE END, 6) AS value FROM gn)
    SELECT query_id, attribute, value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, attribute) AS i FROM v) WHERE i = 1""")
def question_information_gain(spark, sf_dir):
    return policy.best_question(policy.facet_entropy(_masses(spark, sf_dir)))


@query(f"""WITH {MASSES} SELECT query_id, attribute, signature, mass, i FROM (
    SELECT query_id, attribute, signature, round(mass, 9) AS mass, row_number() OVER (PARTITION BY query_id, attribute ORDER BY round(mass, 9) DESC, signature) AS i FROM gm) WHERE i <= 3""")
def question_examples(spark, sf_dir):
    return policy.top_examples(_masses(spark, sf_dir))


MARGINS = f"""{RANKED}, t10 AS (SELECT * FROM rk WHERE rank <= 10),
    st AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, arg_max(score, rank) AS last FROM t10 GROUP BY 1),
    ee AS (SELECT query_id, exp(greatest(-50, least(0, (score - s1) / (greatest(abs(s1), abs(last), 1) * 0.05::DOUBLE)))) AS e FROM t10 JOIN st USING (query_id)),
    hh AS (SELECT query_id, -sum(p * ln(p)) AS h FROM (SELECT query_id, e / sum(e) OVER (PARTITION BY query_id) AS p FROM ee) GROUP BY 1),
    mg AS (SELECT query_id, n, round(coalesce(greatest(0, (s1 - s2) / greatest(abs(s1), abs(s2), 1)), 0), 9) AS margin, round(CASE WHEN n < 2 THEN 0 ELSE h / ln(n) END, 9) AS entropy FROM st JOIN hh USING (query_id))"""


@query(f"WITH {MARGINS} SELECT * FROM mg")
def softmax_entropy(spark, sf_dir):
    return policy.margin_and_entropy(_ranked(spark, sf_dir))


@query(f"""WITH {MARGINS} SELECT query_id, turn, CASE WHEN turn = 3 THEN 5 WHEN turn >= 4 THEN 10 WHEN margin >= 0.08::DOUBLE AND entropy <= 0.80::DOUBLE THEN 1
    WHEN margin <= 0.01::DOUBLE OR entropy >= 0.98::DOUBLE THEN 10 ELSE 2 END AS width FROM mg, (SELECT unnest(range(1, 11)) AS turn)""")
def recommendation_width(spark, sf_dir):
    m = policy.margin_and_entropy(_ranked(spark, sf_dir)).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(10))))
    w = policy.width(F.col("margin"), F.col("entropy"), F.col("turn"), F.lit(10), hard_left=F.lit(False), question_value=F.lit(None).cast("double"))
    return m.select("query_id", F.col("turn").cast("long").alias("turn"), w.alias("width"))


@query(f"""WITH {RANKED} SELECT query_id, doc_id, place AS rank FROM (SELECT query_id, doc_id, row_number() OVER (
    PARTITION BY query_id ORDER BY (categories = 'SMALL')::INT DESC, (price > 950)::INT, (size % 5) DESC, score DESC, doc_id) AS place FROM rk) WHERE place <= 10""")
def tier_sort_topk(spark, sf_dir):
    tiers = [F.desc(F.col("categories") == "SMALL"), F.asc(F.col("price") > 950), F.desc(F.col("size") % 5), F.desc("score")]
    return k.tier_sort(_ranked(spark, sf_dir).drop("rank"), tiers=tiers, k=10).select("query_id", "doc_id", "rank")


@query(f"""WITH {RANKED}, a AS (SELECT query_id, doc_id, categories, rank, row_number() OVER (PARTITION BY query_id, categories ORDER BY rank) AS i,
        row_number() OVER (PARTITION BY query_id, categories ORDER BY rating DESC, rank) AS j FROM rk)
    SELECT x.query_id, x.doc_id, x.rank AS old_rank, y.rank AS new_rank FROM a x JOIN a y ON x.query_id = y.query_id AND x.categories = y.categories AND x.j = y.i""")
def tier_preserving_rerank(spark, sf_dir):
    out = k.rerank_within_tiers(_ranked(spark, sf_dir), query="query_id", tier="categories", position="rank", score="rating", doc="doc_id")
    return out.select("query_id", "doc_id", F.col("rank").alias("old_rank"), F.col("new_position").alias("new_rank"))


@query(f"""WITH {RANKED}, n AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS a,
        CASE WHEN max(rating) OVER w > min(rating) OVER w THEN (rating - min(rating) OVER w) / (max(rating) OVER w - min(rating) OVER w) ELSE 1 END AS b FROM rk WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, doc_id, round(0.7::DOUBLE * a + 0.3::DOUBLE * b, 9) AS fused FROM n""")
def minmax_admission_fusion(spark, sf_dir):
    fused = 0.7 * k.min_max(F.col("score"), "query_id") + 0.3 * k.min_max(F.col("rating"), "query_id")
    return _ranked(spark, sf_dir).select("query_id", "doc_id", F.round(fused, 9).alias("fused"))


@query(f"""WITH {CATALOG} SELECT product_id, round(-0.5::DOUBLE + (rating - 3) / 1.2::DOUBLE * 0.8::DOUBLE + (ln(1 + reviews) - 2.5::DOUBLE) / 0.7::DOUBLE * 0.4::DOUBLE + (price - 950) / 30 * -0.1::DOUBLE, 9) AS score FROM cat""")
def linear_admission_score(spark, sf_dir):
    model = {"rating": (3.0, 1.2, 0.8), "reviews": (2.5, 0.7, 0.4), "price": (950.0, 30.0, -0.1)}
    features = {"rating": F.col("rating"), "reviews": F.log1p("reviews"), "price": F.col("price")}
    return catalog(spark, sf_dir).select("product_id", F.round(k.linear_score(features, model, -0.5), 9).alias("score"))


@query(f"""WITH {RANKED}, s AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 20) AS a, max(score) FILTER (rank = 30) AS b FROM rk GROUP BY 1)
    SELECT query_id, round(coalesce((a - b) / greatest(abs(top), 1e-9), 0), 9) AS gap, CASE WHEN coalesce((a - b) / greatest(abs(top), 1e-9), 0) > 0.05::DOUBLE THEN 20 ELSE 30 END AS depth FROM s""")
def adaptive_depth_gap(spark, sf_dir):
    return policy.score_gap(_ranked(spark, sf_dir))


@query(f"""WITH {RANKED} SELECT query_id, doc_id, round(score - v * (max(score) OVER w - min(score) OVER w + 1), 9) AS guarded
    FROM (SELECT *, (price > 980)::INT + (size > 45)::INT AS v FROM rk) WINDOW w AS (PARTITION BY query_id)""")
def constraint_guard_shift(spark, sf_dir):
    v = (F.col("price") > 980).cast("int") + (F.col("size") > 45).cast("int")
    return _ranked(spark, sf_dir).select("query_id", "doc_id", F.round(k.guard_shift(F.col("score"), v, "query_id"), 9).alias("guarded"))


@query("""SELECT p_partkey AS product_id, round(CASE WHEN p_retailprice > 960 THEN -least(1, (p_retailprice - 960) / 960) ELSE 0 END * 0.02::DOUBLE, 9) AS soft FROM part""")
def soft_price_score(spark, sf_dir):
    over = F.greatest(F.lit(0.0), F.col("p_retailprice") - 960)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.round(-F.least(F.lit(1.0), over / 960) * 0.02, 9).alias("soft"))


@query(f"WITH {CATALOG} SELECT product_id, round(CASE WHEN rating > 0 AND rating <= 5 THEN 1 - abs(rating - 4.2::DOUBLE) / 4 ELSE 0 END, 9) AS alignment FROM cat")
def profile_rating_alignment(spark, sf_dir):
    return catalog(spark, sf_dir).select("product_id", F.round(k.profile_alignment(F.col("rating"), F.lit(4.2)), 9).alias("alignment"))


@query("""WITH t AS (SELECT p_partkey AS product_id, string_split(p_name, ' ') AS w FROM part), c AS (SELECT c_custkey % 25 AS profile, list(DISTINCT lower(c_mktsegment)) AS tags FROM customer GROUP BY 1)
    SELECT product_id, len(list_intersect(w, ['red', 'blue', 'small', 'gear']))::INT AS overlap FROM t""")
def profile_tag_overlap(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t in ("red", "blue", "small", "gear")])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.size(F.array_intersect(F.split("p_name", " "), tags)).alias("overlap"))


@query(f"""WITH {RANKED}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rating DESC, doc_id) AS lr FROM rk)
    SELECT query_id, doc_id, round(0.4::DOUBLE * 61 / (61 + rank - 1) + 0.6::DOUBLE * 61 / (60 + lr), 9) AS fused FROM l""")
def logit_rank_fusion(spark, sf_dir):
    lr = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rating"), "doc_id"))
    return _ranked(spark, sf_dir).withColumn("lr", lr).select("query_id", "doc_id", F.round(k.logit_fusion(F.col("rank") - 1, F.col("lr"), 0.6), 9).alias("fused"))


VECTORS = """qv AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
    vs AS (SELECT query_id, vec_id AS doc_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], qe::DOUBLE[]), 9) AS score FROM embeddings e, qv),
    vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= 10)"""


def _vectors(spark, sf_dir, n=10):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return k.vector_top_k(e.withColumnRenamed("vec_id", "doc_id"), q, n)


@query(f"WITH {VECTORS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM vr")
def vector_topk_dot(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTORS}, m AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM vr GROUP BY 1)
    SELECT query_id, doc_id, round(CASE WHEN a >= 0.30::DOUBLE AND a - b >= 0.02::DOUBLE THEN least(1, greatest(0, score)) ELSE 0 END, 6) AS bonus FROM vr JOIN m USING (query_id)""")
def vector_gated_bonus(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("score"))).over(Window.partitionBy("query_id"))
    open_ = (at(1) >= 0.30) & (at(1) - at(2) >= 0.02)
    return v.select("query_id", "doc_id", F.round(F.when(open_, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))).otherwise(0.0), 6).alias("bonus"))


@query(f"""WITH {RANKED}, x AS (SELECT query_id, doc_id, rank, price > 980 AS violation, size < 20 AND rank <= 10 AS seen FROM rk),
    qt AS (SELECT query_id, violation, count(*) AS quota FROM x WHERE rank <= 5 GROUP BY 1, 2),
    pg AS (SELECT query_id, doc_id, violation, seen, i FROM (SELECT *, row_number() OVER (PARTITION BY query_id, violation ORDER BY seen, rank) AS i FROM x) JOIN qt USING (query_id, violation) WHERE i <= quota)
    SELECT query_id, doc_id, violation, seen, row_number() OVER (PARTITION BY query_id ORDER BY violation, i) AS place FROM pg""")
def guarded_page(spark, sf_dir):
    x = _ranked(spark, sf_dir).withColumn("violation", F.col("price") > 980)
    seen = x.filter((F.col("size") < 20) & (F.col("rank") <= 10)).select("query_id", "doc_id")
    return paging.guarded_page(x.select("query_id", "doc_id", "rank", "violation"), seen, 5)


SLATES = """sl AS (SELECT user_id AS session_id, event_id AS turn, event_type AS slate FROM events),
    mk AS (SELECT *, coalesce(lag(slate) OVER (PARTITION BY session_id ORDER BY turn) = slate, false) AS again FROM sl),
    rn AS (SELECT *, sum((NOT again)::INT) OVER (PARTITION BY session_id ORDER BY turn) AS run FROM mk),
    sz AS (SELECT session_id, run, count(*) AS size, sum(again::INT) AS again FROM rn GROUP BY 1, 2)"""


@query(f"WITH {SLATES} SELECT session_id, sum(size)::BIGINT AS turns, sum(again)::BIGINT AS repeated, max(size) AS longest FROM sz GROUP BY 1")
def paging_repeats(spark, sf_dir):
    return paging.repeats(table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("slate")))


@query(f"WITH {SLATES} SELECT longest, count(*) AS sessions FROM (SELECT session_id, max(size) AS longest FROM sz GROUP BY 1) GROUP BY 1")
def slate_streaks(spark, sf_dir):
    return paging_repeats(spark, sf_dir).groupBy("longest").agg(F.count(F.lit(1)).alias("sessions"))


@query("""WITH s AS (SELECT user_id AS session_id, event_id AS turn, floor(value)::INT % 20 AS doc_id, event_type = 'signup' AS reset FROM events),
    e AS (SELECT *, sum(reset::INT) OVER (PARTITION BY session_id ORDER BY turn) AS epoch FROM s)
    SELECT session_id, turn, doc_id, min(turn) OVER (PARTITION BY session_id, epoch, doc_id) < turn AS seen FROM e""")
def seen_since_reset(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), (F.floor("value").cast("int") % 20).alias("doc_id"), (F.col("event_type") == "signup").alias("reset"))
    return paging.seen_before(s).select("session_id", "turn", "doc_id", "seen")


@query("""SELECT p_partkey AS product_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice END AS value, p_size % 4 = 1 AS lower_bound FROM part WHERE p_size % 4 <> 0
    UNION ALL SELECT p_partkey, NULL, false FROM part WHERE p_size % 4 = 0""")
def price_parse(spark, sf_dir):
    text = F.when(F.col("p_size") % 4 == 0, "call us").when(F.col("p_size") % 4 == 1, F.concat(F.lit("from $"), F.col("p_retailprice"))).otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), money(text).alias("m"))
    return m.select("product_id", "m.*")
