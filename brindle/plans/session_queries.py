"""Dialogue, streaming, lexical search and training queries."""

from pyspark.sql import functions as F

from ..functions.dealing import spread
from ..operators import fusion, learning, lexical, retrieval as r
from ..streaming import ledger, windows
from .registry import CATALOG, _shared, catalog, query, table


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def activity_windows(spark, sf_dir):
    return windows.activity(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def activity_stream(spark, sf_dir):
    """The same windows from a stream over the table, run to its end."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    return windows.run_to_end(windows.activity(stream), _shared(spark), "complete").withColumn("total", F.round("total", 4))


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


#: customers' scripts: (script, turn, message, attribute asked before); {noun}, {store} and {price} are the product's
SCRIPTS = [
    (0, 1, "I'm looking for {noun}. A key requirement is: cotton.", None),
    (0, 2, "For that, what matters is: color: red; budget around ${price}.", None),
    (0, 3, "I don't have an additional preference for size.", "size"),
    (0, 4, "Actually, ignore my earlier preference. What I need is: {store}.", None),
    (1, 1, "I'm looking for {noun}, but I'm still exploring.", None),
    (1, 2, "red cotton", "color"),
    (1, 3, "Correction: make that blue", None),
    (1, 4, "no wool and I want black lining", None),
    (2, 1, "I'm looking for {noun}. red", None),
    (2, 2, "Make that blue but keep the red as an option", None),
    (2, 3, "I can't spend more than ${price}", "budget"),
    (3, 1, "maybe red", None),
    (3, 2, 'the label says "no cotton"', None),
    (3, 3, "cotton rather than wool", None),
    (3, 4, "These options are not right, I need nylon", None),
    (4, 1, "I'm looking for {noun}. 60% cotton 40% wool", None),
    (4, 2, "change that to 80% cotton", None),
    (4, 3, "leather or suede", "material"),
    (4, 4, "not suede", None),
    (5, 1, "I'm looking for {noun}. red under ${price}", None),
    (5, 2, "Actually, I need blue; budget around ${price}", None),
    (5, 2, "What I need is: green", None),
    (5, 3, "I'm looking for hats instead", None),
    (6, 1, "size wide", "size"),
    (6, 2, "lining: cotton", None),
    (6, 3, "make that lining: wool", None),
    (6, 4, "I don't have a preference for size, but I always want walking shoes", None),
]


def _messages(spark, sf_dir, dealt=False):
    """Each product as the target of a session that follows one of the scripts; dealt: written by all cores, where nothing deals the messages behind it."""
    c = spread(catalog(spark, sf_dir), "product_id") if dealt else catalog(spark, sf_dir)
    kind = "array<struct<script:int,turn:int,message:string,asked:string>>"
    rows = F.array(*[F.struct(F.lit(s).alias("script"), F.lit(t).alias("turn"), F.lit(m).alias("message"), F.lit(q).alias("asked")) for s, t, m, q in SCRIPTS]).cast(kind)
    mine = F.filter(rows, lambda x: x["script"] == F.pmod(F.col("product_id"), F.lit(7)))
    noun = F.element_at(F.split("title", " "), -1)
    text = F.replace(F.replace(F.replace(F.col("m.message"), F.lit("{noun}"), noun), F.lit("{store}"), F.col("store")), F.lit("{price}"), F.format_string("%.2f", F.col("price")))
    return c.withColumn("m", F.explode(mine)).select(F.col("product_id").alias("session_id"), "m.turn", text.alias("message"), "m.asked")


#: what the scripts leave: (script, source, attribute, text, turn, derivation)
LEFT = """left_of(script, source, attribute, text, turn, derivation) AS (VALUES
    (0, 'category', 'category', '{noun}', 1, NULL), (0, 'hard_constraint', NULL, 'cotton', 1, NULL), (0, 'clarification', NULL, 'color: red', 2, NULL), (0, 'clarification', NULL, 'budget around ${price}', 2, NULL), (0, 'override', 'size', '{store}', 4, NULL),
    (1, 'category', 'category', '{noun}', 1, NULL), (1, 'clarification', 'color', 'cotton', 2, 'facet_removed'), (1, 'override', 'color', 'blue', 3, NULL), (1, 'exclusion', 'material', 'wool', 4, NULL), (1, 'clarification', 'color', 'I want black lining', 4, NULL),
    (2, 'category', 'category', '{noun}', 1, NULL), (2, 'override', 'color', 'blue or red', 2, 'kept_facet_alternative'), (2, 'clarification', 'budget', 'I can''t spend more than ${price}', 3, NULL),
    (3, 'exclusion', 'material', 'wool', 3, NULL), (3, 'clarification', NULL, 'cotton', 3, NULL), (3, 'clarification', NULL, 'I need nylon', 4, NULL),
    (4, 'category', 'category', '{noun}', 1, NULL), (4, 'override', 'material', '80% cotton', 2, NULL), (4, 'clarification', 'material', 'leather', 3, 'excluded_alternative_removed'), (4, 'exclusion', 'material', 'suede', 4, NULL),
    (5, 'category', 'category', 'hats', 3, NULL), (5, 'clarification', 'color', 'I need blue', 2, NULL), (5, 'clarification', 'budget', 'budget around ${price}', 2, NULL),
    (6, 'override', 'material', 'lining: wool', 3, NULL), (6, 'clarification', 'size', 'I always want walking shoes', 4, NULL))"""
_FILL = "replace(replace(replace({x}, '{{noun}}', string_split(p_name, ' ')[-1]), '{{store}}', p_brand), '{{price}}', printf('%.2f', p_retailprice))"


@query(f"WITH {LEFT} SELECT p_partkey AS session_id, source, attribute, {_FILL.format(x='text')} AS text, turn, derivation FROM part JOIN left_of ON script = p_partkey % 7")
def dialogue_fold(spark, sf_dir):
    """Corrections, kept options, contrasts, denials, doubts, reports, taken back, declined and stale turns, with budgets."""
    return ledger.fold(_messages(spark, sf_dir)).select("session_id", "source", "attribute", "text", "turn", "derivation")


@query(f"""WITH s(script, category, declined, semantic_query) AS (VALUES
    (0, '{{noun}}', 'size', 'Product category: {{noun}}' || chr(10) || 'Required features: cotton; color: red; budget around ${{price}}; {{store}}'),
    (1, '{{noun}}', '', 'Product category: {{noun}}' || chr(10) || 'Required features: cotton; blue; black lining'),
    (2, '{{noun}}', '', 'Product category: {{noun}}' || chr(10) || 'Required features: blue or red; I can''t spend more than ${{price}}'),
    (3, '', '', 'Required features: cotton; nylon'),
    (4, '{{noun}}', '', 'Product category: {{noun}}' || chr(10) || 'Required features: 80% cotton; leather'),
    (5, 'hats', '', 'Product category: hats' || chr(10) || 'Required features: blue; budget around ${{price}}'),
    (6, '', 'size', 'Required features: lining: wool; I always want walking shoes'))
    SELECT p_partkey AS session_id, {_FILL.format(x='category')} AS category, declined, {_FILL.format(x='semantic_query')} AS semantic_query FROM part JOIN s ON script = p_partkey % 7""")
def session_standing(spark, sf_dir):
    """Category, declined attributes and the semantic query after each session's last turn."""
    return ledger.standing(_messages(spark, sf_dir)).select("session_id", "category", "declined", "semantic_query")


@query(f"""WITH {LEFT}, one AS (SELECT script, to_json(list([source, coalesce(attribute, ''), lower(text)] ORDER BY source, coalesce(attribute, ''), lower(text))) AS facts FROM left_of GROUP BY 1)
    SELECT p_partkey AS session_id, sha256(facts) AS signature FROM part JOIN one ON script = p_partkey % 7 WHERE script IN (3, 6)""")
def session_signature(spark, sf_dir):
    """The semantic signature of sessions whose facts do not depend on the product."""
    return ledger.standing(_messages(spark, sf_dir)).filter("session_id % 7 in (3, 6)").select("session_id", "signature")


@query("""WITH s(script, accepted, rejected, evidence) AS (VALUES (0, 4, 0, 5), (1, 4, 0, 5), (2, 3, 0, 3), (3, 4, 0, 3), (4, 4, 0, 4), (5, 3, 1, 3), (6, 4, 0, 2))
    SELECT p_partkey AS session_id, accepted, rejected, evidence FROM part JOIN s ON script = p_partkey % 7""")
def session_stream_state(spark, sf_dir):
    """The ledger as a keyed stream: every session's turns arrive once, and its state is read after the last."""
    path = _shared(spark)
    said = _messages(spark, sf_dir, dealt=True).drop("asked")
    said.write.parquet(path)
    stream = spark.readStream.schema("session_id bigint, turn int, message string").parquet(path)
    out = windows.run_to_end(ledger.follow(stream), f"{path}-run", "append")
    count = lambda s: F.sum((F.col("status") == s).cast("int")).cast("int")
    return out.groupBy("session_id").agg(count("accepted").alias("accepted"), count("rejected").alias("rejected"), F.max_by("evidence", F.struct("turn", F.col("status") == "accepted")).alias("evidence"))


def _dialogues(spark, sf_dir):
    """Each product as the target of a four-turn session in the simulator's wording."""
    c = catalog(spark, sf_dir)
    first, last = F.element_at(F.split("title", " "), 1), F.element_at(F.split("title", " "), -1)
    messages = [
        F.concat(F.lit("I'm looking for "), last, F.lit(". A key requirement is: "), first, F.lit(".")),
        F.concat(F.lit("For that, what matters is: "), F.lower("categories"), F.lit("; budget around $"), F.col("price").cast("string"), F.lit(".")),
        F.lit("I don't have an additional preference for size."),
        F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), F.col("store"), F.lit(".")),
    ]
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), m.alias("message")) for i, m in enumerate(messages, 1)])
    return c.select(F.col("product_id").alias("session_id"), F.explode(turns).alias("t")).select("session_id", "t.*")


def _flat(spark, sf_dir):
    c = catalog(spark, sf_dir)
    kind = F.concat_ws(" ", F.lower("categories"), F.element_at(F.split("title", " "), -1))  # the title's noun is the leaf
    return c.select("product_id", "title", kind.alias("categories"), F.lit("").alias("features"), F.lit("").alias("details"), "store", F.lit("").alias("description"), "price", "rating", "reviews")


EVIDENCE = [("ring", "category", 1.4), ("red", "hard_constraint", 3.8), ("leather upper", "clarification", 2.5), ("small", "exclusion", 3.8), ("under $950", "hard_constraint", 3.8), ("around $930", "clarification", 2.0), ("cotton", "override", 6.0)]
_SAID = ["without red", "red-free", "faux leather", "60% cotton lining", "leather upper with strap", "replacement strap", "grey rods"]


@query(f"""WITH {CATALOG}, it AS (SELECT *, [{", ".join(f"'{w}'" for w in _SAID)}][size % 7 + 1] AS said, size % 7 AS k, string_split(title, ' ')[1] AS adj, lower(categories) AS typ FROM cat WHERE title LIKE '% ring'),
    x AS (SELECT *, adj = 'red' OR k IN (0, 1) AS has_red, k = 3 AS has_cotton, adj = 'small' OR typ = 'small' AS has_small, adj = 'red' AS says_red,
        (CASE WHEN adj = 'red' THEN 4.0 WHEN k IN (0, 1) THEN 2.8 ELSE 0 END)::DOUBLE AS w_red, greatest(CASE WHEN adj = 'small' THEN 4.0 ELSE 0 END, CASE WHEN typ = 'small' THEN 3.0 ELSE 0 END)::DOUBLE AS w_small,
        CASE WHEN price < 950 THEN 0 ELSE greatest((price - 950) / 950, 0.001) END::DOUBLE AS over, list_filter(['red', 'grey', 'blue'], lambda c: (c = 'red' AND (adj = 'red' OR k IN (0, 1))) OR (c = 'grey' AND k = 6) OR (c = 'blue' AND adj = 'blue')) AS colors, k IN (2, 4) AS leather FROM it),
    s AS (SELECT *, 1.4::DOUBLE * (1.9::DOUBLE + 0.4::DOUBLE + 0.45::DOUBLE)
        + 3.8::DOUBLE * (1.9::DOUBLE * has_red::INT + 0.1::DOUBLE * w_red + 0.45::DOUBLE * has_red::INT) + 2.5::DOUBLE * CASE k WHEN 4 THEN 1.9::DOUBLE + 0.4::DOUBLE * 2.8::DOUBLE / 4 + 0.99::DOUBLE + 0.45::DOUBLE WHEN 2 THEN 0.95::DOUBLE + 0.4::DOUBLE * 2.8::DOUBLE / 8 ELSE 0 END
        + 6 * CASE WHEN has_cotton THEN 1.9::DOUBLE + 0.4::DOUBLE * 2.8::DOUBLE / 4 + 0.45::DOUBLE ELSE 0 END - 3.8::DOUBLE * CASE WHEN has_small THEN 1.9::DOUBLE + 0.1::DOUBLE * w_small + 0.45::DOUBLE ELSE 0 END AS c,
        1.4::DOUBLE * 3.8::DOUBLE * (1 - over) + 1.4::DOUBLE * 2 * (1 - abs(price - 930) / 930) AS p, greatest(0, least(5, rating)) * 0.02::DOUBLE + 1.05::DOUBLE * ln(1 + reviews) AS q,
        3.8::DOUBLE * (CASE WHEN has_red THEN 0.3::DOUBLE ELSE -0.25::DOUBLE END - 0.5::DOUBLE * (len(colors) > 0 AND NOT list_contains(colors, 'red'))::INT) + 6 * (CASE WHEN has_cotton THEN 0.3::DOUBLE ELSE -0.25::DOUBLE END - 0.5::DOUBLE * leather::INT) AS f, -3.8::DOUBLE * 0.5::DOUBLE * least(over, 2) AS b FROM x),
    t AS (SELECT product_id, round(0.85::DOUBLE + c + p + q + f + b, 9) AS score, has_small OR over > 0 OR (k IN (0, 1) AND NOT says_red) AS violation, (has_red AND k NOT IN (0, 1))::INT + has_cotton::INT AS hard_exact FROM s)
    SELECT * FROM (SELECT product_id, round(score, 6) AS score, violation, hard_exact, row_number() OVER (ORDER BY violation, (hard_exact = 2)::INT DESC, hard_exact DESC, score DESC, product_id) AS rank FROM t) WHERE rank <= 60""")
def lexical_order(spark, sf_dir):
    """The default backend's scores and tiers for one compiled request, with limits, exclusions and clashing facets."""
    c = catalog(spark, sf_dir)
    said = F.get(F.array(*[F.lit(w) for w in _SAID]), (F.col("size") % 7).cast("int"))
    kind = F.concat_ws(" ", F.lower("categories"), F.element_at(F.split("title", " "), -1))
    flat = c.select("product_id", "title", kind.alias("categories"), said.alias("features"), F.lit("").alias("details"), F.lit("").alias("store"), F.lit("").alias("description"), "price", "rating", "reviews")
    evidence = spark.createDataFrame([(1, *e) for e in EVIDENCE], "query_id int, text string, source string, weight double")
    every = c.select(F.lit(1).alias("query_id"), "product_id", F.lit(0.01).alias("rrf"))
    ranked = lexical.rank(every, lexical.product_features(flat), evidence, k=60)
    return ranked.select("product_id", F.round("score", 6).alias("score"), "violation", "hard_exact", "rank")


@query()
def lexical_search(spark, sf_dir):
    """The default backend end to end: folded dialogues, two routes, fusion, scores and tiers; one session for every different title."""
    flat = r.write_once(_flat(spark, sf_dir), _shared(spark))
    first = flat.groupBy("title").agg(F.min("product_id").alias("session_id"))
    folded = ledger.fold(_dialogues(spark, sf_dir).join(first, "session_id", "left_semi")).withColumnRenamed("session_id", "query_id")
    evidence = r.write_once(folded.select("query_id", "text", "source", "weight"), _shared(spark))
    tokens = evidence.select("query_id", "source", F.explode(r.terms("text")).alias("token"))
    broad, category = _catalog_routes(spark, flat, tokens)
    routes = broad.withColumn("route", F.lit("broad")).unionByName(category.withColumn("route", F.lit("category"))).withColumn("weight", F.lit(1.0))
    fused = r.write_once(fusion.reciprocal_rank(routes).select("query_id", F.col("doc_id").alias("product_id"), F.col("score").alias("rrf")), _shared(spark))
    held = flat.join(fused.select("product_id").distinct(), "product_id", "left_semi")  # features cost more than a join, and only candidates need them
    return lexical.rank(fused, lexical.product_features(held), evidence)


def _catalog_routes(spark, flat, tokens):
    """Products by all tokens and by those of the category, from rows that are counted once."""
    post = r.postings(flat, "product_id", {f: f for f in ("title", "categories", "store")})
    weights = {"title": 4, "categories": 8, "store": 1}
    own = tokens.filter("source = 'category'")
    vocabulary = r.vocabulary_of(tokens, 200_000)
    if vocabulary is None:
        return r.bm25(post, tokens, weights=weights, k=350), r.bm25(post, own, weights=weights, k=180)
    counted = r.count_postings(post, vocabulary, weights=weights, path=_shared(spark))
    return r.bm25_counted(counted, tokens, 350), r.bm25_counted(counted, own, 180)


@query()
def admission_training(spark, sf_dir):
    """Coefficients of the class-balanced logistic admission model for returned lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    features = ["l_quantity", "l_discount", "l_tax"]
    model = learning.admission_model(rows, features, "label", rounds=20).stages[-1]
    return spark.createDataFrame([(f, round(float(w), 6)) for f, w in zip(features, model.coefficients)] + [("intercept", round(float(model.intercept), 6))], "feature string, weight double")


@query()
def pairwise_training(spark, sf_dir):
    """Pair accuracy of a linear ranker trained on rating against price and reviews, within stores."""
    c = catalog(spark, sf_dir).select("product_id", "store", ((F.col("price") - 950) / 30).alias("price"), F.log1p("reviews").alias("reviews"), F.when(F.col("rating") > 3.7, 1).otherwise(-1).alias("label"))
    pairs = learning.product_pairs(c, "store", "product_id", ["price", "reviews"], "label")
    w = learning.pairwise_ranker(pairs, ["price", "reviews"], epochs=5)
    return learning.pair_accuracy(pairs, ["price", "reviews"], w).select("pairs", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))
