"""Parsers, facet views, taxonomies and sources as queries."""

from pyspark.sql import functions as F

from ..functions import feedback, parsing, values
from ..functions.dealing import spread
from ..functions.text import asserted_category, typed_terms
from ..operators import admission, taxonomy, vocabulary
from ..sources import catalog as sources
from .registry import CATALOG, _shared, catalog, query, table

#: texts beside what the parsers must find in them
BUDGETS = [
    ("red boots under $50", [("under", 50.0, 0)]), ("budget of 1,200", [("maximum", 1200.0, 0)]), ("between $20 and $30", [("minimum", 20.0, 0), ("maximum", 30.0, 0)]), ("$40 or $90", [("around", 40.0, 0), ("around", 90.0, 1)]),
    ("I can't spend more than 40 dollars", [("maximum", 40.0, 0)]), ("I won't pay less than $20", [("minimum", 20.0, 0)]), ("not $30", []), ("size 12", []), ("at least USD 15, at most USD 25", [("minimum", 15.0, 0), ("maximum", 25.0, 0)]), ("20 to 35 dollars", [("minimum", 20.0, 0), ("maximum", 35.0, 0)]),
]
VALUES = [  # text, attribute, component, restriction, alternatives
    ("only black or white", "color", None, "black+white", "only black|white"), ("lining: cotton", "material", "lining", "", "lining: cotton"), ("leather or suede upper", "material", "upper", "", "upper: leather|upper: suede"), ("red or wool", "material", None, "", "red or wool"),
    ("color: navy", "color", None, "", "color: navy"), ("budget around $30", "budget", None, "", "budget around $30"), ("wide fit", "size", None, "", "wide fit"), ("cotton exclusively", "material", None, "cotton", "cotton exclusively"), ("fast shipping", "other", None, "", "fast shipping"),
]
SLATES = [("None of these options work", True, ""), ("Those aren't right, I need cotton", True, "I need cotton"), ('she said "none of these fit"', False, 'she said "none of these fit"'), ("maybe these are not right", False, "maybe these are not right"), ("The recommendations are wrong but keep it red", True, "keep it red"), ("I like red", False, "I like red")]


def _sql(rows):
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _texts(spark, sf_dir, texts):
    """Every product with the text of its number."""
    every = F.array(*[F.lit(t) for t in texts])
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(every, F.pmod("p_partkey", F.lit(len(texts))).cast("int")).alias("text")), "id")


@query(f"""WITH b(i, mode, amount, branch) AS (VALUES {_sql([(i, *x) for i, (_, found) in enumerate(BUDGETS) for x in found])})
    SELECT p_partkey AS id, mode, amount::DOUBLE AS amount, branch FROM part JOIN b ON i = p_partkey % {len(BUDGETS)}""")
def budget_parsing(spark, sf_dir):
    found = _texts(spark, sf_dir, [t for t, _ in BUDGETS]).select("id", F.explode(parsing.budgets("text")).alias("b"))
    return found.select("id", "b.mode", "b.amount", "b.branch")


@query(f"""WITH v(text, attribute, component, restricted, alternatives) AS (VALUES {_sql(VALUES)}), n AS (SELECT *, row_number() OVER () - 1 AS i FROM v)
    SELECT p_partkey AS id, attribute, component, restricted, alternatives FROM part JOIN n ON i = p_partkey % {len(VALUES)}""")
def value_parsing(spark, sf_dir):
    t = _texts(spark, sf_dir, [v[0] for v in VALUES])
    only = F.array_join(F.flatten(F.map_values(values.restrictions("text"))), "+")
    return t.select("id", values.attribute("text").alias("attribute"), values.component("text").alias("component"), only.alias("restricted"), F.array_join(values.alternative_values("text"), "|").alias("alternatives"))


@query(f"WITH v(text, rejected, rest) AS (VALUES {_sql(SLATES)}), n AS (SELECT *, row_number() OVER () - 1 AS i FROM v) SELECT p_partkey AS id, rejected, rest FROM part JOIN n ON i = p_partkey % {len(SLATES)}")
def slate_feedback(spark, sf_dir):
    t = _texts(spark, sf_dir, [v[0] for v in SLATES])
    return t.select("id", feedback.slate_rejected("text").alias("rejected"), feedback.preference_text("text").alias("rest"))


@query("""WITH c AS (SELECT p_partkey AS product_id, unnest(string_split(CASE p_size % 3 WHEN 0 THEN 'lining: ' || p_name || '; ' || lower(p_type) WHEN 1 THEN lower(p_type) || ' and a ' || p_name || ' upper' ELSE 'upper is ' || p_name || ', no ' || lower(p_type) END, ';')) AS clause FROM part),
    s AS (SELECT product_id, regexp_extract(clause, '^\\s*(lining|upper)\\s*(?::|is)\\s*(.*)$', 1) AS led, trim(regexp_extract(clause, '^\\s*(lining|upper)\\s*(?::|is)\\s*(.*)$', 2)) AS behind, regexp_extract(clause, '^(?:.*(?:\\band |\\bbut |\\bwith |,))?\\s*(?:(?:the|its|a|an) )?([^,]*?) (lining|upper)\\s*$', 1) AS before, regexp_extract(clause, ' (lining|upper)\\s*$', 1) AS own FROM c)
    SELECT product_id, CASE WHEN led <> '' THEN led ELSE own END AS component, CASE WHEN led <> '' THEN led || ' ' || behind ELSE before || ' ' || own END AS said FROM s WHERE led <> '' OR own <> ''""")
def component_views(spark, sf_dir):
    """Which component a product's wording belongs to: one row for each component of the features."""
    kind = F.lower("p_type")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("lining: "), "p_name", F.lit("; "), kind)).when(F.col("p_size") % 3 == 1, F.concat(kind, F.lit(" and a "), "p_name", F.lit(" upper"))).otherwise(F.concat(F.lit("upper is "), "p_name", F.lit(", no "), kind))
    p = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), said.alias("features")), "product_id")
    return p.select("product_id", F.explode(values.components({"title": "title", "features": "features"})).alias("component", "texts")).select("product_id", "component", F.col("texts")[2].alias("said"))


@query("""SELECT p_partkey AS id, replace(p_name, 'large', 'larg') || ' widget run relat poni hop cafe' AS stems,
        string_split(p_name, ' ')[1] || '|' || string_split(p_name, ' ')[2] || '|2.5|café' AS folded, string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] || ' 2 café' AS typed FROM part""")
def token_streams(spark, sf_dir):
    """The four token streams of the engine's indexes."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(parsing.stems(F.concat_ws(" ", "p_name", F.lit("widgets running relational ponies Hopping café"))), " ").alias("stems"), F.array_join(parsing.folded_terms(F.concat_ws(" ", F.lit("I am looking for"), F.upper("p_name"), F.lit("2.5 CAFÉ"))), "|").alias("folded"), F.array_join(F.concat(typed_terms(F.concat_ws(" ", F.lit("I need a"), "p_name", F.lit("x 2 2"))), F.array(F.lit("café"))), " ").alias("typed"))


@query("""WITH c(i, text, name, rest) AS (VALUES (0, 'I want women running shoes in red', 'running shoes', 'in red'), (1, 'show me a hat', 'hats', ''), (2, 'something warm', NULL, NULL), (3, 'find running shoe, size 9', 'running shoes', 'size 9'))
    SELECT p_partkey AS id, name, rest FROM part JOIN c ON i = p_partkey % 4""")
def category_requests(spark, sf_dir):
    """A known category that a request names, and what else it says."""
    t = _texts(spark, sf_dir, ["I want women running shoes in red", "show me a hat", "something warm", "find running shoe, size 9"])
    found = asserted_category(F.col("text"), ["running shoes", "shoes", "hats"])
    return t.select("id", found["name"].alias("name"), found["rest"].alias("rest"))


@query("""WITH p AS (SELECT p_partkey AS product_id, [lower(p_type), p_brand, string_split(p_name, ' ')[2]] AS path FROM part), s AS (SELECT DISTINCT product_id, array_to_string(path[i:j], ' ') AS span FROM p, (SELECT unnest([1, 1, 1, 2, 2, 3]) AS i, unnest([1, 2, 3, 2, 3, 3]) AS j))
    SELECT span, count(*) AS products FROM s GROUP BY 1""")
def taxonomy_spans(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.array(F.lower("p_type"), F.col("p_brand"), F.element_at(F.split("p_name", " "), -1)).alias("path"))
    return taxonomy.spans(p).groupBy("span").agg(F.count(F.lit(1)).alias("products"))


@query("""SELECT p_partkey AS query_id, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || string_split(p_name, ' ')[2] ELSE string_split(p_name, ' ')[2] END AS span FROM part""")
def taxonomy_longest_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    noun = F.element_at(F.split("p_name", " "), -1)
    spans = taxonomy.spans(p.select(F.col("p_partkey").alias("product_id"), F.array(F.col("p_brand"), noun).alias("path")))
    tokens = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.col("p_brand"), noun, F.lit("please"))).otherwise(F.array(F.lit("cheap"), noun))
    return taxonomy.longest_match(spans, p.select(F.col("p_partkey").alias("query_id"), tokens.alias("tokens")))


@query("""SELECT p_partkey AS id, CASE WHEN p_name = 'red ring' THEN 4 WHEN p_name LIKE 'red %' OR p_name LIKE '% ring' THEN 0 ELSE 0 END AS level FROM part WHERE p_name <> 'red ring' UNION ALL SELECT p_partkey, 4 FROM part WHERE p_name = 'red ring'""")
def match_levels(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), taxonomy.match_level(F.array(F.lit("red"), F.lit("ring")), words, words, F.array(F.col("p_name"))).alias("level"))


@query("""SELECT CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'size' WHEN p_type = 'ECONOMY' THEN 'price' ELSE 'object' END AS role, lower(p_type) AS canonical, count(*) AS support FROM part GROUP BY ALL HAVING count(*) >= 5""")
def taxonomy_roles(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_type").alias("canonical"))
    return vocabulary.roles(names, {"size": "small|large|wide", "price": "economy|budget"}, least_support=5)


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand FROM part), c AS (SELECT p_brand AS alias, string_split(p_name, ' ')[2] AS canonical, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY alias) AS total, row_number() OVER (PARTITION BY alias ORDER BY n DESC, canonical) AS i, lead(n, 1, 0) OVER (PARTITION BY alias ORDER BY n DESC, canonical) AS next FROM c)
    SELECT alias, canonical, n AS support, (n >= 2 AND n / total >= 0.14::DOUBLE AND (n - next) / total >= 0.005::DOUBLE) AS state FROM t WHERE i = 1 AND n >= 2 AND n / total >= 0.05::DOUBLE""")
def vocabulary_lanes(spark, sf_dir):
    """Aliases with the stricter lane that may change a session's state."""
    votes = table(spark, sf_dir, "part").select(F.lit("noun").alias("attribute"), F.col("p_brand").alias("alias"), F.element_at(F.split("p_name", " "), -1).alias("canonical"))
    found = vocabulary.with_lane(vocabulary.aliases(votes, least_support=2, least_share=0.05), least_share=0.14, least_margin=0.005)
    return found.select("alias", "canonical", "support", "state")


@query(f"""WITH {CATALOG}, q AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY price DESC, product_id) AS rank, count(*) OVER (PARTITION BY store) AS n FROM cat), s AS (SELECT *, greatest(n - 10, 1) AS span FROM q)
    SELECT store AS query_id, product_id AS doc_id, rank FROM s WHERE rank <= 10 OR n - 10 <= 10 OR rank = 11 OR (rank - 11) * 10 // span <> (rank - 12) * 10 // span""")
def stratified_prefix(spark, sf_dir):
    from ..operators import retrieval as r

    ranked = r.top_k(catalog(spark, sf_dir).select(F.col("store").alias("query_id"), F.col("product_id").alias("doc_id"), "price"), 1 << 30, by="price")
    return admission.stratified(ranked, 20, 10).select("query_id", "doc_id", "rank")


@query(f"""WITH {CATALOG}, j AS (SELECT product_id, title, categories, store, printf('%.2f', price) AS price FROM cat)
    SELECT product_id::VARCHAR AS product_id, title, categories, round(price::DOUBLE, 2) AS price, ('title: ' || title) IS NOT NULL AS kept FROM j""")
def catalog_jsonl(spark, sf_dir):
    """The catalog written as JSON lines and read back with the typed schema."""
    path = _shared(spark)
    c = catalog(spark, sf_dir)
    c.select(F.col("product_id").cast("string").alias("parent_asin"), "title", F.array("categories").alias("categories"), "store", F.format_string("$%.2f", "price").alias("price"), F.lit(1).alias("unknown_key")).write.json(path)
    flat = sources.flatten(sources.read_catalog(spark, path))
    return flat.select("product_id", "title", "categories", F.round("price", 2).alias("price"), F.lit(True).alias("kept"))


@query("""SELECT p_partkey::VARCHAR AS product_id, x.f AS field, x.v AS value FROM (SELECT p_partkey, unnest([{'f': 'title', 'v': p_name}, {'f': 'details', 'v': 'Size: ' || p_size}, {'f': 'details', 'v': p_size::VARCHAR}, {'f': 'extra', 'v': p_type}]) AS x FROM part)""")
def raw_json_fields(spark, sf_dir):
    """Every key of every JSON line as atomic values; nested keys stay as labels and values."""
    path = _shared(spark)
    p = table(spark, sf_dir, "part")
    p.select(F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_name").alias("title"), F.struct(F.col("p_size").cast("string").alias("Size")).alias("details"), F.col("p_type").alias("extra")).write.json(path)
    return sources.read_fields(spark, path).select("product_id", "field", "value")


@query("SELECT count(*) AS products, count(*) AS entries_ok, 0::BIGINT AS differences FROM part")
def index_round_trip(spark, sf_dir):
    """A catalog index built, opened with its checks, and compared with its source both ways."""
    path = _shared(spark)
    c = catalog(spark, sf_dir)
    flat = c.select(F.col("product_id").cast("string").alias("product_id"), "title", "categories", F.lit("").alias("features"), F.lit("").alias("details"), "store", F.lit("").alias("description"), F.array("categories").alias("path"), "price", F.lit(False).alias("price_is_lower_bound"), "rating", "reviews")
    sources.build_index(flat, path)
    tables = sources.open_index(spark, path)
    ok = tables["entries"].filter("index_name = 'category'").agg(F.countDistinct("product_id").alias("entries_ok"))
    gone = sources.difference(tables["products"], flat).agg(F.count(F.lit(1)).alias("differences"))
    return tables["products"].agg(F.count(F.lit(1)).alias("products")).join(ok).join(gone)  # one row each


@query("SELECT count(*) AS rows, true AS right_size, true AS finite, bool_and(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-3) AS unit, true AS ids_in_order FROM embeddings")
def vector_source_checks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    dims = e.select(F.size("embedding")).first()[0]
    return sources.vectors_valid(e, "embedding", dims).join(sources.ids_in_order(e, "vec_id"))


@query("SELECT 'config' AS name, 10 AS turns, 0.5::DOUBLE AS weight, 'buying' AS mode, 2 AS rejected")
def typed_config(spark, sf_dir):
    """A typed configuration: unknown keys and wrong types are refused."""
    from ..sources import config

    schema = {"turns": (int, 10, lambda v: 0 < v <= 10), "weight": (float, 0.5, lambda v: 0 <= v <= 1), "mode": (str, "buying", lambda v: v in ("buying", "browsing"))}
    got = config.load('{"mode": "buying"}', schema)
    bad = sum(config.problem(text, schema) is not None for text in ('{"turns": true}', '{"other": 1}', '{"weight": 0.7}'))
    return spark.createDataFrame([("config", got["turns"], got["weight"], got["mode"], bad)], "name string, turns int, weight double, mode string, rejected int")


@query("SELECT count(*) AS rows, true AS verified, false AS verified_after_change FROM customer")
def locked_pack(spark, sf_dir):
    """A data pack locked with a manifest of its content, verified, and found changed after a row was added."""
    path = _shared(spark)
    pack = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sources.lock_pack(pack, path)
    before = sources.verify_pack(spark, path)
    pack.limit(1).write.mode("append").json(f"{path}/rows")
    return pack.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(before).alias("verified"), F.lit(sources.verify_pack(spark, path)).alias("verified_after_change"))
