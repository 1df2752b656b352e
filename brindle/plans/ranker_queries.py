"""Linear rankers and stemmed retrieval over the catalog stand-in."""

from pyspark.sql import functions as F

from ..functions.parsing import stems
from ..functions.text import FACETS, affirmed, facet, terms
from ..operators import catalog_ranker as c, evidence as e, presentation as show, retrieval as r
from .evidence_queries import ITEMS, _items
from .registry import BM25_SCORE, catalog, query

ITEMS_ASKED = [("red gear", "hard_constraint"), ("leather upper", "clarification"), ("small", "exclusion"), ("ring", "category")]
#: terms that the wordings affirm
_AFF = "[[], [], ['faux', 'leather'], ['60', 'cotton', 'lining'], ['leather', 'upper', 'strap'], ['replacement', 'strap'], ['grey', 'rods']]"
RANKER = f"""{ITEMS}, fx AS (SELECT *, string_split(title, ' ')[1] AS adj, string_split(title, ' ')[2] AS noun, {_AFF}[size % 7 + 1] AS fa, size % 7 AS k FROM it),
    ft AS (SELECT *, ((adj = 'red')::INT + (noun = 'gear')::INT) / 2 AS t1, (CASE k WHEN 4 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END)::DOUBLE AS f2,
        (adj = 'blue' OR k = 6)::INT * (adj <> 'red')::INT AS x1, (k = 3)::INT AS x2, (adj = 'small' OR categories = 'SMALL')::INT AS ex, (noun = 'ring')::INT AS cc FROM fx)"""


def _features(spark, sf_dir):
    kind = F.concat_ws(" ", F.lower("categories"), F.element_at(F.split("title", " "), -1))
    none = F.array().cast("array<string>")
    seq = F.array(terms(affirmed("title")), terms(kind), terms(affirmed("features")), none, none, none)
    asked = F.array(*[F.struct(terms(F.lit(t)).alias("tokens"), F.lit(s).alias("source"), F.map_from_arrays(F.array(*[F.lit(f) for f in FACETS]), F.array(*[facet(F.lit(t), f) for f in FACETS])).alias("facets")) for t, s in ITEMS_ASKED])
    rows = _items(spark, sf_dir).withColumn("seq", seq).withColumn("asked", asked)
    return rows.withColumn("f", c.field_features(F.col("asked"), F.col("seq"), F.array(F.lit("ring")), terms(kind)))


@query(f"""WITH {RANKER} SELECT query_id, doc_id, round(t1 / 2, 9) AS title_token_coverage, round(f2 / 2, 9) AS features_token_coverage, round((title = 'red gear')::INT / 2, 9) AS title_phrase_support, round((k = 4)::INT / 2, 9) AS features_phrase_support,
    round((title = 'red gear')::INT / 2, 9) AS whole_field_support, round((t1 + f2) / 2, 9) AS best_field_coverage, round((t1 + f2) / 2, 9) AS cross_field_coverage, round(1 - (t1 + f2) / 2, 9) AS missing_information, round((x1 + x2) / 2, 9) AS facet_contradiction, ex::DOUBLE AS exclusion_match, cc::DOUBLE AS category_coverage FROM ft""")
def ranker_features(spark, sf_dir):
    names = [n for n in c.FEATURES if not n.startswith(("details", "description"))]
    return _features(spark, sf_dir).select("query_id", "doc_id", *[F.round(f"f.{n}", 9).alias(n) for n in names])


@query(f"""WITH {RANKER}, s AS (SELECT *, round(2 * t1 / 2 + 1.5::DOUBLE * (t1 + f2) / 2 - (x1 + x2) / 2 - 3 * ex + 0.5::DOUBLE * cc, 9) AS v FROM ft)
    SELECT query_id, doc_id, rank, CASE WHEN rank <= 30 THEN row_number() OVER (PARTITION BY query_id, rank > 30 ORDER BY price > 960, v DESC, rank) ELSE rank END AS new_rank FROM s""")
def linear_ranker(spark, sf_dir):
    """The first 30 places re-ordered inside their tier by the linear score."""
    weights = {"title_token_coverage": 2.0, "cross_field_coverage": 1.5, "facet_contradiction": -1.0, "exclusion_match": -3.0, "category_coverage": 0.5}
    rows = _features(spark, sf_dir).withColumn("logit", F.round(c.score("f", weights), 9))
    return show.rerank_prefix(rows, tier=[F.col("price") > 960]).select("query_id", "doc_id", "rank", "new_rank")


@query(f"""WITH {ITEMS}, x AS (SELECT *, string_split(title, ' ') AS w, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1 END AS bm FROM it WINDOW p AS (PARTITION BY query_id))
    SELECT query_id, doc_id, round(bm, 9) AS bm25_normalized, round(1 / rank, 9) AS rank_reciprocal, round(2 / 3::DOUBLE, 9) AS route_agreement, round(len(list_intersect(['red', 'gear', 'small'], w)) / 3, 9) AS title_coverage,
        round((categories = 'SMALL')::INT / 3, 9) AS category_coverage, round(len(list_distinct(list_intersect(['red', 'gear', 'small'], w || [lower(categories)] || CASE WHEN size % 7 IN (0, 1) THEN ['red'] ELSE [] END))) / 3, 9) AS all_field_coverage,
        round(CASE WHEN price > 950 THEN -1 WHEN lower_bound THEN 0 ELSE 1 END, 9) AS price_compatibility, round(5 / 7::DOUBLE, 9) AS metadata_completeness FROM x""")
def admission_feature_rows(spark, sf_dir):
    rows = _items(spark, sf_dir)
    none = F.array().cast("array<string>")
    fields = {"title": terms("title"), "categories": terms("categories"), "features": terms("features"), "details": none, "description": none, "store": terms("store")}
    zero = F.lit(0.0)
    got = c.admission_features(F.array(*[F.lit(t) for t in ("red", "gear", "small")]), fields, routes=F.lit(2), positive=zero, negative=zero, hard=zero, price_fit=e.budget_evidence(F.col("price"), F.col("lower_bound"), F.lit("<= 950")), agreement=zero, price=F.col("price"))
    keep = ["bm25_normalized", "rank_reciprocal", "route_agreement", "title_coverage", "category_coverage", "all_field_coverage", "price_compatibility", "metadata_completeness"]
    return rows.select("query_id", "doc_id", *got).select("query_id", "doc_id", *keep)


@query(f"""WITH tok AS (SELECT p_partkey AS doc_id, unnest(string_split(replace(p_name, 'large', 'larg'), ' ')) AS token FROM part), tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), tot AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM dl),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), q(query_id, token) AS (VALUES (1, 'ring'), (1, 'larg'), (2, 'old'), (2, 'plate'), (3, 'gizmo'))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum({BM25_SCORE.format(tf='tf')}), 9) AS score FROM q JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), tot GROUP BY 1, 2)) WHERE rank <= 20""")
def bm25_stemmed(spark, sf_dir):
    """Titles and queries by their Porter stems: rings find ring, larges large."""
    post = r.postings(catalog(spark, sf_dir), "product_id", {"title": "title"}, tokenizer=lambda x: stems(F.col(x)))
    asked = spark.createDataFrame([(1, "Rings LARGES"), (2, "old plates"), (3, "gizmos")], "query_id int, text string")
    return r.bm25(post, asked.select("query_id", F.explode(stems("text")).alias("token")), k=20)
