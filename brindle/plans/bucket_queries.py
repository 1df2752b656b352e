"""Bucket search over the catalog stand-in."""

from pyspark.sql import functions as F

from ..operators import bucket as b, ranking as k
from .evidence_queries import ITEMS, WORDING, _items
from .registry import CATALOG, catalog, query

REQUIREMENTS = [("I need red gear", True, False), ("leather upper or cotton lining", False, False), ("under $955", True, False), ("ring", True, True), ("around 930", False, False)]

#: what the wordings affirm, by the rule of three words
AFFIRMED = [["without"], ["free"], ["faux", "leather"], ["60", "cotton", "lining"], ["leather", "upper", "with", "strap"], ["replacement", "strap"], ["grey", "rods"]]
_AFF = "[" + ", ".join(str(a) for a in AFFIRMED) + "]"


def _rows(spark, sf_dir):
    fields = b.fields_of([F.col("title"), F.col("features")])
    wants = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(h).alias("hard"), F.lit(x).alias("exclude")) for t, h, x in REQUIREMENTS])
    return _items(spark, sf_dir).withColumn("fields", fields).withColumn("wants", wants)


@query(f"WITH {ITEMS} SELECT query_id, doc_id, {_AFF}[size % 7 + 1] AS affirmed FROM it")
def affirmed_words(spark, sf_dir):
    return _items(spark, sf_dir).select("query_id", "doc_id", b.affirmed_words(F.col("features")).alias("affirmed"))


@query(f"""WITH {CATALOG}, t(text, lower, upper, lower_in, upper_in, target) AS (VALUES ('between $905 and $920', 905, 920, true, true, NULL), ('under 950', NULL, 950, true, false, NULL), ('at least $1,000', 1000, NULL, true, true, NULL),
        ('more than 910.5', 910.5, NULL, false, true, NULL), ('around $930', NULL, NULL, true, true, 930), ('budget: 940', NULL, 940, true, true, NULL), ('red boots', NULL, NULL, true, true, NULL)),
    j AS (SELECT *, coalesce(price < lower OR (price = lower AND NOT lower_in), false) OR coalesce(price > upper OR (price = upper AND NOT upper_in), false) AS bad FROM cat, t)
    SELECT product_id, text, (CASE WHEN bad THEN 0 WHEN target IS NOT NULL THEN CASE WHEN price = target THEN 4 ELSE 1 END ELSE 4 END)::INT AS level, round((CASE WHEN bad THEN 0 WHEN target IS NOT NULL THEN 1 / (1 + abs(price - target) / target) ELSE 1 END)::DOUBLE, 9) AS share, bad AS violated FROM j""")
def budget_intervals(spark, sf_dir):
    texts = ["between $905 and $920", "under 950", "at least $1,000", "more than 910.5", "around $930", "budget: 940", "red boots"]
    rows = catalog(spark, sf_dir).select("product_id", "price", F.explode(F.array(*[F.lit(t) for t in texts])).alias("text")).withColumn("b", b.interval(F.col("text")))
    m = rows.withColumn("m", b.interval_match(F.col("price"), F.col("b")))
    return m.select("product_id", "text", "m.level", F.round("m.share", 9).alias("share"), "m.violated")


_C = "['black', 'white', 'blue', 'red', 'grey', 'gray', 'gold', 'silver']"
LEVELS = f"""{ITEMS}, fl AS (SELECT *, string_split(title, ' ') AS tw, {_AFF}[size % 7 + 1] AS fa, list_distinct(list_concat(string_split(title, ' '), {_AFF}[size % 7 + 1])) AS pos FROM it),
    lv AS (SELECT *, CASE WHEN title = 'red gear' THEN 4 WHEN list_has_all(tw, ['red', 'gear']) THEN 2 WHEN list_contains(pos, 'red') OR list_contains(pos, 'gear') THEN 1 ELSE 0 END AS l1,
        CASE WHEN title = 'red gear' THEN 1 ELSE (list_contains(pos, 'red')::INT + list_contains(pos, 'gear')::INT) / 2 END::DOUBLE AS s1,
        len(list_intersect(pos, {_C})) > 0 AND NOT list_contains(pos, 'red') AS v1,
        CASE size % 7 WHEN 4 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS l2, CASE size % 7 WHEN 4 THEN 0.5 WHEN 3 THEN 1 ELSE 0 END::DOUBLE AS s2,
        CASE WHEN price < 955 THEN 4 ELSE 0 END AS l3, price >= 955 AS v3, list_contains(tw, 'ring') AS v4, CASE WHEN price = 930 THEN 4 ELSE 1 END AS l5, 1 / (1 + abs(price - 930) / 930) AS s5 FROM fl),
    ty AS (SELECT *, v1::INT + v3::INT + v4::INT AS violations, (l1 >= 2)::INT + (l3 >= 2)::INT AS hard_complete, (l1 = 4)::INT + (l3 = 4)::INT AS hard_exact, (l1 >= 3)::INT + (l3 >= 3)::INT AS hard_phrases, round(s1 + (l3 = 4)::INT, 9) AS hard_share,
        (l1 = 4)::INT + (l2 = 4)::INT + (l3 = 4)::INT + (l5 = 4)::INT AS exact, (l1 >= 3)::INT + (l2 >= 3)::INT + (l3 >= 3)::INT + (l5 >= 3)::INT AS phrases, (l1 >= 2)::INT + (l2 >= 2)::INT + (l3 >= 2)::INT + (l5 >= 2)::INT AS complete, round(s1 + s2 + (l3 = 4)::INT + s5, 9) AS share FROM lv)"""


@query(f"WITH {LEVELS} SELECT query_id, doc_id, violations::DOUBLE AS violations, hard_complete::DOUBLE AS hard_complete, hard_exact::DOUBLE AS hard_exact, exact::DOUBLE AS exact, phrases::DOUBLE AS phrases, complete::DOUBLE AS complete, share FROM ty")
def requirement_levels(spark, sf_dir):
    t = _rows(spark, sf_dir).withColumn("t", b.tallies(F.col("fields"), F.col("price"), F.col("wants")))
    return t.select("query_id", "doc_id", *[f"t.{n}" for n in ("violations", "hard_complete", "hard_exact", "exact", "phrases", "complete", "share")])


@query(f"""WITH {LEVELS} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (categories = 'SMALL')::INT DESC, violations, hard_complete DESC, hard_exact DESC, hard_phrases DESC, hard_share DESC, exact DESC, phrases DESC, complete DESC, share DESC, rating DESC, reviews DESC, doc_id) AS rank FROM ty""")
def bucket_ranking(spark, sf_dir):
    """The twelve-key order of the bucket backend."""
    rows = _rows(spark, sf_dir).withColumn("t", b.tallies(F.col("fields"), F.col("price"), F.col("wants"))).withColumn("in_category", F.col("categories") == "SMALL").withColumnRenamed("rating", "quality")
    return b.rank(rows.drop("rank")).select("query_id", "doc_id", "rank")


@query(f"""WITH {CATALOG}, p AS (SELECT product_id AS doc_id, title, categories, store, round(rating + ln(1 + reviews), 9) AS quality FROM cat), q(query_id, category, noun, adjective) AS (VALUES (1, 'SMALL', 'ring', 'red'), (2, 'NONE', 'gear', 'old'), (3, 'NONE', 'none', 'none')),
    ca AS (SELECT query_id, doc_id FROM p, q WHERE categories = category), xa AS (SELECT query_id, doc_id, 1 AS n FROM p, q WHERE title = adjective || ' ' || noun),
    le AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, doc_id) AS l FROM p, q WHERE title LIKE '% ' || noun) WHERE l <= 40),
    ev AS (SELECT query_id, doc_id FROM ca UNION SELECT query_id, doc_id FROM xa UNION SELECT query_id, doc_id FROM le), n AS (SELECT query_id, count(doc_id) AS n FROM q LEFT JOIN ev USING (query_id) GROUP BY 1),
    be AS (SELECT doc_id, row_number() OVER (ORDER BY quality DESC, doc_id) AS place FROM p), fi AS (SELECT query_id, doc_id FROM n, be WHERE n < 10 AND place <= CASE WHEN n = 0 THEN 100 ELSE 10 END),
    po AS (SELECT * FROM ev UNION SELECT * FROM fi)
    SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (ca.doc_id IS NOT NULL)::INT DESC, coalesce(xa.n, 0) DESC, coalesce(l, 1000000), quality DESC, po.doc_id) AS rank
        FROM po JOIN p USING (doc_id) LEFT JOIN ca USING (query_id, doc_id) LEFT JOIN xa USING (query_id, doc_id) LEFT JOIN le USING (query_id, doc_id)) WHERE rank <= 100""")
def bucket_admission(spark, sf_dir):
    """Category members, exact titles and lexical hits of three requests, the last of which nothing matches."""
    p = catalog(spark, sf_dir).select(F.col("product_id").alias("doc_id"), "title", "categories", F.round(F.col("rating") + F.log1p("reviews"), 9).alias("quality"))
    q = spark.createDataFrame([(1, "SMALL", "ring", "red"), (2, "NONE", "gear", "old"), (3, "NONE", "none", "none")], "query_id int, category string, noun string, adjective string")
    both = p.join(F.broadcast(q))  # three requests
    lexical = k.tier_sort(both.filter(F.element_at(F.split("title", " "), -1) == F.col("noun")), tiers=[F.desc("quality")], k=40)
    exact = both.filter(F.col("title") == F.concat_ws(" ", "adjective", "noun")).withColumn("n", F.lit(1))
    return b.admit(both.filter("categories = category"), exact, lexical, p.select("doc_id", "quality"), q, limit=100)


@query(f"""WITH {ITEMS}, sg2 AS (SELECT query_id, unnest([{{'a': 'color', 's': array_to_string(list_sort(list_intersect(list_distinct(list_concat(string_split(title, ' '), {_AFF}[size % 7 + 1])), {_C})), ' ')}},
        {{'a': 'material', 's': array_to_string(list_sort(list_intersect({_AFF}[size % 7 + 1], ['cotton', 'leather'])), ' ')}}, {{'a': 'size', 's': array_to_string(list_sort(list_intersect(string_split(title, ' '), ['small', 'large'])), ' ')}}]) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM it WHERE rank <= 30),
    c AS (SELECT query_id, n, k.a AS attribute, k.s AS s, count(*) AS c FROM sg2 WHERE k.s <> '' GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY query_id, attribute) AS known FROM c)
    SELECT * FROM (SELECT query_id, attribute, round(-sum(c / known * log2(c / known)) * max(known) / max(n), 9) AS information FROM t GROUP BY 1, 2) WHERE information > 0""")
def bucket_question(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("affirmed", b.affirmed_words(F.concat_ws("; ", "title", "features")))
    return b.question_information(rows)
