import numpy as np
from pyspark.sql import functions as F

from brindle.functions.text import terms
from brindle.operators import counted as c, retrieval as r

DOCS = [
    (1, "Red BOOT, red-boot; the boot"), (2, "red red shoe and hat"), (3, "blue hat"), (4, None), (5, ""), (6, "the of and"), (7, "ÉRED boot hat xKelvin kelvin"),
    (8, "a b x a b a b"), (8, "red once more"), (9, "blue hat"), (None, "red hat"), (10, "boot " * 50 + "red"),
]


def test_counted_texts_give_what_tokens_give(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").filter("doc_id is not null")
    q = spark.createDataFrame([(9, "red"), (9, "boot"), (8, "hat"), (None, "kelvin"), (7, "unheard")], "query_id long, token string")
    phrases = spark.createDataFrame([(9, ["red", "boot"]), (8, []), (7, ["boot"]), (6, ["blue", "hat"]), (5, ["blue", "hat"]), (4, ["b", "x"]), (3, ["red", "unheard"]), (2, ["boot", "boot"])], "query_id long, phrase array<string>")
    got = r.count_texts(docs, q, phrases, path=str(tmp_path / "counted"))
    order = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()), key=str)
    plain = r.bm25(r.postings(docs, "doc_id", {"text": "text"}), q, k=3, broadcast_rows=0)
    assert order(r.bm25_counted(got, q, 3)) == order(plain) and plain.count() > 6
    tokens = docs.select("doc_id", terms("text").alias("tokens"))
    assert order(r.phrases_counted(got, phrases)) == order(r.phrase_route(tokens, phrases))
    held = {x["doc_id"]: set(x["tokens"]) for x in r.with_tokens(got, docs.select("doc_id").distinct()).collect()}
    assert held[8] >= {"red"} and held[7] >= {"boot", "hat", "kelvin"} and not held[4]


def test_too_many_tokens_or_ids_that_are_no_integers_are_not_counted(spark, tmp_path):
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    q = spark.createDataFrame([(9, "red"), (9, "boot")], "query_id long, token string")
    assert r.count_texts(docs, q, path=str(tmp_path / "a"), broadcast_rows=1) is None
    assert r.count_texts(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), q, path=str(tmp_path / "b")) is None


def test_a_task_passes_on_only_its_best_documents(spark):
    """Before, every pair of a query and a document with one of its tokens was shuffled."""
    post = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("field"), F.explode(F.array(F.lit("red"), F.concat(F.lit("w"), F.col("id")))).alias("token"), F.lit(1).alias("tf"))
    q = spark.createDataFrame([(9, "red"), (8, "red"), (8, "w5")], "query_id long, token string")
    found = r.bm25(post, q, k=4)
    assert sorted(tuple(x)[:2] for x in found.filter("query_id = 9").collect()) == [(9, 0), (9, 1), (9, 2), (9, 3)]  # equal scores by id
    assert found.filter("query_id = 8 and rank = 1").first()["doc_id"] == 5
    rows = r.count_postings(post, ["red", "w5"]).rows.repartition(3)
    best = c.best_documents(rows, [np.array([0]), np.array([0, 1])], np.array([1.0, 2.0]), 2.0, 4, 1.2, 0.75)
    assert best.count() == 3 * 2 * 4


def test_rounded_as_spark_rounds(spark):
    x = [0.1234567895, 2.0000000005, 1.0000000015, 0.3, 12345.6789012345, 0.0, 7.1234567885]
    want = [v["y"] for v in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 9).alias("y")).orderBy("i").collect()]
    assert c.rounded(np.array(x)).tolist() == want


def test_routes_of_the_catalog_share_counted_rows(spark):
    from brindle.plans.session_queries import _catalog_routes

    flat = spark.createDataFrame([(i, ["red ring", "hot bolt", "red bolt"][i % 3], ["small ring", "bolt"][i % 2], "Brand#1") for i in range(40)], "product_id long, title string, categories string, store string")
    tokens = spark.createDataFrame([(1, "category", "ring"), (1, "override", "red"), (2, "category", "bolt"), (2, "hard_constraint", "brand"), (2, "hard_constraint", None)], "query_id long, source string, token string")
    post, weights = r.postings(flat, "product_id", {f: f for f in ("title", "categories", "store")}), {"title": 4, "categories": 8, "store": 1}
    for got, asked, k in zip(_catalog_routes(spark, flat, tokens), (tokens, tokens.filter("source = 'category'")), (350, 180)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, r.bm25(post, asked, weights=weights, k=k, broadcast_rows=0).collect()))


def test_empty_tables_are_counted(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    q, phrases = spark.createDataFrame([(9, "red")], "query_id long, token string"), spark.createDataFrame([(9, ["red"])], "query_id long, phrase array<string>")
    for i, (d, a, b) in enumerate([(docs, q, phrases), (docs.limit(0), q, phrases), (spark.createDataFrame(DOCS, docs.schema), q.limit(0), phrases.limit(0))]):
        got = r.count_texts(d, a, b, path=str(tmp_path / str(i)))
        assert not r.bm25_counted(got, a).collect() and not r.phrases_counted(got, b).collect()
        assert not r.with_tokens(got, d.select("doc_id").limit(0)).collect()
