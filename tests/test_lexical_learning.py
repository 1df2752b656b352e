from pyspark.sql import functions as F

from brindle.operators import learning, lexical


def flat(spark):
    rows = [
        (1, "Red leather boot", "shoes boots", "warm", "", "acme", "", 50.0, 4.0, 10),
        (2, "Blue boot", "shoes boots", "leather-free", "", "acme", "red lining", 40.0, 5.0, 5),
        (3, "Red leather bag", "bags", "", "", "other", "", 30.0, 5.0, 500),
        (4, "Red leather thing", "", "", "", "other", "", None, None, None),
    ]
    return spark.createDataFrame(rows, "product_id long, title string, categories string, features string, details string, store string, description string, price double, rating double, reviews long")


def ranked(spark, evidence, **how):
    cands = spark.createDataFrame([(9, i, 0.01) for i in (1, 2, 3, 4)], "query_id long, product_id long, rrf double")
    e = spark.createDataFrame([(9, *x) for x in evidence], "query_id long, text string, source string, weight double")
    return {r["product_id"]: r for r in lexical.rank(cands, lexical.product_features(flat(spark)), e, **how).collect()}


def test_categories_gate_and_unknown_stays(spark):
    got = ranked(spark, [("boots", "category", 1.4), ("red leather", "hard_constraint", 3.8)])
    assert set(got) == {1, 2, 4} and [got[i]["rank"] for i in (1, 2, 4)] == [1, 2, 3]
    assert got[1]["all_hard"] and not got[2]["all_hard"] and got[4]["category_status"] == 0


def test_denied_must_have_is_a_violation(spark):
    got = ranked(spark, [("leather", "hard_constraint", 3.8)])
    assert got[2]["violation"] and not got[1]["violation"]
    assert got[2]["rank"] == 4


def test_exclusions_look_at_affirmed_text_only(spark):
    got = ranked(spark, [("leather", "exclusion", 3.8)])
    assert {i: r["violation"] for i, r in got.items()} == {1: True, 2: False, 3: True, 4: True}


def test_constraint_score_by_hand(spark):
    products = lexical.product_features(flat(spark)).filter("product_id = 1")
    e = lexical.compile_evidence(spark.createDataFrame([(9, "red leather", "clarification", 2.0), (9, "the of", "clarification", 9.0)], "query_id long, text string, source string, weight double"))
    s = products.crossJoin(e).select(lexical.constraint_score()).first()[0]
    assert abs(s - (2 * (1.9 + 0.4 * 8 / 8) + 2 * min(2, 0.55 + 0.44) + 0.9)) < 1e-9


def test_pairwise_ranker_learns_direction(spark):
    rows = spark.createDataFrame([(g, i, float(i), float(-i % 3), 1 if i > 5 else -1) for g in "ab" for i in range(10)], "g string, id int, x double, y double, label int")
    pairs = learning.product_pairs(rows, "g", "id", ["x", "y"], "label")
    w = learning.pairwise_ranker(pairs, ["x", "y"], epochs=10)
    assert w[0] > 0 and learning.pair_accuracy(pairs, ["x", "y"], w).first()["accuracy"] == 1.0


def test_platt_recovers_the_grid_point(spark):
    import math

    rows = [(m / 10, 1 if math.sin(m * 7.0) * 0.5 + 0.5 < 1 / (1 + math.exp(-2 * m / 10)) else 0) for m in range(-30, 31)]
    best = learning.platt(spark.createDataFrame(rows, "margin double, label int"), [0.5, 2.0, 8.0], [-1.0, 0.0, 1.0]).first()
    assert (best["slope"], best["offset"]) == (2.0, 0.0)


def test_admission_model_orders_scores(spark):
    rows = spark.range(200).select((F.col("id") / 20).alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") > 150).cast("int").alias("y"))
    m = learning.admission_model(rows, ["x", "z"], "y", rounds=20).stages[-1].coefficients
    assert m[0] > abs(m[1])
