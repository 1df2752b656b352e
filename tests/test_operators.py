import math

from pyspark.sql import functions as F

from brindle.operators import evaluation as ev, fusion, packs, paging, policy, ranking as k, retrieval as r, vocabulary as voc


def rows(df, *cols):
    return sorted(tuple(x) for x in df.select(*cols).collect())


def test_bm25_matches_the_formula(spark):
    docs = spark.createDataFrame([(1, "red boot"), (2, "red red shoe"), (3, "blue hat"), (4, "green sock"), (5, None)], "doc_id long, text string")
    q = spark.createDataFrame([(9, "red"), (9, "boot")], "query_id long, token string")
    got = {x["doc_id"]: x["score"] for x in r.bm25(r.postings(docs, "doc_id", {"text": "text"}), q).collect()}
    n, avg = 4, 9 / 4
    idf = lambda df: max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if math.log((n - df + 0.5) / (df + 0.5)) > 0 else 1e-6
    part = lambda tf, length, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert got.keys() == {1, 2}
    assert abs(got[1] - (part(1, 2, 2) + part(1, 2, 1))) < 1e-8
    assert abs(got[2] - part(2, 3, 2)) < 1e-8


def test_zero_weight_field_still_admits(spark):
    docs = spark.createDataFrame([(1, "red", "x"), (2, "blue", "red")], "doc_id long, title string, body string")
    q = spark.createDataFrame([(9, "red")], "query_id long, token string")
    got = r.bm25(r.postings(docs, "doc_id", {"title": "title", "body": "body"}), q, weights={"title": 4, "body": 0})
    assert {x["doc_id"]: x["score"] > 0 for x in got.collect()} == {1: True, 2: False}


def test_phrase_route_counts_overlapping_places(spark):
    docs = spark.createDataFrame([(1, ["a1", "b1", "a1", "b1"]), (2, ["b1", "a1"])], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(9, ["a1", "b1"]), (8, [])], "query_id long, phrase array<string>")
    assert rows(r.phrase_route(docs, q), "query_id", "doc_id", "rank") == [(9, 1, 1)]


def test_division_and_intersection(spark):
    entries = spark.createDataFrame([(1, "red"), (1, "boot"), (2, "red")], "doc_id long, value string")
    wanted = spark.createDataFrame([(7, "red"), (7, "boot"), (7, "unheard of"), (8, "unheard of")], "query_id long, value string")
    assert rows(r.exact_intersection(entries, wanted), "query_id", "doc_id") == [(7, 1)]


def test_reciprocal_rank_counts_a_route_once(spark):
    routes = spark.createDataFrame([(1, "a", 5, 1, 1.0), (1, "a", 5, 3, 1.0), (1, "b", 5, 2, 3.0), (1, "b", 6, 1, 0.0)], "query_id long, route string, doc_id long, rank int, weight double")
    got = {x["doc_id"]: x["score"] for x in fusion.reciprocal_rank(routes).collect()}
    assert abs(got[5] - (1 / 61 + 3 / 62)) < 1e-11 and got[6] == 0.0


def test_interleave_takes_routes_in_turn(spark):
    routes = spark.createDataFrame([(1, "a", 0, d, i) for i, d in enumerate((10, 11, 12), 1)] + [(1, "b", 1, d, i) for i, d in enumerate((11, 13), 1)], "query_id long, route string, route_no int, doc_id long, rank int")
    assert [x["doc_id"] for x in fusion.interleave(routes, 3).orderBy("place").collect()] == [10, 11, 13]


def test_family_max_is_not_a_sum(spark):
    routes = spark.createDataFrame([(1, "a", "f", 5, 1, 1.0), (1, "b", "f", 5, 2, 1.0)], "query_id long, route string, family string, doc_id long, rank int, weight double")
    assert abs(fusion.family_max(routes).first()["score"] - 1 / 41) < 1e-11


def test_budgets_are_groups_of_alternatives(spark):
    pairs = spark.createDataFrame([(1, d, p, *b) for d, p in ((1, 5.0), (2, 50.0), (3, None)) for b in ((0, 0, "under", 10.0), (0, 1, "over", 40.0), (1, 0, "maximum", 45.0))], "query_id long, doc_id long, price double, grp int, alt int, mode string, amount double")
    assert rows(k.budgets_allow(pairs), "doc_id", "allowed") == [(1, True), (2, False), (3, True)]


def test_around_is_soft(spark):
    df = spark.createDataFrame([(100.0,), (136.0,), (None,)], "p double")
    got = [x[0] for x in df.select(k.budget_allows(F.col("p"), F.lit("around"), F.lit(100.0))).collect()]
    assert got == [True, False, None]


def test_rerank_within_tiers_keeps_tier_places(spark):
    df = spark.createDataFrame([(1, "x", 1, 0.1, 10), (1, "y", 2, 0.5, 11), (1, "x", 3, 0.9, 12)], "q long, tier string, pos int, s double, d long")
    got = k.rerank_within_tiers(df, query="q", tier="tier", position="pos", score="s", doc="d")
    assert rows(got, "d", "new_position") == [(10, 3), (11, 2), (12, 1)]


def test_facet_entropy_ignores_unknown(spark):
    m = spark.createDataFrame([(1, "color", "red", 0.25), (1, "color", "blue", 0.25), (1, "color", None, 0.5)], "query_id long, attribute string, signature string, p double")
    x = policy.facet_entropy(m).first()
    assert x["coverage"] == 0.5 and abs(x["gain"] - 0.5 * math.log(2)) < 1e-8


def test_quartiles_need_four(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", 1.0)], "g string, v double")
    assert rows(policy.quartiles(df, "g", "v"), "g", "q1", "q2", "q3") == [("a", 2.0, 3.0, 4.0)]


def test_guarded_page_prefers_unseen_and_keeps_quota(spark):
    ranked = spark.createDataFrame([(1, d, d, d == 3) for d in range(1, 7)], "query_id long, doc_id long, rank int, violation boolean")
    seen = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, doc_id long")
    got = paging.guarded_page(ranked, seen, 3).orderBy("place").collect()
    assert [x["doc_id"] for x in got] == [4, 5, 3]


def test_repeats_and_streaks(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabbba")], "session_id long, turn int, slate string")
    assert rows(paging.repeats(s), "turns", "repeated", "longest") == [(6, 3, 3)]


def test_seen_before_resets(spark):
    s = spark.createDataFrame([(1, 1, 5, False), (1, 2, 5, False), (1, 3, 5, True), (1, 4, 5, False)], "session_id long, turn int, doc_id long, reset boolean")
    assert [x["seen"] for x in paging.seen_before(s).orderBy("turn").collect()] == [False, True, False, True]


def test_session_metrics_count_a_miss_as_eleven(spark):
    o = spark.createDataFrame([("x", True, 1, 1.0), ("x", False, None, 0.0)], "scenario_type string, hit boolean, first_hit_turn int, reciprocal_rank double")
    x = o.agg(*ev.session_metrics()).first()
    assert (x["hit_rate"], x["mrr"], x["mean_turns"], x["efficiency"]) == (0.5, 0.5, 6.0, 0.5)
    assert abs(x["technical_score"] - (0.25 + 0.15 + 0.1)) < 1e-9


def test_bootstrap_does_not_depend_on_partitions(spark):
    d = spark.range(200).select("id", (F.col("id") % 7 - 3).cast("double").alias("delta"))
    one = ev.bootstrap_interval(d.repartition(1), resamples=50, seed=1).first()
    many = ev.bootstrap_interval(d.repartition(7), resamples=50, seed=1).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(one, many)) and one["low"] < one["mean"] < one["high"]


def test_quotas_share_by_largest_remainder(spark):
    c = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "band int, n long")
    assert rows(packs.quotas(c, 10), "band", "quota") == [(0, 4), (1, 3), (2, 3)]


def test_deal_is_stable_under_partitions(spark):
    d = spark.range(40).select(F.col("id"), (F.col("id") % 2).alias("g"))
    a = rows(packs.deal(d.repartition(1), "id", "s", ("x", "y"), "g"), "id", "split")
    assert a == rows(packs.deal(d.repartition(5), "id", "s", ("x", "y"), "g"), "id", "split")
    assert sum(s == "x" for _, s in a) == 20


def test_aliases_need_support_and_share(spark):
    v = spark.createDataFrame([("c", "navy", "blue")] * 9 + [("c", "navy", "black")] + [("c", "teal", "blue")] * 2, "attribute string, alias string, canonical string")
    assert rows(voc.aliases(v), "alias", "canonical", "support", "confidence", "margin") == [("navy", "blue", 9, 0.9, 0.8)]


def test_title_neighbors(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "z")], "doc_id long, token string")
    got = {(x["doc_id"], x["neighbor"]): x["similarity"] for x in voc.title_neighbors(t).collect()}
    assert got[1, 2] == 1.0 and 0 < got[1, 3] < 1


def test_product_neighbors_cap_candidates_and_not_askers(spark):
    t = spark.createDataFrame([(i, ["common", f"own{i}"]) for i in range(300)] + [(300, ["common", "far"]), (301, ["far", "own7", "own7"])], "doc_id long, tokens array<string>")
    got = voc.product_neighbors(t).collect()
    of = {d: [(x["neighbor"], x["similarity"]) for x in sorted(got, key=lambda x: x["rank"]) if x["doc_id"] == d] for d in range(302)}
    assert all(len(of[d]) == 8 for d in range(301)) and max(n for d in of for n, _ in of[d]) > 255
    idf = {"common": math.log1p(302 / 301), "own7": math.log1p(302 / 2), "far": math.log1p(302 / 2), "own299": math.log1p(302)}
    assert of[299][0] == (7, round(idf["common"] / (idf["common"] + idf["own299"] + idf["own7"]), 9))
    assert of[301] == [(7, round(idf["own7"] / (idf["own7"] + idf["far"] + idf["common"]), 9)), (300, round(idf["far"] / (idf["own7"] + idf["far"] + idf["common"]), 9))]


def test_vectors_of_several_blocks_join_and_rank_alike(spark):
    v = spark.createDataFrame([(i, [float((i * 7) % 11), float((i * 5) % 13)]) for i in range(90)], "doc_id long, embedding array<float>").repartition(3)
    q = v.withColumnRenamed("doc_id", "query_id")
    one, many = (k.vector_top_k(v, q, 4, block=b) for b in (1000, 20))
    cols = ("query_id", "doc_id", "score", "rank")
    assert rows(many, *cols) == rows(one, *cols)
    assert rows(k.vector_top_k(v, q, 4, block=20, cells=40), *cols) == rows(one, *cols)  # two rows at a time, fewer than k
    two, limit = k.vector_top_k(v, q, 4, block=50), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(two.join(two.groupBy("query_id").agg(F.max("score").alias("best")), "query_id").collect()) == 360
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
