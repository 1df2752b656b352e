"""Rows dealt ahead of costly work, remembered results, and counts that leave lengths whole."""

import pytest

from brindle.functions.dealing import remembered, spread
from brindle.operators import retrieval as r, views
from brindle.plans import catalog_queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["value_parsing", "slate_feedback", "component_views", "budget_range_filter", "view_assessment"])
def test_one_file_becomes_several_tasks(spark, name):
    assert catalog_queries.QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_tasks_grow_with_rows(spark):
    rows = spark.range(100)
    assert spread(rows, "id", each=2).rdd.getNumPartitions() == 50
    assert sorted(x["id"] for x in spread(rows, "id", each=2).collect()) == list(range(100))


def test_remembered_is_bounded():
    asked = []
    f = remembered(lambda x, y=0: asked.append(x) or x + y, most=2)
    assert [f(1), f(1), f(1, y=2), f(3), f(1)] == [1, 1, 3, 3, 1]
    assert asked == [1, 1, 3, 1]  # the third result made room by forgetting the two before


def test_tokens_that_nobody_asks_for_still_count(spark):
    docs = spark.createDataFrame([(1, "red boot boot"), (2, "red red shoe and hat"), (3, "blue hat"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(9, "red"), (9, "boot"), (8, "hat")], "query_id long, token string")
    every = r.postings(docs, "doc_id", {"text": "text"})
    for rows in (200_000, 1):
        some = r.postings(docs, "doc_id", {"text": "text"}, only=q, broadcast_rows=rows)
        assert {x["token"] for x in some.collect()} == {"red", "boot", "hat", None}
        assert sorted(map(tuple, r.bm25(some, q).collect())) == sorted(map(tuple, r.bm25(every, q).collect()))


def test_phrases_beyond_the_broadcast_and_places_that_touch(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "a", "b"]), (2, ["b", "a"]), (3, ["a", "b", "a", "b", "x", "a", "b"])], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(9, ["a", "b"]), (8, []), (7, ["a"]), (6, ["a", "b", "a"])], "query_id long, phrase array<string>")
    few, many = (sorted(map(tuple, r.phrase_route(docs, q, broadcast_rows=n).collect())) for n in (200_000, 1))
    assert few == many and [x[:2] for x in few] == [(6, 3), (7, 1), (7, 2), (7, 3), (9, 1), (9, 3)]


def test_explained_keeps_what_a_preference_has(spark):
    s = spark.createDataFrame([(1, 1, 0, "title", 1.0, "color"), (1, 1, 0, "type", 0.0, "color")], "query_id int, doc_id int, pref int, field string, signal double, attribute string")
    assert [(x["signal"], x["attribute"], x["fields"]) for x in views.explained(s, keep=("attribute",)).collect()] == [(1.0, "color", ["title"])]
