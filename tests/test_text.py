import pytest
from pyspark.sql import functions as F

from brindle.functions import text as t


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_terms_drop_stop_words_and_keep_repeats(spark):
    assert one(spark, "The red, RED boots for me", t.terms("x")) == ["red", "red", "boots"]
    assert one(spark, None, t.terms("x")) == []


def test_typed_terms_dedupe_and_cap(spark):
    assert one(spark, "a b 7 red red would boots", t.typed_terms("x", 2)) == ["7", "red"]


@pytest.mark.parametrize("text, want", [("soft wool without leather", ["soft", "wool"]), ("leather-free wool", ["wool"]), ("not only cotton", ["cotton"]), ("no-show socks", ["no", "show", "socks"]), ("maybe; may not contain silk. cotton", ["maybe", "cotton"])])
def test_affirmed_leaves_denials_out(spark, text, want):
    assert one(spark, text, t.terms(t.affirmed("x"))) == want


def test_denied_keeps_each_denial(spark):
    assert one(spark, "leather-free, without rubber sole; wool", t.denied("x")) == [["leather"], ["rubber", "sole"]]


def test_facets_are_sorted_and_distinct(spark):
    assert one(spark, "Red and blue RED shoes, size xl", t.facet("x", "color")) == ["blue", "red"]
    assert one(spark, "xxl or small", t.facet("x", "size")) == ["small", "xxl"]


def test_has_sequence_is_contiguous(spark):
    df = spark.createDataFrame([([["red", "leather", "boot"]], ["leather", "boot"], ["red", "boot"], [])], "f array<array<string>>, a array<string>, b array<string>, c array<string>")
    r = df.select(t.has_sequence("f", "a"), t.has_sequence("f", "b"), t.has_sequence("f", "c")).first()
    assert tuple(r) == (True, False, False)


@pytest.mark.parametrize("value, want", [("$1,299.00", (1299.0, False)), ("from $20", (20.0, True)), ("call", (None, False)), ("0", (None, False)), ("NaN", (None, False)), (None, (None, None))])
def test_money(spark, value, want):
    assert tuple(one(spark, value, t.money("x"))) == want


@pytest.mark.parametrize("word, want", [("ladies", "lady"), ("dresses", "dress"), ("shoes", "shoe"), ("bus", "bus"), ("glass", "glass")])
def test_singular(spark, word, want):
    assert one(spark, word, t.singular(F.col("x"))) == want
