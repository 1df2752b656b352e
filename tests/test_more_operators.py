import pytest
from pyspark.sql import functions as F

from brindle.functions import parsing as p
from brindle.operators import admission, evaluation as ev, simulate, spans as text_spans, taxonomy
from brindle.streaming import profile


@pytest.mark.parametrize("text, want", [
    ("under $50", [("under", 50.0, 0)]), ("budget of 1,200", [("maximum", 1200.0, 0)]), ("between $20 and $30", [("minimum", 20.0, 0), ("maximum", 30.0, 0)]),
    ("$40 or $90", [("around", 40.0, 0), ("around", 90.0, 1)]), ("size 12 boots", []), ("not $30", []), ("my budget is no more than 80 dollars", [("maximum", 80.0, 0)]), (None, []), ("from $60 to $20", []),
])
def test_budgets(text, want):
    assert [(b[0], b[1], b[4]) for b in p.budgets_of(text)] == want


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("adjustment", "adjust"), ("controll", "control"), ("running", "run"), ("sky", "sky"), ("rate", "rate")])
def test_porter(word, want):
    assert p.stem(word) == want


def test_parsers_as_columns(spark):
    r = spark.createDataFrame([("Café ½ 2.5 RUNNING at under $5",), (None,)], "t string").select(p.budgets("t"), p.folded("t"), p.stems("t")).collect()
    assert [b["mode"] for b in r[0][0]] == ["under"] and "2.5" in r[0][1] and r[0][2][0] == "cafe" and "run" in r[0][2]
    assert r[1][0] == [] and r[1][1] == []


def test_greedy_cover_and_break(spark):
    rows = spark.createDataFrame([(1, 10, 1, ["a"]), (1, 11, 2, ["a"]), (1, 12, 3, ["a", "b", "c"]), (1, 13, 4, ["d"])], "query_id long, doc_id long, rank int, facts array<string>")
    got = admission.greedy_cover(rows, 3).orderBy("place").collect()
    assert [x["doc_id"] for x in got] == [12, 13, 10]
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate((10.0, 9.5, 9.4, 1.0), 1)], "query_id long, rank int, score double")
    assert admission.score_break(s).first()["boundary"] == 3


def test_stratified_keeps_head_and_size(spark):
    rows = spark.createDataFrame([(1, d, d) for d in range(1, 101)], "query_id long, doc_id long, rank int")
    got = [x["rank"] for x in admission.stratified(rows, 20, 10).orderBy("rank").collect()]
    assert got[:10] == list(range(1, 11)) and len(got) == 20 and got[-1] > 80


def test_taxonomy(spark):
    paths = spark.createDataFrame([(1, ["women", "running", "shoes"]), (2, ["shoes"])], "product_id long, path array<string>")
    spans = taxonomy.spans(paths)
    assert spans.filter("span = 'running shoes'").count() == 1 and spans.filter("span = 'shoes'").count() == 2
    q = spark.createDataFrame([(7, ["cheap", "running", "shoes"]), (8, ["hat"])], "query_id long, tokens array<string>")
    assert [tuple(r) for r in taxonomy.longest_match(spans, q).collect()] == [(7, "running shoes")]
    alias = spark.createDataFrame([("navy", "color", "blue", None, True), ("navy blue", "color", "blue", None, True), ("blue suede", "material", "suede", None, True)], "alias string, attribute string, canonical string, role string, state boolean")
    t = spark.createDataFrame([(1, "navy blue suede")], "id long, text string")
    assert [(r["id"], r["lane"], r["alias"], r["canonical"], r["start"]) for r in text_spans.alias_spans(t, alias).collect()] == [(1, "expansion", "navy blue", "blue", 0)]


def test_match_levels(spark):
    df = spark.createDataFrame([(["red", "boot"], ["a", "red", "boot"], ["red", "boot"], [])], "t array<string>, a array<string>, b array<string>, x array<string>")
    level = lambda a, x: df.select(taxonomy.match_level(F.col("t"), F.array(*map(F.lit, a)), F.col("b"), F.array(*map(F.lit, x)) if x else F.col("x"))).first()[0]
    assert [level(["z"], ["red boot"]), level(["a", "red", "boot"], []), level(["boot", "red"], []), level(["q"], [])] == [4, 3, 2, 1]


def test_profiles(spark):
    rows = [(1, 1, "color", "Red", "said"), (1, 2, "color", "red", "said"), (1, 3, "size", "wide", "durable"), (1, 4, "style", "slim", "said"), (1, 5, "color", "blue", "replace"), (1, 6, "size", "wide", "reject"), (1, 7, "category", "boots", "durable")]
    got = profile.learned(spark.createDataFrame(rows, "profile_id long, turn int, attribute string, value string, kind string"))
    assert [(r["attribute"], r["value"], r["confidence"]) for r in got.collect()] == [("color", "blue", 0.75)]


def test_simulated_customer(spark):
    s = spark.createDataFrame([(1, "x", "hello", ["cotton", "color: red"], []), (2, "y", "hello", ["wide"], [])], "sample_id long, target string, message string, constraints array<string>, disclosed array<string>")
    seen = []

    def respond(open_sessions, turn):
        rows = open_sessions.orderBy("sample_id").collect()
        seen.append([(r["sample_id"], r["message"]) for r in rows])
        return spark.createDataFrame([(r["sample_id"], ["a", "x"] if "cotton" in r["message"] else ["a"], "material") for r in rows] or [(-1, [""], "")], "sample_id long, ids array<string>, ask string")

    got = {r["sample_id"]: (r["first_hit_turn"], r["best_rank"]) for r in simulate.run(s, respond, turns=3).collect()}
    assert got == {1: (2, 2), 2: (None, None)}
    assert seen[1] == [(1, "For that, what matters is: cotton."), (2, "I don't have an additional preference for material.")]


def test_run_comparisons(spark):
    a = spark.createDataFrame([(1, 1, "m", 2.0), (1, 2, "n", None)], "sid long, turn int, msg string, v double")
    b = spark.createDataFrame([(1, 1, "m", 3.0), (1, 3, "n", None)], "sid long, turn int, msg string, v double")
    assert sorted(tuple(r) for r in ev.run_differences(a, b, ["sid", "turn"], ["msg", "v"]).collect()) == [(1, 1, "v"), (1, 2, "presence"), (1, 3, "presence")]
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query_id long, doc_id long, score double")
    assert tuple(ev.scorer_agreement(s, s).first()) == (1, 0.0, 1, 1.0)
    e = spark.createDataFrame([("x", 1, "c", "red"), ("x", 2, "c", "blue")], "arm string, case_id long, attribute string, value string")
    q = ev.slot_quality(e, e.limit(1)).first()
    assert (q["precision"], q["recall"]) == (1.0, 0.5)
    r = spark.createDataFrame([("d", "attempt"), ("d", "consumed"), ("e", "other")], "dataset string, kind string")
    assert sorted(tuple(x) for x in ev.exposure_status(r).collect()) == [("d", "consumed"), ("e", "unknown")]
    assert 0.79 < ev.power(0.28, 1.0, 100) < 0.81
