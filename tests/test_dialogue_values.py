import pytest

from brindle.functions import feedback, parsing, values as v
from brindle.sources import config
from brindle.streaming.ledger import Ledger, read, semantic_query


def after(*messages, asked=()):
    book = Ledger()
    for i, m in enumerate(messages, 1):
        book.observe(m, i, dict(asked).get(i))
    return book


def facts(book):
    return {(e.source, e.text) for e in book.evidence}


@pytest.mark.parametrize("text, want", [
    ("I can't spend more than 40", [("maximum", 40.0, 0)]), ("I don't want to pay less than $20", [("minimum", 20.0, 0)]), ("$10-$20", [("minimum", 10.0, 0), ("maximum", 20.0, 0)]), ("20 to 30 dollars", [("minimum", 20.0, 0), ("maximum", 30.0, 0)]),
    ("$20 and $30", [("around", 20.0, 0), ("around", 30.0, 0)]), ("1.2.3 USD 5", [("around", 5.0, 0)]), ("avoid $5", []), ("at least $3.50x", []), ("x" * 9000 + " under $7", [("under", 7.0, 0)]),
])
def test_more_budgets(text, want):
    assert [(b[0], b[1], b[4]) for b in parsing.budgets_of(text)] == want


def test_budget_apart():
    assert parsing.apart_from_budget("red boots under $50") == ["red boots", "under $50"]
    assert parsing.apart_from_budget("my budget is $50") == ["my budget is $50"]
    assert parsing.apart_from_budget("$40 or $90 and cotton") == ["cotton", "$40 or $90"]


@pytest.mark.parametrize("value, owner", [("lining: cotton", "lining"), ("cotton lining", "lining"), ("black upper", "upper"), ("cotton shirt", None), ("sole and lining", None), ("sleeves color red", "sleeve")])
def test_components(value, owner):
    assert v.component_of(value) == owner


def test_alternatives_and_restrictions():
    assert v.alternatives("red or blue") == ["red", "blue"] and v.alternatives("red or wool") == ["red or wool"] and v.alternatives("not red or blue") == ["not red or blue"]
    assert v.alternatives("cotton or wool lining") == ["lining: cotton", "lining: wool"]
    assert v.only_values("only black and white", "color") == {"black", "white"} and v.only_values("only the black one", "color") == set()


def test_component_texts_keep_clauses_apart():
    got = v.component_texts({"features": "lining cotton and leather upper; warm", "details": "Upper: suede"})
    assert got["lining"][2] == "lining cotton" and got["upper"][2] == "leather upper" and "suede" in got["upper"][3]


def test_slate_feedback():
    assert feedback.rejects_slate("None of these work for me") and not feedback.rejects_slate("maybe these are not right")
    assert feedback.preferences_in("Those aren't right, I need cotton") == "I need cotton"


def test_corrections_replace_and_keep_other_facets():
    b = after("I'm looking for boots", "red cotton", "Correction: make that blue")
    assert facts(b) == {("category", "boots"), ("clarification", "cotton"), ("override", "blue")}


def test_kept_options_widen_one_facet():
    assert ("override", "blue or red") in facts(after("red", "Make that blue but keep the red as an option"))
    assert ("override", "lining: wool or cotton") in facts(after("make that lining: wool and keep the cotton lining as an option"))


def test_exclusions_contrasts_and_alternatives():
    assert facts(after("leather or suede", "not suede")) == {("clarification", "leather"), ("exclusion", "suede")}
    assert facts(after("cotton rather than wool")) == {("clarification", "cotton"), ("exclusion", "wool")}
    assert facts(after('I like "not cotton" and wool')) == {("clarification", 'I like "not cotton" and wool')}


def test_doubt_report_and_supposition_assert_nothing():
    for m in ("maybe red", 'the label says "no cotton"', "if I want red", '"I need wool"', "perhaps change that to red"):
        assert not after(m).evidence, m


def test_percentages_change_and_repeats_stand():
    assert facts(after("60% cotton 40% wool", "change that to 80% cotton")) == {("override", "80% cotton")}
    assert ("clarification", "red hat") in facts(after("red hat", "make that red"))


def test_declined_attributes():
    b = after("size wide", "I don't have a preference for size")
    assert not b.evidence and b.declined == ["size"]
    b = after("size wide", "I don't have an additional preference for size")
    assert facts(b) == {("clarification", "size wide")} and b.declined == ["size"]


def test_components_have_their_own_values():
    assert facts(after("lining: cotton", "make that lining: wool", "black upper")) == {("override", "lining: wool"), ("clarification", "black upper")}


def test_read_is_pure_and_total():
    for m in (None, "", "   ", ";;;", "$", "no", "not", "keep", "correction:", "or or or", "x" * 20_000):
        assert isinstance(read(m, 1), list)


def test_semantic_query():
    b = after("I'm looking for boots", "I need red", "for hiking")
    assert semantic_query(b) == "Product category: boots\nRequired features: red; for hiking"
    assert semantic_query(after("I'm looking for boots")) is None


def test_config():
    schema = {"n": (int, 3, lambda x: x > 0), "w": (float, 0.5, lambda x: x <= 1)}
    assert config.load("{}", schema) == {"n": 3, "w": 0.5}
    for bad in ('{"n": true}', '{"n": 0}', '{"x": 1}', '{"n": 1, "n": 2}', "[]"):
        assert config.problem(bad, schema)
