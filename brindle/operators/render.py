"""Documents rendered for a reader with a length budget: heads of fields, and windows around what a query asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The most characters of each field in a head, the words on either side of a match, and the words of a whole document.
HEAD = {"title": 500, "categories": 400, "features": 1200, "details": 800, "description": 1200, "store": 200}
RADIUS, MOST_WORDS = 10, 160


def head(fields: dict[str, Column], limits: dict[str, int] = HEAD) -> Column:
    """Each field's beginning on a line of its own, named; empty fields are left out."""
    lines = [F.when(F.length(fields[n]) > 0, F.concat(F.lit(f"{n.title()}: "), F.substring(fields[n], 1, most))) for n, most in limits.items() if n in fields]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being computed once."""
    return F.transform(F.array(value), then)[0]


def query_values(query: Column) -> Column:
    """The different words of a query in order, of two characters or more."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9]+"), 0)), lambda t: F.length(t) > 1)


def snippets(name: str, text: Column, values: Column, radius: int = RADIUS) -> Column:
    """Windows of a whole text around the first word that holds each value, in the order of values; equal windows once.

    Words are what lies between blanks; a value stands in one if it is one of its parts between signs.  The text is walked
    once: every part that is asked for, with its word's number, then the least number of each value.
    """

    def windows(words):
        return _let(asked_parts(words), lambda asked: cut(words, asked))

    def asked_parts(words):
        parts = F.flatten(F.transform(words, lambda w, i: F.transform(F.regexp_extract_all(F.lower(w), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda p: F.struct(p.alias("p"), i.alias("i")))))
        return F.filter(parts, lambda x: F.array_contains(values, x["p"]))

    def cut(words, asked):
        first = F.transform(values, lambda v: F.array_min(F.transform(F.filter(asked, lambda x: x["p"] == v), lambda x: x["i"])))
        found = F.filter(first, lambda i: i.isNotNull())
        windows = F.transform(found, lambda i: F.array_join(F.slice(words, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)) + radius + 1), " "))
        return F.transform(F.array_distinct(windows), lambda s: F.concat(F.lit(f"{name.title()}: "), s))

    return _let(_words(text), windows)


def assembled(parts: Column, most: int = MOST_WORDS) -> Column:
    """Parts one after the other, cut at most words."""
    return F.array_join(F.slice(F.flatten(F.transform(parts, _words)), 1, most), " ")


def around_query(query: Column, lead: dict[str, Column], fields: dict[str, Column], *, radius: int = RADIUS, most: int = MOST_WORDS) -> Column:
    """The lead fields whole, then windows of the other fields around the query's words, within the budget of words."""
    def whole(values):
        return F.flatten(F.array(*named, *[snippets(n, c, values, radius) for n, c in fields.items()]))

    named = [F.array(F.concat(F.lit(f"{n.title()}: "), F.coalesce(c, F.lit("")))) for n, c in lead.items()]
    return assembled(_let(query_values(query), whole), most)
