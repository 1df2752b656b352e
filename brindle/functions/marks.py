"""A value as a row of marked tokens: words with the component and the facets they speak of, and signs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from .dealing import remembered
from .text import FACETS

FACET_RE = {name: re.compile(rf"\b({pattern})\b", re.I) for name, pattern in FACETS.items()}
# Parts of a product that have a material or colour of their own.
COMPONENTS = "lining upper outsole midsole insole sole shell sleeve pocket collar hood".split()
_PARTS = {c + s: c for c in COMPONENTS for s in ("", "s")}
_TOKEN = re.compile(r"\w+|[^\w\s]")
ARTICLES = frozenset(("the", "its", "a", "an"))
JOINTS = frozenset(("and", "but", "with", ","))
COPULAS = frozenset(("is", "are", "was", "were"))
NAMES = frozenset(("material", "color", "colour"))


@dataclass(frozen=True)
class Mark:
    low: str
    start: int
    end: int
    part: str | None
    facets: frozenset[str]

    @property
    def word(self) -> bool:
        return self.low[0].isalnum() or self.low[0] == "_"


@remembered
def marks(text: str) -> list[Mark]:
    inside = {name: [m.span() for m in pattern.finditer(text)] for name, pattern in FACET_RE.items()}
    inside = {name: spans for name, spans in inside.items() if spans}
    out = []
    for m in _TOKEN.finditer(text):
        own = frozenset(name for name, spans in inside.items() if any(s <= m.start() and m.end() <= e for s, e in spans))
        out.append(Mark(m[0].lower(), m.start(), m.end(), _PARTS.get(m[0].lower()), own))
    return out


def wording(text: str, row: Sequence[Mark]) -> str:
    """The text from the first to the last mark."""
    return text[row[0].start : row[-1].end] if row else ""


def divided(row: Sequence[Mark], at: Callable[[Mark], bool]) -> list[list[Mark]]:
    """The marks between those that part them."""
    out: list[list[Mark]] = [[]]
    for m in row:
        if at(m):
            out.append([])
        else:
            out[-1].append(m)
    return out


def stripped(row: Sequence[Mark], signs: str) -> list[Mark]:
    """Without such signs at either end."""
    row = list(row)
    while row and row[0].low in signs:
        row.pop(0)
    while row and row[-1].low in signs:
        row.pop()
    return row


def without(row: Sequence[Mark], words: frozenset[str]) -> list[Mark]:
    """Without one leading word of a kind."""
    return list(row[1:] if row and row[0].low in words else row)
