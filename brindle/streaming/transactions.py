"""Turns of a session as transactions of a keyed stream.

A session's state is its facts and its last answer.  A turn works on a staged copy of the facts and commits only when all of it
has succeeded; a turn that fails leaves everything as it was, so it can be sent again.  The last turn sent again word for word
gets the answer it had; older or changed turns are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.facts import ANY, MODES, OPEN, STICKY, Cues
from .windows import run_to_end

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WORD = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"[.;!?\n]+")


class Fact(NamedTuple):
    attribute: str
    value: str
    polarity: int
    owner_attribute: str | None = None
    owner_value: str | None = None


class Said(NamedTuple):
    clause: int
    place: int
    fact: Fact
    additive: bool
    replacement: bool


def read(text: str, vocabulary: dict[str, list[tuple[str, str]]], cues: Cues) -> list[Said]:
    """What operators.facts.statements finds in a message; vocabulary: word -> (attribute, value)."""
    out = []
    for clause, part in enumerate(_CLAUSE.split(text.lower())):
        w = _WORD.findall(part)
        adds, replaces = not set(w).isdisjoint(cues.additive), not set(w).isdisjoint(cues.replacement)
        denied = False
        for i, word in enumerate(w):
            prior, follows = w[i - 1] if i else None, w[i + 1] if i + 1 < len(w) else None
            for attribute, value in vocabulary.get(word, ()):
                sign = -1 if denied else 1
                neutral = follows in cues.neutral
                fact = Fact(attribute, ANY, 0) if neutral else Fact(attribute, value, 0 if follows in cues.relaxed else sign)
                out.append(Said(clause, i + 1, fact, adds, replaces))
                if prior in cues.quantities and not neutral:
                    out.append(Said(clause, i + 1, Fact("other", f"{prior} {value}", sign, attribute, value), adds, replaces))
            denied = denied or word in cues.denial
    return out


def _ends(f: Fact, group: list[Said], slot: bool, mode: str) -> bool:
    """Whether the statements of a step about an attribute end a fact of it."""
    new = [s.fact for s in group]
    if mode == "latest":
        return True
    if mode == "history":
        return f in new
    if any(n.value == f.value or n[1:3] == (ANY, 0) for n in new) or f[1:3] == (ANY, 0):
        return True
    if f.owner_value is not None and any(n[3:] == f[3:] for n in new):
        return True
    if f.polarity != 1:
        return False
    return slot or f.attribute == "other" and any(n.polarity == -1 and f" {n.value} " in f" {f.value} " for n in new)


def step(facts: list[Fact], said: list[Said], mode: str) -> list[Fact]:
    """The facts that stand after one step: a clause in mode "ledger", else a turn."""
    kept, added = list(facts), []
    for attribute in dict.fromkeys(s.fact.attribute for s in said):
        group = [s for s in said if s.fact.attribute == attribute]
        replaces = any(s.replacement for s in group)
        adds = any(s.additive for s in group) and not replaces
        if mode != "history":
            any_at = max(((s.clause, s.place) for s in group if s.fact[1:3] == (ANY, 0)), default=None)
            if any_at is not None:
                behind = [s for s in group if (s.clause, s.place) > any_at]
                group = behind or [s for s in group if (s.clause, s.place) == any_at and s.fact[1:3] == (ANY, 0)]
        signs = {s.fact.polarity for s in group}
        slot = 1 in signs and not adds and attribute not in OPEN and (attribute not in STICKY or replaces and -1 not in signs)
        kept = [f for f in kept if f.attribute != attribute or not _ends(f, group, slot, mode)]
        added += dict.fromkeys(s.fact for s in group)
    now = kept + added
    owners = {(f.attribute, f.value) for f in now if f.polarity == 1 and f.owner_value is None}
    return [f for f in now if f.polarity != 1 or f.owner_value is None or f[3:] in owners]


def fold(facts: list[Fact], said: list[Said], mode: str) -> list[Fact]:
    """The facts after a turn."""
    if mode != "ledger":
        return step(facts, said, mode) if said else facts
    for clause in sorted({s.clause for s in said}):
        facts = step(facts, [s for s in said if s.clause == clause], mode)
    return facts


@dataclass(frozen=True)
class Settings:
    """vocabulary: (word, attribute, value); most_facts: a turn that would leave more facts fails; ttl_ms: how long an idle session is kept, for ever at 0."""

    vocabulary: tuple[tuple[str, str, str], ...]
    cues: Cues = Cues()
    mode: str = "ledger"
    most_facts: int = 1000
    ttl_ms: int = 0


class Turns(StatefulProcessor):
    """Rows (session_id, seq, turn, message) of a session, in the order of seq within a batch, to (session_id, seq, turn, status, facts, answer)."""

    def __init__(self, settings: Settings):
        if settings.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.settings.ttl_ms or None
        self.facts = handle.getListState("facts", "attribute string, value string, polarity int, owner_attribute string, owner_value string", ttl)
        self.last = handle.getValueState("last", "turn int, digest string, facts int, answer string", ttl)
        self.vocabulary: dict[str, list] = {}
        for word, attribute, value in self.settings.vocabulary:
            self.vocabulary.setdefault(word, []).append((attribute, value))

    def _turn(self, facts: list[Fact], message: str | None) -> list[Fact]:
        """The staged copy after the turn; raises where the turn cannot be carried out."""
        if message is None:
            raise ValueError("a turn has a message")
        staged = fold(list(facts), read(message, self.vocabulary, self.settings.cues), self.settings.mode)
        if len(staged) > self.settings.most_facts:
            raise ValueError("too many facts")
        return staged

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        held = [Fact(*f) for f in self.facts.get()] if self.facts.exists() else []
        last = tuple(self.last.get()) if self.last.exists() else None
        out, changed = [], False
        for seq, turn, message in zip(batch["seq"].tolist(), batch["turn"].tolist(), batch["message"].tolist()):
            message = message if isinstance(message, str) else None
            digest = hashlib.sha256((message or "").encode()).hexdigest()
            if last is not None and message is not None and (turn, digest) == last[:2]:
                out.append((key[0], seq, turn, "cached", last[2], last[3]))
                continue
            if last is not None and turn <= last[0]:
                out.append((key[0], seq, turn, "rejected", None, None))
                continue
            try:
                staged = self._turn(held, message)
            except ValueError:
                out.append((key[0], seq, turn, "failed", None, None))
                continue
            answer = hashlib.sha256("\n".join(sorted("|".join(str(x) if x is not None else "" for x in f) for f in staged)).encode()).hexdigest()
            held, last, changed = staged, (turn, digest, len(staged), answer), True
            out.append((key[0], seq, turn, "committed", len(staged), answer))
        if changed:
            self.facts.put([tuple(f) for f in held]) if held else self.facts.clear()
            self.last.update(last)
        yield pd.DataFrame(out, columns=["session_id", "seq", "turn", "status", "facts", "answer"]).astype({"facts": "Int32"})

    def close(self) -> None:
        pass


def transact(turns: DataFrame, settings: Settings) -> DataFrame:
    """(session_id, seq, turn, status, facts, answer) of a stream of turns (session_id, seq, turn, message).

    status: committed, cached (the last turn again, word for word), rejected (an older turn, or the last one changed) or
    failed (nothing has changed).  answer is a digest of the facts that stand.  The session's state is in the keyed store; the query that runs this needs PROVIDER as its state
    store.  A null message fails; a null turn is refused upstream.
    """
    kind = turns.schema["session_id"].dataType.simpleString()
    shape = f"session_id {kind}, seq bigint, turn int, status string, facts int, answer string"
    keyed = turns.filter("turn is not null").selectExpr("session_id", "cast(seq as bigint) seq", "cast(turn as int) turn", "message").groupBy("session_id")
    return keyed.transformWithStateInPandas(Turns(settings), shape, "Append", "ProcessingTime" if settings.ttl_ms else "None")


def run(answers: DataFrame, folder: str) -> DataFrame:
    """transact() over what there is now, with its state in the store it needs; the session's setting is put back."""
    conf, name = answers.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        return run_to_end(answers, folder, "append")
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
