"""The ledger of facts by windows against a fold of one step after the other, and turns as transactions of a stream."""

import random

import pytest

from brindle.operators import facts
from brindle.streaming import transactions as tx

VOCABULARY = {"wool": "material", "silk": "material", "red": "color", "blue": "color", "pockets": "feature", "hood": "feature", "soft": "other", "boots": "category", "hats": "category"}
FILLER = ["and", "the", "no", "without", "whatever", "optional", "two", "three", "also", "actually", "instead", ".", ";"]


def conversations(seed, sessions=25, turns=6):
    r = random.Random(seed)
    return [(s, t, " ".join(r.choice(list(VOCABULARY) if r.random() < 0.55 else FILLER) for _ in range(r.randint(0, 9)))) for s in range(sessions) for t in range(1, turns + 1)]


def folded(rows, mode):
    known = {w: [(a, w)] for w, a in VOCABULARY.items()}
    out = {}
    for s, _, text in rows:
        out[s] = tx.fold(out.get(s, []), tx.read(text, known, facts.Cues()), mode)
    return {(s, *f) for s, held in out.items() for f in held}


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(w, a, w) for w, a in VOCABULARY.items()], "word string, attribute string, value string")


@pytest.mark.parametrize("mode", facts.MODES)
@pytest.mark.parametrize("seed", [1, 2])
def test_windows_and_fold_agree(spark, vocabulary, mode, seed):
    rows = conversations(seed)
    said = facts.statements(spark.createDataFrame(rows, "session_id long, turn int, text string"), vocabulary)
    got = facts.standing(facts.versions(said, mode)).collect()
    assert {(r["session_id"], r["attribute"], r["value"], r["polarity"], r["owner_attribute"], r["owner_value"]) for r in got} == folded(rows, mode)
    assert len(got) == len(folded(rows, mode)) > 40


def stories(spark, vocabulary, told, mode):
    """What is left of each story (a row of messages): all of them are sessions of one table."""
    rows = [(k, i, t) for k, messages in enumerate(told) for i, t in enumerate(messages, 1)]
    m = spark.createDataFrame(rows, "session_id long, turn int, text string")
    out = [set() for _ in told]
    for r in facts.versions(facts.statements(m, vocabulary), mode).collect():
        out[r["session_id"]].add((r["value"], r["polarity"], r["since"], r["until"]))
    return out


ENDS = [
    (("red", "blue"), {("red", 1, 1, 2), ("blue", 1, 2, None)}),
    (("red", "also blue"), {("red", 1, 1, None), ("blue", 1, 2, None)}),
    (("wool", "silk"), {("wool", 1, 1, None), ("silk", 1, 2, None)}),
    (("wool", "actually silk"), {("wool", 1, 1, 2), ("silk", 1, 2, None)}),
    (("wool", "no wool"), {("wool", 1, 1, 2), ("wool", -1, 2, None)}),
    (("red", "red whatever", "blue"), {("red", 1, 1, 2), ("any", 0, 2, 3), ("blue", 1, 3, None)}),
    (("hood", "hood optional"), {("hood", 1, 1, 2), ("hood", 0, 2, None)}),
    (("red", None, ""), {("red", 1, 1, None)}),
    (("two pockets", "no pockets", "pockets"), {("pockets", 1, 1, 2), ("two pockets", 1, 1, 2), ("pockets", -1, 2, 3), ("pockets", 1, 3, None)}),
    (("two pockets", "three pockets"), {("pockets", 1, 1, 2), ("two pockets", 1, 1, 2), ("pockets", 1, 2, None), ("three pockets", 1, 2, None)}),
    (("two pockets", "red", "pockets"), {("pockets", 1, 1, 3), ("pockets", 1, 3, None), ("two pockets", 1, 1, None), ("red", 1, 2, None)}),
]


def test_what_ends_a_fact(spark, vocabulary):
    assert stories(spark, vocabulary, [m for m, _ in ENDS], "ledger") == [want for _, want in ENDS]
    assert stories(spark, vocabulary, [("red", "blue")], "history") == [{("red", 1, 1, None), ("blue", 1, 2, None)}]
    assert stories(spark, vocabulary, [("wool", "silk")], "latest") == [{("wool", 1, 1, 2), ("silk", 1, 2, None)}]


def test_empty_and_wrong_mode(spark, vocabulary):
    none = spark.createDataFrame([], "session_id long, turn int, text string")
    assert facts.versions(facts.statements(none, vocabulary)).count() == 0
    with pytest.raises(ValueError):
        facts.versions(facts.statements(none, vocabulary), "newest")


def test_transactions(spark, tmp_path):
    rows = [(1, 1, 1, "red wool"), (1, 2, 1, "red wool"), (1, 3, 1, "red"), (1, 4, 2, None), (1, 5, 2, "no wool"), (1, 6, 3, "red blue soft hood wool pockets silk"), (1, 7, 3, "blue"), (2, 1, 9, ""), (2, 2, 9, "")]
    shape = "session_id long, seq long, turn int, message string"
    for part, some in enumerate((rows[:4], rows[4:])):  # two batches: state lives between them
        spark.createDataFrame(some, shape).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    settings = tx.Settings(tuple((w, a, w) for w, a in VOCABULARY.items()), most_facts=4)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = sorted(map(tuple, tx.run(tx.transact(stream, settings), str(tmp_path / "run")).collect()))
    assert [r[3] for r in got] == ["committed", "cached", "rejected", "failed", "committed", "failed", "committed", "committed", "cached"]
    assert got[0][4:] == got[1][4:] and got[4][5] != got[0][5] and [r[4] for r in got] == [2, 2, None, None, 2, None, 2, 0, 0]


def test_turns_refuse_unknown_modes():
    with pytest.raises(ValueError):
        tx.Turns(tx.Settings((), mode="newest"))
