import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from brindle.sources import catalog as c
from brindle.streaming import ledger, windows


@pytest.fixture
def catalog(spark, tmp_path):
    rows = [
        {"parent_asin": "a", "title": "Red leather boots", "categories": ["Shoes", "Boots"], "features": ["warm", "no wool"], "details": {"Color": "Red"}, "store": "X", "price": "$1,299.00", "average_rating": 4.5, "rating_number": "12"},
        {"parent_asin": "b", "title": "Blue hat", "categories": [], "price": None, "average_rating": "NaN", "rating_number": "many", "extra": 1},
    ]
    path = tmp_path / "catalog.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    return c.read_catalog(spark, str(path))


def test_flatten_parses_numbers(catalog):
    a, b = c.flatten(catalog).orderBy("product_id").collect()
    assert (a["price"], a["rating"], a["reviews"], a["details"]) == (1299.0, 4.5, 12, "Color: Red")
    assert (b["price"], b["rating"], b["reviews"], b["features"]) == (None, None, None, "")


def test_index_round_trip_and_tampering(spark, catalog, tmp_path):
    flat = c.flatten(catalog)
    path = str(tmp_path / "index")
    c.build_index(flat, path)
    tables = c.open_index(spark, path)
    assert c.difference(tables["products"], flat).count() == 0
    assert tables["entries"].filter("index_name = 'category'").count() == 2
    tables["postings"].limit(1).write.mode("append").parquet(f"{path}/postings")
    with pytest.raises(ValueError):
        c.open_index(spark, path)


def test_problems_and_fingerprint(catalog):
    assert c.problems(catalog).count() == 0
    assert c.problems(catalog.unionByName(catalog)).count() == 2
    flat = c.flatten(catalog)
    assert c.fingerprint(flat) == c.fingerprint(flat.repartition(3)) != c.fingerprint(flat.limit(1))


def test_write_once(spark, tmp_path):
    df = spark.range(1)
    c.write_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        c.write_once(df, str(tmp_path / "out"))


DIALOGUE = [
    (1, "I'm looking for running shoes. A key requirement is: leather."),
    (2, "For that, what matters is: color: red; size wide."),
    (3, "Actually, ignore my earlier preference. What I need is: color: blue."),
    (3, "What I need is: color: green."),
    (4, "I don't want leather"),
    (5, "I don't have a preference for size; please use your judgment."),
]


def test_ledger_operations():
    book = ledger.Ledger()
    taken = [book.observe(m, t) for t, m in DIALOGUE]
    assert taken == [True, True, True, False, True, True]
    assert book.category == "running shoes"
    have = {(e.source, e.text) for e in book.evidence}
    assert ("override", "color: blue") in have and ("exclusion", "leather") in have
    assert not any("red" in e.text or e.source == "hard_constraint" for e in book.evidence)
    assert "size" in book.declined


def test_fold_is_independent_of_row_order(spark):
    turns = spark.createDataFrame([(s, t, m) for s in (1, 2) for t, m in DIALOGUE], "session_id long, turn int, message string")
    a = sorted(map(tuple, ledger.fold(turns).collect()))
    assert a == sorted(map(tuple, ledger.fold(turns.orderBy(F.desc("turn")).repartition(3)).collect())) and a


def test_stream_rejects_stale_turns(spark, tmp_path):
    src = str(tmp_path / "turns")
    schema = "session_id long, turn int, message string"
    spark.createDataFrame([(1, t, m) for t, m in DIALOGUE[:3]], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    folder = str(tmp_path / "run")
    first = windows.run_to_end(ledger.follow(stream), folder, "append")
    assert [r["status"] for r in first.orderBy("turn").collect()] == ["accepted"] * 3
    spark.createDataFrame([(1, 2, "I need wool"), (1, 4, "I don't want leather")], schema).coalesce(1).write.mode("append").parquet(src)
    both = windows.run_to_end(ledger.follow(stream), folder, "append")
    assert sorted((r["turn"], r["status"]) for r in both.collect()) == [(1, "accepted"), (2, "accepted"), (2, "rejected"), (3, "accepted"), (4, "accepted")]


TURNS = "session_id long, turn int, message string"


def followed(spark, src, rows, run, **how):
    """The updates of all batches so far, after these rows have arrived."""
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(src)
    return windows.run_to_end(ledger.follow(spark.readStream.schema(TURNS).parquet(src), **how), run, "append")


def test_stream_state_has_pages_of_sessions(spark, tmp_path):
    src, run = str(tmp_path / "turns"), str(tmp_path / "run")
    asked = [(s, t, m) for s in range(60) for t, m in DIALOGUE]
    first = followed(spark, src, [r for r in asked if r[1] < 4], run, pages=8)
    assert first.groupBy("session_id").count().filter("count = 4").count() == 60
    state = spark.read.format("statestore").load(f"{run}/state")
    assert 1 < state.count() <= 8  # a key for each session cost more than its turns
    later = [r for r in asked if r[1] >= 4 and r[0] % 3 == 0]  # other sessions of their pages stay as they are
    followed(spark, src, later, run, pages=8)
    every = followed(spark, src, [(1, 3, DIALOGUE[2][1]), (1, 2, "I need wool"), (2, 4, DIALOGUE[4][1])], run, pages=8)
    tally = {(r["session_id"], r["status"]): r["count"] for r in every.groupBy("session_id", "status").count().collect()}
    assert (tally[0, "accepted"], tally[0, "rejected"]) == (5, 1)
    assert (tally[1, "accepted"], tally[1, "rejected"], tally[1, "repeated"]) == (3, 2, 1)
    assert (tally[2, "accepted"], tally[4, "accepted"]) == (4, 3)
    with pytest.raises(Exception, match="pages"):
        followed(spark, src, [(5, 9, "red"), (6, 9, "red"), *((s, 9, "red") for s in range(60))], run, pages=4)


def test_stream_takes_turns_of_a_batch_as_the_fold_does(spark, tmp_path):
    rows = [(1, 3, "no cotton"), (1, 2, "no wool"), (1, 2, "I don't have a preference for size"), (1, 1, "I'm looking for hats. red")]
    last = followed(spark, str(tmp_path / "turns"), rows, str(tmp_path / "run")).filter("status = 'accepted'").orderBy("turn").collect()
    assert [r["turn"] for r in last] == [1, 2, 3]
    assert last[-1]["evidence"] == ledger.fold(spark.createDataFrame(rows, TURNS)).count()


def test_stream_of_odd_sessions_is_whole(spark, tmp_path):
    big = 2**53 + 1
    rows = [(None, 1, "red"), (big, 1, "red"), (big - 1, 1, None), (big, None, "blue"), (-1, 1, "red"), (big, 2, "a\tb\nc")]
    src, run = str(tmp_path / "turns"), str(tmp_path / "run")
    for batches in (1, 2):  # the same rows again are repeated or stale
        out = followed(spark, src, rows, run, pages=1)
    have = sorted((tuple(r)[:3] for r in out.collect()), key=str)
    taken = [(None, 1, "accepted"), (big, 1, "accepted"), (big - 1, 1, "accepted"), (big, None, "rejected"), (-1, 1, "accepted"), (big, 2, "accepted")]
    again = [(None, 1, "repeated"), (big, 1, "rejected"), (big - 1, 1, "repeated"), (big, None, "rejected"), (-1, 1, "repeated"), (big, 2, "repeated")]
    assert have == sorted(taken + again, key=str)


def test_idle_sessions_leave_their_page(spark, tmp_path):
    src, out = str(tmp_path / "turns"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(src)

    def seen(n):
        for _ in range(240):
            time.sleep(0.25)
            if (rows := spark.read.schema(ledger.UPDATES).parquet(out).collect() if os.path.isdir(out) else []) and len(rows) >= n:
                return {(r["session_id"], r["turn"], r["status"]) for r in rows}
        raise AssertionError("no answer")

    arrive((1, 5, "red"), (2, 5, "red"))
    updates = ledger.follow(spark.readStream.schema(TURNS).parquet(src), GroupStateTimeout.ProcessingTimeTimeout, 30_000, pages=1)
    q = updates.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).start()
    try:
        seen(2)
        time.sleep(16)
        arrive((2, 6, "blue"))
        seen(3)
        time.sleep(16)
        arrive((1, 4, "red"), (2, 4, "red"))  # the first is new again, the second is still known
        assert seen(5) >= {(1, 4, "accepted"), (2, 4, "rejected")}
    finally:
        q.stop()
