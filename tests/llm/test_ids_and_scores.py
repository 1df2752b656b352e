"""Null, repeated and non-integer ids, and scores against an enumeration of all label sequences."""

import itertools
import math
import os

import numpy as np
import pytest

from brindle.llm import decontaminate as dec, exact_dedup as exact, lm_score as lm, ngram_join as nj, packing, ranked_search as rs, suffix_dedup as sd, toxicity as tox
from brindle.llm.queries import tokenizer_path


@pytest.mark.parametrize("capacity", [1, 256])
def test_exact_dedup_with_null_ids(spark, capacity):
    rows = [(None, "a"), (None, "A"), (3, "a"), (None, "only null"), (None, "ONLY NULL"), (None, "only null"), (7, "b"), (7, "B"), (2, "b"), (None, None), (None, "")] + [(None, "hot")] * 20
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), capacity=capacity).collect()
    assert len(got) == len(rows) and {r["kept"] for r in got} == {True, False}
    groups = {}
    for r in got:
        groups.setdefault(r["digest"], []).append((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]))
    by_size = sorted(groups.values(), key=lambda g: (len(g), str(sorted(g, key=str))))
    assert [len(g) for g in by_size] == [2, 3, 3, 3, 20]
    for g in by_size:
        ids = {i for i, _, _, _ in g}
        if ids == {None}:
            assert sum(k for _, _, _, k in g) == 1 and {(keep, n) for _, keep, n, _ in g} == {(None, len(g))}
        else:
            top = max(i for i in ids if i is not None)
            assert all(k == (i == top) and keep == top for i, keep, _, k in g)


def test_ids_that_are_no_integers_are_refused_at_once(spark):
    docs = spark.createDataFrame([("x", "some text")], "doc_id string, text string")
    calls = [lambda: packing.pack(docs, tokenizer_path()), lambda: sd.suffix_dedup(docs), lambda: nj.ngram_components(docs), lambda: exact.exact_dedup(docs), lambda: rs.ranked_search(docs, docs, item_col="doc_id")]
    calls.append(lambda: dec.find_contamination(docs, docs.withColumnRenamed("doc_id", "item_id")))
    for call in calls:
        with pytest.raises(TypeError, match="ids must be integers"):
            call()


def test_decontamination_with_document_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "one two three"), (None, "four")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "two three")], "item_id int, text string")
    assert {(r["doc_id"], len(r["hits"])) for r in dec.find_contamination(docs, items).collect()} == {("x", 2), (None, 0)}


def enumerated(field, text):
    """The score by summing over all label sequences."""
    words = tox.TOKEN.findall(text.lower())
    emit = [field.bias + sum(field.weights.get(f, 0.0) for f in tox.features(w)) for w in words]
    total, ones = 0.0, np.zeros(len(words))
    for labels in itertools.product((0, 1), repeat=len(words)):
        weight = math.exp(sum(e for e, y in zip(emit, labels) if y) + sum(field.trans[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        ones += weight * np.array(labels)
    m = ones / total if len(words) else ones
    top = min(max(m.max(), tox.FLOOR), 1 - tox.FLOOR) if len(m) else tox.FLOOR
    x = (1.0, math.log(m.sum() + tox.FLOOR), math.log(top / (1 - top))) if len(m) else (1.0, math.log(tox.FLOOR), math.log(tox.FLOOR))
    return 1 / (1 + math.exp(-float(np.dot(field.calibration, x))))


def test_toxicity_scores_against_enumeration(spark):
    bad = [f"you are a vile{i % 3} rotten creature indeed{i}" for i in range(12)]
    good = [f"we are a kind people of town number{i} indeed" for i in range(30)]
    field = tox.fit(bad + good, [1] * 12 + [0] * 30)
    texts = ["you vile1 rotten", "a kind people", "rotten rotten kind", "Vile2! creature of the town", "", None, "word", "unseen words only here now then"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, field).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(enumerated(field, t or ""), abs=1e-9)
    assert got[0] > 0.5 > got[1]
    again = tox.Field(*field.plain())
    assert again.weights == field.weights and again.bias == field.bias and (again.trans == field.trans).all() and (again.calibration == field.calibration).all()


def test_lm_score_leaves_the_environment_alone(spark):
    env = dict(spark.sparkContext.environment)
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 3) for i in range(6)], "doc_id long, text string")
    assert lm.lm_score(docs, words=10).count() == 6
    assert dict(spark.sparkContext.environment) == env and "OPENBLAS_NUM_THREADS" not in os.environ
