"""Periodic runs, ranked search and fingerprints against brute-force versions, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import fingerprints as fp, periodic_runs as pr, queries, ranked_search as rs

DOCS = "doc_id long, text string, runs string, bucket string, terms string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 7) for i, t in rows], DOCS)


def prose(seed, n, words=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 7))) for _ in range(words)]
    return " ".join(r.choice(vocab) + r.choice(["", "", ".", "!\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \n\t\x0b", "One two", "a " * 30, "a b " * 9 + "c", "  b  " * 8, "x" * 3000, prose(1, 30), prose(2, 200), prose(2, 200), prose(2, 200).upper(), prose(3, 1500)]
    out += [" ".join((prose(s, 7, 5) + " ") * r for s, r in ((4, 5), (5, 4), (6, 3))) for _ in range(2)]
    return out + [prose(50 + s, 80 + 7 * s) for s in range(25)]


# ---- periodic runs


def brute_runs(w, power=4, least=6):
    """Every maximal stretch of every period; the smallest period of a stretch counts."""
    out = {}
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, power * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, p, n) for (s, n), p in out.items())


def brute_collapsed(w, runs):
    gone = {i for s, p, n in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize(("power", "least"), [(4, 6), (2, 1), (3, 4)])
def test_runs_of_small_alphabets(power, least):
    r = random.Random(power)
    for _ in range(150):
        docs = []
        for _ in range(r.randint(1, 6)):
            n, k = r.randint(0, 60), r.randint(1, 3)
            d = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(3, 9)
                d = d[:a] + [d[a + i % p] for i in range(n - a)]
            docs.append(np.array(d, np.int64))
        for d, got in zip(docs, pr.runs_of(docs, power=power, least=least)):
            assert [(s, p, n) for s, n, p in got.tolist()] == brute_runs(d.tolist(), power, least)


def test_runs_in_parts_of_the_grid(monkeypatch):
    monkeypatch.setattr(pr, "PAIRS", 7)
    d = np.array([0, 1, 2] * 12 + [5] * 9 + [0, 1, 2] * 4)
    assert [(s, p, n) for s, n, p in pr.runs_of([d, d[:0], d])[2].tolist()] == brute_runs(d.tolist())


def test_suffix_array_and_minima():
    r = random.Random(3)
    w = np.array([r.randrange(3) for _ in range(300)] + [9])
    rank, common = pr.suffix_array(w)
    order = sorted(range(301), key=lambda i: w[i:].tolist())
    assert [order[k] for k in rank.tolist()] == list(range(301))
    share = lambda a, b: next(k for k in range(301) if w[a + k] != w[b + k])
    assert common[1:].tolist() == [share(order[k - 1], order[k]) for k in range(1, 301)]
    least = pr.Least(common)
    lo, hi = np.array([1, 5, 20, 100, 299, 33]), np.array([300, 5, 60, 290, 300, 47])
    assert least(lo, hi).tolist() == [common[a : b + 1].min() for a, b in zip(lo, hi)]


def test_periodic_runs(spark, texts):
    rows = [*enumerate(texts), (3, "repeated id " * 5), (None, "null id " * 6)]
    got = pr.periodic_runs(frame(spark, rows).repartition(3), batch_words=300).collect()
    want = []
    for i, t in rows:
        w = words(t)
        runs = brute_runs(w)
        want.append((i, len(w), [(s, n, p) for s, p, n in runs], brute_collapsed(w, runs)))
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got), key=key) == sorted(want, key=key)
    assert sum(len(x[2]) for x in want) > 8
    assert pr.periodic_runs(frame(spark, [])).count() == 0


def test_long_text_with_long_period(spark):
    w = [f"w{i}" for i in range(9000)] * 5
    got = pr.periodic_runs(frame(spark, [(1, " ".join(w))])).first()
    assert [tuple(x) for x in got["runs"]] == [(0, 45000, 9000)] and got["collapsed"] == " ".join(w[:9000])


def brute_op11(i, t):
    w = words(t)
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    told = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
    return (i, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest())


def test_op11_query(spark, texts, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts * 6)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == [brute_op11(i, t) for i, t in rows]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and len(words(t)) > 20 for i, t in rows) > 5


# ---- ranked search


def brute_terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(docs, items, top, once=True):
    held = [(i, Counter(brute_terms(t))) for i, t in docs if brute_terms(t)]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = []
    for item, t in items:
        asked = Counter(brute_terms(t))
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // total
            s = sum((1 if once else asked[x]) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in asked if x in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=lambda x: (str(x[0]), x[1], x[2] or -1))


@pytest.mark.parametrize(("how", "once"), [({}, True), ({"block_docs": 3, "parts": 1, "block_chars": 60}, True), ({"block_docs": 5}, False)])
def test_ranked_search(spark, texts, how, once):
    docs = [*enumerate(texts), (3, "One two"), (None, "One two"), (77, "Common-word_here 12")]
    items = [("a", "One, TWO two"), ("b", prose(2, 25)), ("c", None), ("d", "!?"), ("e", "nowhere at all 漢字"), (None, prose(3, 40)), ("f", "a b c é one 12")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, score int")
    got = rs.ranked_search(frame(spark, docs).repartition(4), asked, top=4, once=once, **how).collect()
    assert sorted(map(tuple, got), key=lambda x: (str(x[0]), x[1], x[2] or -1)) == brute_search(docs, items, 4, once)


def test_ranked_search_ties_repeats_and_nothing(spark):
    docs = frame(spark, [(k, "same text") for k in range(30)] + [(40, "other")]).repartition(5)
    items = spark.createDataFrame([(1, "same"), (1, "same"), (2, "text same")], "item_id int, text string")
    got = rs.ranked_search(docs, items, top=7, block_docs=2)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted([(1, k + 1, k) for k in range(7)] * 2 + [(2, k + 1, k) for k in range(7)])
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["item_id"] == "int"
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (frame(spark, [(1, None), (2, "..")]), items)):
        empty = rs.ranked_search(d, i)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


# ---- fingerprints


def shingles(t):
    w = [x.encode() for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_edits_and_prints(spark, texts):
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in fp.compare_edits(frame(spark, rows).repartition(5)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        t, after, r = t or "", texts[(i + 1) % len(texts)] or "", got[i]
        n = len(t) // 2
        assert r["n_chars"] == len(t) and r["edited"] == t[: len(t) - n] + after[:n]
        a, b, c = shingles(t), shingles(r["edited"]), shingles(after)
        alike = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        assert abs(r["near_edited"] - alike[0]) < 0.12 and abs(r["near_next"] - alike[1]) < 0.12, (i, alike, r["near_edited"], r["near_next"])
    prints = {r[0]: r[1] for r in fp.fingerprints(frame(spark, rows)).collect()}
    assert prints == {i: r["fingerprint"] for i, r in got.items()}
    assert prints[9] == prints[10] and prints[0] == prints[1] == prints[2] and len(set(prints.values())) > 20 and {len(x) for x in prints.values()} == {512}


def brute_print(t, sketch):
    """Bin by bin, in Python integers, from the library's shingle hashes."""
    from brindle.llm.common import mix64
    from brindle.llm.ngram_join import Shingler

    held = [int(h) for h in Shingler(5).raw([t])[0]] or [int(fp._BARE[0])]
    bins = {}
    for h in held:
        b = h >> (64 - (sketch.bins.bit_length() - 1))
        bins[b] = min(h, bins.get(b, h))
    out = ""
    for b in range(sketch.bins):
        at, attempt = b, 1
        while at not in bins:
            at = int(mix64(np.array([(b * 0x9E3779B97F4A7C15 + attempt) % 2**64], np.uint64))[0]) % sketch.bins
            attempt += 1
        told = int(mix64(np.array([(bins[at] + b * 0xC2B2AE3D27D4EB4F) % 2**64], np.uint64))[0])
        out += format(told & (2**sketch.bits - 1), f"0{sketch.bits}b")
    return format(int(out, 2), f"0{len(out) // 4}x")


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_sketch_bit_by_bit(texts, bits):
    from brindle.llm.ngram_join import Shingler

    sketch = fp.OnePermutation(64, bits)
    rows = sketch(Shingler(5).raw(texts))
    packed = sketch.pack(rows)
    assert packed == [brute_print(t, sketch) for t in texts]
    assert (sketch.unpack(packed) == rows).all()
    assert sketch.likeness(rows, rows).tolist() == [1.0] * len(texts)


def test_bias_correction_of_unlike_sets():
    r = np.random.default_rng(5)
    sketch = fp.OnePermutation(512, 2)
    a, b = (sketch([r.integers(0, 2**64, 300, np.uint64) for _ in range(200)]) for _ in range(2))
    assert 0.2 < (a == b).mean() < 0.3 and sketch.likeness(a, b).mean() < 0.02


def test_next_of_repeated_null_and_single_ids(spark):
    rows = [(5, "five five"), (5, "cinq cinq"), (None, "null null"), (1, "one one"), (None, None)]
    got = fp.compare_edits(frame(spark, rows).repartition(2)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 5, 5] and len(got) == 5
    assert {r["edited"] for r in got if r["doc_id"] == 1} <= {"one " + "five five"[:3], "one " + "cinq cinq"[:3]}
    alone = fp.compare_edits(frame(spark, [(9, "abcdef")])).collect()
    assert [(r["edited"], r["near_next"]) for r in alone] == [("abcabc", 1.0)]
    assert fp.compare_edits(frame(spark, [])).count() == 0
