"""Toxic spans and document scores from a linear-chain conditional random field.

Documents carry labels, the field needs labelled tokens: in toxic training
documents a token is toxic if its word, or its beginning, is much commoner in
toxic than in clean training documents; all other tokens are clean.  The field has
two states, emission weights for the word and its beginnings, and
four transition weights, fitted in numpy on the driver by gradient ascent from
forward-backward marginals.  Scoring runs forward-backward over every whole
document; the sum and maximum of the marginals go through a logistic
calibration to the document's score, and tokens with a marginal of at least
one half are the offending spans.

The fit uses a bounded sample of the labelled documents, taken whole and in hash order: at most ``max_train`` of them,
and no further ones once their texts have ``max_chars`` code points together.  Everything is fitted on all of the sample.  Tasks
cut its texts into words; the driver holds four bytes a word and each different word once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, tidied

TOKEN = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 400_000
FLOOR = 1e-4


def features(word: str) -> tuple[str, ...]:
    return ("w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5])


def _scan(weights: list[np.ndarray], start: float) -> np.ndarray:
    """Shares of state 1 after each of many steps on a pair of weights that begins with the share ``start``; weights: 0 to 0, 0 to 1, 1 to 0 and 1 to 1 of every step.

    The steps are laid out in lanes.  Every lane is run from both states at once, which gives what it does to any
    pair; then the lanes' beginnings follow one another, and all lanes run again from theirs.
    """
    n = len(weights[0])
    steps = max(1, int(np.sqrt(n) / 6))
    lanes = -(-n // steps)
    laid = []
    for w in weights:
        x = np.ones(lanes * steps)
        x[:n] = w
        laid.append(np.ascontiguousarray(x.reshape(lanes, steps).T))
    a, b, c, d = laid
    u0, u1, v0, v1 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(steps):
        u0, u1 = u0 * a[t] + u1 * c[t], u0 * b[t] + u1 * d[t]
        v0, v1 = v0 * a[t] + v1 * c[t], v0 * b[t] + v1 * d[t]
        if t % 4 == 3 or t == steps - 1:
            scale = 1 / (u0 + u1 + v0 + v1)
            u0, u1, v0, v1 = u0 * scale, u1 * scale, v0 * scale, v1 * scale
    begin, p = np.empty(lanes), start
    for k, (x0, x1, y0, y1) in enumerate(zip(u0.tolist(), u1.tolist(), v0.tolist(), v1.tolist())):
        begin[k] = p
        zero, one = (1 - p) * x0 + p * y0, (1 - p) * x1 + p * y1
        p = one / (zero + one)
    out, p = np.empty((steps, lanes)), begin
    for t in range(steps):
        one = b[t] + p * (d[t] - b[t])
        p = one / (one + a[t] + p * (c[t] - a[t]))
        out[t] = p
    return out.T.ravel()[:n]


def forward_backward(emit: list[np.ndarray], trans: np.ndarray, count: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Marginals of state 1 for each sequence, and expected transition counts if count.  emit: scores of state 1 against state 0; trans: 2x2 scores.

    All sequences run as one, whose steps forget what was before where a sequence begins.
    """
    sizes = np.array([len(e) for e in emit], dtype=np.int64)
    counts = np.zeros((2, 2))
    if not sizes.sum():
        return [np.zeros(0) for _ in emit], counts
    e = np.exp(np.clip(np.concatenate(emit), -30, 30))
    ends = np.cumsum(sizes)
    firsts = (ends - sizes)[sizes > 0]
    t = np.exp(np.clip(trans, -30, 30))
    m = [np.full(len(e), t[0, 0]), t[0, 1] * e, np.full(len(e), t[1, 0]), t[1, 1] * e]
    for k, w in enumerate(m):
        w[firsts] = e[firsts] if k % 2 else 1.0
    fwd = _scan(m, 0.5)
    back = np.empty(len(e))  # share of state 1 among the backward weights
    back[-1] = 0.5
    if len(e) > 1:
        back[:-1] = _scan([w[:0:-1] for w in (m[0], m[2], m[1], m[3])], 0.5)[::-1]
    up = fwd * back
    marginal = up / (up + (1 - fwd) * (1 - back))
    if count and len(e) > 1:
        g, b = fwd[:-1], back[1:]
        x = [(1 - g) * m[0][1:] * (1 - b), (1 - g) * m[1][1:] * b, g * m[2][1:] * (1 - b), g * m[3][1:] * b]
        inner = 1 / (x[0] + x[1] + x[2] + x[3])
        inner[firsts[1:] - 1] = 0.0  # steps from one sequence to the next
        counts = np.array([v @ inner for v in x]).reshape(2, 2)
    return np.split(marginal, ends[:-1]), counts


def in_groups(lengths: list[int], cells: int = 300_000) -> Iterator[list[int]]:
    """Sequence numbers in groups of at most cells tokens together, or one sequence."""
    group: list[int] = []
    size = 0
    for i, n in enumerate(lengths):
        if group and size + n > cells:
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group


def _summary(m: np.ndarray) -> tuple[float, float, float]:
    if not len(m):
        return 1.0, float(np.log(FLOOR)), float(np.log(FLOOR))
    top = min(max(float(m.max()), FLOOR), 1 - FLOOR)
    return 1.0, float(np.log(m.sum() + FLOOR)), float(np.log(top / (1 - top)))


class Field:
    """The fitted model: weights by feature, the other emission score, transitions and the calibration."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray | list, calibration: np.ndarray | list):
        self.weights, self.bias, self.trans, self.calibration = weights, bias, np.array(trans, float), np.array(calibration, float)

    def plain(self) -> tuple[dict[str, float], float, list, list]:
        """The parameters in builtin types, which executors read without this package; Field(*plain) is the same model."""
        return self.weights, float(self.bias), self.trans.tolist(), self.calibration.tolist()

    def scorer(self):
        cache: dict[str, float] = {}
        get = self.weights.get

        def score(word: str) -> float:
            v = cache.get(word)
            if v is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                v = cache[word] = self.bias + sum(get(f, 0.0) for f in features(word))
            return v

        return score

    def probability(self, m: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.calibration, _summary(m)), -500, 500))))


class Adam:
    """Gradient ascent with step sizes from running moments of the slopes."""

    def __init__(self, like: list[np.ndarray], rate: float = 0.3, keep1: float = 0.8, keep2: float = 0.9):
        self.m, self.v, self.t = [np.zeros_like(x) for x in like], [np.zeros_like(x) for x in like], 0
        self.rate, self.keep1, self.keep2 = rate, keep1, keep2

    def __call__(self, slopes: list[np.ndarray]) -> list[np.ndarray]:
        self.t += 1
        out = []
        for k, g in enumerate(slopes):
            self.m[k] = self.keep1 * self.m[k] + (1 - self.keep1) * g
            self.v[k] = self.keep2 * self.v[k] + (1 - self.keep2) * g * g
            out.append(self.rate * (self.m[k] / (1 - self.keep1**self.t)) / (np.sqrt(self.v[k] / (1 - self.keep2**self.t)) + 1e-3))
        return out


def cut(text: str | None) -> tuple[bytes, list[str], np.ndarray]:
    """(digest, different words, their numbers in order) of a lower-cased text."""
    lower = (text or "").lower()
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in TOKEN.findall(lower)], dtype=np.int32)
    return hashlib.blake2b(lower.encode("utf-8", "surrogatepass"), digest_size=16).digest(), list(numbers), ids


def fit(texts: list[str | None], toxic: list[int], **how) -> Field:
    """Fit on labelled documents."""
    return fit_cut((cut(t) for t in texts), toxic, **how)


def fit_cut(documents: Iterable[tuple[bytes, list[str], np.ndarray]], toxic: list[int], *, epochs: int = 25, least_docs: int = 4, least_share: float = 0.02, lift: float = 8.0) -> Field:
    """Fit on cut documents.  Copies count once.  With no toxic or no clean document every score is the base rate."""
    seen_digests: set[bytes] = set()
    types: dict[str, int] = {}
    seqs, labels = [], []
    for (digest, words, ids), label in zip(documents, toxic):
        if digest not in seen_digests:  # copies must not make their words look common
            seen_digests.add(digest)
            seqs.append(np.array([types.setdefault(w, len(types)) for w in words], dtype=np.int32)[ids] if len(ids) else np.zeros(0, np.int32))
            labels.append(label)
    y = np.array(labels, dtype=float)
    names = list(types)
    index: dict[str, int] = {}
    rows = np.array([[index.setdefault(f, len(index)) for f in features(w)] for w in names], dtype=np.int64).reshape(-1, 4)
    telltale = [0, 2, 3]  # features that make a token toxic: the word and its longer beginnings
    df = np.zeros((2, len(index)))
    for s, label in zip(seqs, labels):
        if len(s):
            df[int(bool(label)), np.unique(rows[np.unique(s)][:, telltale])] += 1
    n_bad, n_ok = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    telling = (df[1] >= max(least_docs, least_share * n_bad)) & (df[1] / n_bad > lift * (df[0] + 1) / n_ok)
    is_bad = telling[rows[:, telltale]].any(axis=1)
    total = max(1, sum(map(len, seqs)))
    gold_types, gold_trans = np.zeros(len(names)), np.zeros((2, 2))
    for s, label in zip(seqs, labels):
        g = is_bad[s] if label else np.zeros(len(s), bool)
        gold_types += np.bincount(s[g], minlength=len(names)) if g.any() else 0
        if len(s) > 1:
            gold_trans += np.bincount(g[:-1] * 2 + g[1:], minlength=4).reshape(2, 2)
    rate = (gold_types.sum() + 1) / (total + 2)
    weights, bias, trans = np.zeros(len(index)), float(np.log(rate / (1 - rate))), np.zeros((2, 2))
    step = Adam([weights, np.zeros(1), trans])
    groups = list(in_groups([len(s) for s in seqs]))
    for _ in range(epochs if len(names) else 0):
        emission = bias + weights[rows].sum(axis=1)
        seen, trans_seen = np.zeros(len(names)), np.zeros((2, 2))
        for group in groups:
            marginals, counts = forward_backward([emission[seqs[i]] for i in group], trans)
            trans_seen += counts
            seen += np.bincount(np.concatenate([seqs[i] for i in group]), np.concatenate(marginals), len(names))
        slope_types = gold_types - seen
        slope = sum(np.bincount(rows[:, k], slope_types, len(index)) for k in range(4))
        dw, db, dt = step([slope - 0.02 * weights, np.array([slope_types.sum()]), gold_trans - trans_seen - 0.05 * trans])
        weights, bias, trans = weights + dw, bias + float(db[0]), trans + dt
    weights[np.abs(weights) <= 1e-3] = 0.0
    field = Field({f: float(weights[i]) for f, i in index.items() if weights[i]}, float(bias), trans, np.zeros(3))
    emission = bias + weights[rows].sum(axis=1)
    x = np.zeros((len(seqs), 3))
    for group in groups:
        for i, m in zip(group, forward_backward([emission[seqs[i]] for i in group], trans, False)[0]):
            x[i] = _summary(m)
    base = (y.sum() + 0.5) / (len(y) + 1)
    c = np.array([np.log(base / (1 - base)), 0.0, 0.0])
    if 0 < y.sum() < len(y):
        ridge = np.array([0.01, 0.5, 0.5])
        for _ in range(40):  # damped Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            move = np.linalg.solve(h, x.T @ (y - p) - ridge * c)
            c = c + move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
    field.calibration = c
    return field


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 6000, max_chars: int = 64_000_000) -> Field:
    """Fit on labelled rows of docs, whole and in the order of a hash of their ids: max_train of them at most, and none after those that have max_chars code points together (but one).

    Null labels and labels without a document do not count; a document that has two labels, or stands in two rows, counts with each.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).filter("y is not null and __id is not null")
    some = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id", "y").limit(max_train))
    joined = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(some, F.col("i") == F.col("__id"))
    sizes = joined.groupBy("__id").agg(F.sum(F.coalesce(F.length("t"), F.lit(0))).alias("n"), F.xxhash64("__id").alias("h")).collect()  # max_train rows at most
    total, taken = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["__id"])):
        total += r["n"]
        if taken and total > max_chars:
            break
        taken.append(r["__id"])
    if len(taken) < len(sizes):
        joined = joined.filter(F.col("__id").isin(taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([d for d, _, _ in done], pa.binary()), pa.array([w for _, w, _ in done], pa.list_(pa.string())), pa.array([ids.tobytes() for _, _, ids in done], pa.binary())], ["i", "y", "digest", "words", "ids"])

    id_type = joined.schema["i"].dataType.simpleString()
    rows = joined.select("i", "t", "y").mapInArrow(tidied(run), f"i {id_type}, y int, digest binary, words array<string>, ids binary").toArrow()
    rows = rows.sort_by([("i", "ascending"), ("digest", "ascending"), ("y", "ascending")])
    documents = ((r["digest"].as_py(), r["words"].as_py(), np.frombuffer(r["ids"].as_py(), np.int32)) for b in rows.to_batches() for r in _rows_of(b))
    field = fit_cut(documents, rows["y"].to_pylist())
    del rows, documents
    give_back()
    return field


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    return ({name: batch.column(name)[k] for name in ("digest", "words", "ids")} for k in range(batch.num_rows))


def score_toxicity(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) for every document; spans are (start, end, p) in code points.

    Only the text enters the score.  Null and empty texts get the score of a
    text with no tokens.  Repeated rows and rows with null ids are scored each, equal texts (ties) alike; an
    empty table gives no rows; extra columns are ignored.  Documents are settled where they are read.
    """
    schema, run = _scoring(docs.select(id_col, text_col), field, text_col, keep=None)
    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)


def drop_toxic(docs: DataFrame, field: Field, *, text_col: str = "text", reject: float = 0.3) -> DataFrame:
    """docs without the rows whose score reaches reject; the rows pass through whole with all their columns, without a join."""
    schema, run = _scoring(docs, field, text_col, keep=reject)
    return docs.mapInArrow(tidied(run), schema)


def places_of(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of text for every token of its lower-cased form, which may be longer."""
    lower = text.lower()
    spans = [x.span() for x in TOKEN.finditer(lower)]
    if len(lower) == len(text):
        return spans
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    if len(origin) != len(lower):  # lower-casing looked at neighbours too
        origin = [min(i, len(text) - 1) for i in range(len(lower))]
    return [(origin[s], origin[e - 1] + 1) for s, e in spans]


def _score_texts(model: Field, score, texts: list[str]) -> tuple[list[float], list[list[dict]]]:
    emits = [np.array(list(map(score, TOKEN.findall(t.lower())))) for t in texts]
    scores, spans = [0.0] * len(texts), [[] for _ in texts]
    for group in in_groups([len(e) for e in emits]):
        for i, m in zip(group, forward_backward([emits[i] for i in group], model.trans, False)[0]):
            scores[i] = model.probability(m)
            hot = np.flatnonzero(m >= 0.5)
            if len(hot):
                places = places_of(texts[i])
                spans[i] = [{"start": places[k][0], "end": places[k][1], "p": float(m[k])} for k in hot]
    return scores, spans


def _scoring(source: DataFrame, field: Field, text_col: str, keep: float | None):
    """Schema and mapInArrow function: the score and spans of each row, or the whole rows that score under keep."""
    held = source.sparkSession.sparkContext.broadcast(field.plain())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    where = source.columns.index(text_col)
    schema = source.schema if keep is not None else f"`{source.columns[0]}` {source.schema[0].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint,p:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*held.value)
        score = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                scores, spans = _score_texts(model, score, [t or "" for t in part.column(where).to_pylist()])
                if keep is not None:
                    yield part.filter(pa.array([s < keep for s in scores]))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], [part.schema.names[0], "score", "spans"])

    return schema, run
