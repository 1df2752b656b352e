"""Counted terms of documents, and their product with a batch of queries.

A text is cut in Arrow's kernels and its terms become numbers of the queries' vocabulary, so a document is one row whatever its
length: how many terms it has, the asked ones with their counts, and the searched phrases with theirs.  A task multiplies blocks of such rows
with all queries and keeps the best documents of each; only these are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.text import STOP_WORDS

#: of lower-case text only ASCII letters and digits belong to terms
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RUN = 2_000_000  # bytes of text cut at a time
BLOCK = 8192  # documents in one block of the product


def text_runs(batches: Iterator[pa.RecordBatch], size: int = RUN) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about size bytes of their second column, a text; one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1).cast(pa.large_string())).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def numbers_of(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, texts' numbers) of the terms of lower-case texts in order; known: an empty word, the stop words, which are left out, and the vocabulary.  Terms outside it are -1."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    folded = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(_FOLD)
    blank = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(folded))
    parts = pc.ascii_split_whitespace(blank)
    at = pc.fill_null(pc.index_in(parts.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    kept = (at < 0) | (at > len(STOP_WORDS))
    return np.maximum(at[kept].astype(np.int64) - len(STOP_WORDS) - 1, -1), text[kept]


def known_words(vocabulary: list[str]) -> pa.Array:
    return pa.array(["", *STOP_WORDS, *vocabulary], pa.large_string())


class Phrases:
    """Phrases of word numbers as a trie whose edges are sorted numbers: all places of a run walk it together, one word at a time."""

    def __init__(self, phrases: list[list[int]], words: int):
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for i, phrase in enumerate(phrases):
            node = 0
            for w in phrase:
                node = nodes.setdefault((node, w), len(nodes) + 1)
            ends[node] = i
        self.words, self.sizes = words, [len(p) for p in phrases]
        self.edges = np.array(sorted(a * words + w for a, w in nodes), np.int64)
        self.to = np.array([nodes[divmod(e, words)] for e in self.edges.tolist()], np.int64)
        self.end = np.array([ends.get(n, -1) for n in range(len(nodes) + 1)], np.int64)

    def times(self, numbers: np.ndarray, text: np.ndarray) -> dict[tuple[int, int], int]:
        """How often a text holds a phrase, by (text, phrase); of places that touch or overlap the first counts."""
        at, node, found = np.arange(len(numbers)), np.zeros(len(numbers), np.int64), []
        for depth in range(max(self.sizes, default=0)):
            inside = at + depth < len(numbers)
            at, node = at[inside], node[inside]
            word = numbers[at + depth]
            inside = (word >= 0) & (text[at + depth] == text[at])
            at, edge = at[inside], node[inside] * self.words + word[inside]
            place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            hit = self.edges[place] == edge
            at, node = at[hit], self.to[place[hit]]
            whole = self.end[node] >= 0
            found.append((self.end[node[whole]], at[whole]))
        out: dict[tuple[int, int], int] = {}
        free: dict[tuple[int, int], int] = {}
        for phrase, places in found:
            for key, a in zip(zip(text[places].tolist(), phrase.tolist()), places.tolist()):
                if a >= free.get(key, 0):
                    free[key] = a + self.sizes[key[1]] + 1
                    out[key] = out.get(key, 0) + 1
        return out


def _lists(row: np.ndarray, rows: int, *columns: pa.Array) -> list[pa.Array]:
    """Columns as lists, one for each row; row is ascending."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), c) for c in columns]


def count_texts(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str], phrases: list[list[str]]) -> DataFrame:
    """(doc_id, n, tokens, times, phrases, phrase_times): one row for each document, with the numbers of asked terms and of phrases it holds and how often.

    Rows of few splits are dealt to three tasks a core first.
    """
    words = {w: i for i, w in enumerate(vocabulary)}
    asked = [[words[w] for w in p] for p in phrases]
    size = max(1, len(vocabulary))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        rows = docs.select(id_col, text_col).repartition(3 * cores).select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, searched = known_words(held.value[0]), Phrases(held.value[1], size)
        for part in text_runs(batches):
            numbers, text = numbers_of(part.column(1), known)
            key, times = np.unique((text * size + numbers)[numbers >= 0], return_counts=True)
            tokens = _lists(key // size, part.num_rows, pa.array((key % size).astype(np.int32)), pa.array(times.astype(np.float64)))
            met = searched.times(numbers, text)
            at = sorted(met)
            places = _lists(np.array([t for t, _ in at], np.int64), part.num_rows, pa.array([p for _, p in at], pa.int32()), pa.array([met[x] for x in at], pa.int32()))
            n = np.bincount(text, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *tokens, *places], ["doc_id", "n", "tokens", "times", "phrases", "phrase_times"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, tokens array<int>, times array<double>, phrases array<int>, phrase_times array<int>")


def rounded(x: np.ndarray) -> np.ndarray:
    """Nine decimals as Spark's round gives them: halves of the shortest decimal form away from zero."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5) / 1e9
    for i in np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3) | (np.abs(scaled) > 1e12)).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


class Best:
    """The best k documents of each query so far, by rounded score, then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0)] * queries
        self.doc = [np.zeros(0, np.int64)] * queries

    def add(self, query: int, score: np.ndarray, doc: np.ndarray) -> None:
        if len(self.score[query]) == self.k:
            near = score >= self.score[query][-1] - 2e-9
            score, doc = score[near], doc[near]
        if len(score):
            score, doc = np.concatenate([self.score[query], rounded(score)]), np.concatenate([self.doc[query], doc])
            order = np.lexsort((doc, -score))[: self.k]
            self.score[query], self.doc[query] = score[order], doc[order]


def multiply(block: pa.RecordBatch, queries: list[np.ndarray], score, best: Best) -> None:
    """Scores of one block's documents for all queries; score(tokens, times, n) is what an asked term adds.  A document may hold a term in several places of its list."""
    ids, n, tokens, times = block.columns
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    doc, term, times = np.repeat(np.arange(len(ids)), lengths), tokens.flatten().to_numpy(), times.flatten().to_numpy()
    order = np.argsort(term, kind="stable")
    doc, term, times = doc[order], term[order], times[order]
    if not len(term):
        return
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))
    doc, term, times = doc[first], term[first], np.add.reduceat(times, first)
    value = score(term, times, n.to_numpy()[doc])
    most = int(term[-1])
    begins = np.searchsorted(term, np.arange(most + 2))
    ids = ids.to_numpy()
    for i, asked in enumerate(queries):
        parts = [slice(begins[t], begins[t + 1]) for t in asked[asked <= most].tolist()]
        row, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for p in parts:
            row[doc[p]] += value[p]  # a document stands once in a term's rows
            met[doc[p]] = True
        at = np.flatnonzero(met)
        if len(at):
            best.add(i, row[at], ids[at])


def best_documents(rows: DataFrame, queries: list[np.ndarray], weights: np.ndarray, average: float, k: int, k1: float, b: float) -> DataFrame:
    """(query, doc_id, score): what each task found best for each query, over rows (doc_id, n, tokens, times); weights: idf by token."""
    held = rows.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = held.value
        best = Best(len(asked), k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                multiply(batch.slice(at, BLOCK), asked, lambda t, tf, n: idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / average)), best)
        sizes = [len(s) for s in best.score]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(np.concatenate(best.doc)), pa.array(np.concatenate(best.score))], ["query", "doc_id", "score"])

    some = rows.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "tokens", "times")
    return some.mapInArrow(run, "query int, doc_id bigint, score double")


def idf_weights(frequency: pa.Table, words: int, n_docs: int, least: float) -> np.ndarray:
    """idf by token number, from (token, df)."""
    out = np.full(words, least)
    for token, df in zip(frequency["token"].to_pylist(), frequency["df"].to_pylist()):
        raw = math.log((n_docs - df + 0.5) / (df + 0.5))
        out[token] = raw if raw > 0 else least
    return out
