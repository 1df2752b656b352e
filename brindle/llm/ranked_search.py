"""Ranked lexical search: the product of an item-term matrix and a term-document matrix of integer impacts, block by block.

1. Every document is cut into terms once; its length and the counts of those terms that some item has are written to the shared
   folder.  Sizes and document frequencies are aggregated from that table.
2. A block of documents is one sparse matrix, a row for each term: documents and their impacts.  Row i of the product is
   merged after Gustavson, from the rows of item i's terms: each is scaled by the term's weight and multiplicity and added to
   one accumulator.  A task keeps each item's best documents over its blocks, and what they score is the floor for the next block.
3. The best of all tasks meet in two rounds, by item and a part of the tasks, then by item.

Items are taken in blocks of at most about ``block_chars`` characters, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, integer_ids, materialize, text_runs

#: a term is a run of ASCII letters and digits and of everything beyond ASCII; A-Z are lower-cased and all other ASCII is a blank
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class _Known(dict):
    """term -> number; -1 for all others."""

    def __missing__(self, term: bytes) -> int:
        return -1


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times) of documents with a term: how many they have, and the counts of those in the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(held.value)
        for part in text_runs(batches, 1, 2_000_000):
            words, counts = [], []
            for t in part.column(1).to_pylist():
                w = terms_of(t)
                words += w
                counts.append(len(w))
            n = np.array(counts, np.int64)
            number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            doc = np.repeat(np.arange(len(n)), n)[number >= 0]
            key, times = np.unique(doc * size + number[number >= 0], return_counts=True)
            filled = np.flatnonzero(n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(key // size, minlength=len(n))[filled])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % size, times)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(filled)), pa.array(n[filled]), *lists], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


def impacts(n: np.ndarray, times: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impacts of terms that stand so many times in documents of n terms; docs documents have total terms together."""
    lengths, back = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * docs * x // total for x in lengths.tolist()], np.int64)[back]  # the product may exceed 64 bits
    return 1_000_000_000 * times // (1000 * times + 20 * m)


class Best:
    """The top documents of each item so far, by score, then id; null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items

    def floor(self, item: int) -> int:
        """What a document must score to come in."""
        held = self.score[item]
        return int(held[-1]) if len(held) == self.top else 1

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score[item], score), (self.doc[item], doc), (self.null[item], null)))
        order = np.lexsort((doc, null, -score))[: self.top]
        self.score[item], self.doc[item], self.null[item] = score[order], doc[order], null[order]


def multiply(items: list[tuple[np.ndarray, np.ndarray]], doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int, best: Best, ids: np.ndarray, null: np.ndarray) -> None:
    """Rows of items (terms, factors) times one block's matrix (doc, term, value); every row's best documents go to best."""
    order = np.argsort(term, kind="stable")
    doc, term, value = doc[order], term[order], value[order]
    wanted = np.unique(np.concatenate([t for t, _ in items])) if items else term[:0]
    begin, end = (dict(zip(wanted.tolist(), np.searchsorted(term, wanted, side).tolist())) for side in ("left", "right"))
    row = np.zeros(docs, np.int64)
    for i, (terms, factors) in enumerate(items):
        row[:] = 0
        for t, f in zip(terms.tolist(), factors.tolist()):
            part = slice(begin[t], end[t])
            row[doc[part]] += f * value[part]  # a document stands once in a term's row
        at = np.flatnonzero(row >= best.floor(i))
        if len(at):
            best.add(i, row[at], ids[at], null[at])


def _blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """(ids, terms) of the items with terms, block by block."""
    source = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    size = source.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + size // block_chars
    for block in range(n):
        rows = source.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == block).toArrow()
        terms = [terms_of(t) for t in rows.column("t").to_pylist()]
        some = [k for k, w in enumerate(terms) if w]
        if some:
            yield rows.column("i").combine_chunks().take(pa.array(some)), [terms[k] for k in some]


def _search(docs: DataFrame, ids: pa.Array, words: list[list[bytes]], kind: str, *, id_col: str, text_col: str, top: int, once: bool, block_docs: int, parts: int) -> DataFrame:
    """Answers of one block of items."""
    vocabulary: dict[bytes, int] = {}
    matrix = []
    for w in words:
        t, times = np.unique(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w]), return_counts=True)
        matrix.append((t, np.ones(len(t), np.int64) if once else times))
    counted = materialize(count_terms(docs, vocabulary, id_col, text_col))
    sums = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, total = sums["docs"], sums["terms"] or 1
    frequency = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    weight = np.zeros(len(vocabulary), np.int64)
    weight[frequency.column("t").to_numpy()] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.column("df").to_pylist()]
    held = docs.sparkSession.sparkContext.broadcast([(t, m * weight[t]) for t, m in matrix])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        best = Best(len(rows), top)
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                block = batch.slice(at, block_docs)
                n = block.column(1).to_numpy()
                lists = block.column(2)
                doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
                times = block.column(3).flatten().to_numpy().astype(np.int64)
                null = np.array(block.column(0).is_null())
                multiply(rows, doc, lists.flatten().to_numpy(), impacts(n[doc], times, n_docs, total), len(n), best, block.column(0).fill_null(0).to_numpy(), null)
        full = [i for i in range(len(rows)) if len(best.score[i])]
        if full:
            item = np.repeat(np.array(full), [len(best.score[i]) for i in full])
            doc = pa.array(np.concatenate([best.doc[i] for i in full]), mask=np.concatenate([best.null[i] for i in full]))
            part = np.full(len(item), TaskContext.get().partitionId() % parts)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(part), doc, pa.array(np.concatenate([best.score[i] for i in full]))], ["item", "part", "doc_id", "score"])

    found = counted.mapInArrow(run, "item bigint, part bigint, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    done = materialize(ranked)
    discard(counted)
    names = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": ids}))
    return done.join(F.broadcast(names), "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 50, once: bool = True, block_chars: int = 8_000_000, block_docs: int = 8192, parts: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's top documents with a score above 0, the highest first, equal scores by ascending id.

    With N documents that have a term, L their terms, n those of one document, df the documents that hold a term and tf its
    occurrences in one, a term weighs floor(1000 * ln((2N + 2) / (2df + 1))) and its impact is
    1000000000 * tf div (1000 * tf + 20 * m), m being 50 + 50 * n * N div L.  A score sums weight times impact over the item's
    terms, each once, or with once=False as often as the item has it.

    Document ids must be integers; null ids rank last among equal scores.  Repeated documents are ranked each; every row of items is
    answered by itself, so a repeated item has its ranks twice.  Null, empty and blank texts have no terms: such documents count nowhere, such
    items get no rows, nor do any where a table is empty.  Extra columns are ignored.  Item ids may be of any type.
    """
    integer_ids(docs, id_col)
    kind = items.schema[item_col].dataType.simpleString()
    answers = [_search(docs, ids, words, kind, id_col=id_col, text_col=text_col, top=top, once=once, block_docs=block_docs, parts=parts) for ids, words in _blocks(items, item_col, item_text_col, block_chars)]
    return reduce(DataFrame.unionByName, answers) if answers else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
