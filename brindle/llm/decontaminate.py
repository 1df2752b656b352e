"""Benchmark decontamination with suffix arrays.

Each shard of the training text (documents of about ``shard_words`` words in a row) gets a
word-level suffix array over the suffixes whose first words are some benchmark item's;
suffixes are kept to the window's depth.  Every suffix of every test item is looked up in
it by binary search for its first and last match, which gives all verbatim matches and
their places; windows that continue one another chain into longest matches.

The benchmark is taken in blocks of at most ``block_words`` words.  A benchmark of one block is
broadcast once and the documents pass it where they are read.  For a larger one the documents are numbered
and written once, the blocks pass over them one after the other, each released before the next is
broadcast, and what they hit is put together by row number.  So what executors hold has a fixed bound, and rows come out alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import ASCII_LOWER, ascii_lower, fresh, integer_ids, materialize, tidied

#: a word is a run of ASCII letters and digits and of everything beyond ASCII
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


def _key(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Index:
    """The test suffixes of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        self.vocab: dict[str, int] = {}
        keys, lengths, owner, at = [], [], [], []
        pairs, alone = set(), []
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                keys.append(ids[i : i + size] + [0] * (window - size))
                lengths.append(size)
                owner.append(item)
                at.append(i)
                if size > 1:
                    pairs.add((ids[i], ids[i + 1]))
                else:
                    alone.append(ids[i])
        self.keys = np.array(keys, dtype=np.uint32).reshape(-1, window)
        self.lengths, self.owner, self.at = np.array(lengths, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(at, dtype=np.int64)
        self.base = np.int64(len(self.vocab) + 1)
        self.pairs = np.array(sorted(a * int(self.base) + b for a, b in pairs), dtype=np.int64)
        self.alone = np.zeros(int(self.base), bool)  # words that are items
        self.alone[alone] = True
        low = _key(self.keys) if len(keys) else np.array([], f"S{4 * window}")
        high = self.keys.copy()
        high[np.arange(window)[None, :] >= self.lengths[:, None]] = 0xFFFFFFFF
        self.low, self.high = low, _key(high) if len(keys) else low

    def matches(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, number of the test suffix) of every match.  flat: word numbers, 0 for words no item has and behind every document."""
        none = np.array([], dtype=np.int64)
        if len(flat) < 2 or not len(self.keys):
            return none, none
        begins = self.alone[flat[:-1]]
        if len(self.pairs):
            pair = flat[:-1].astype(np.int64) * self.base + flat[1:]
            found = np.searchsorted(self.pairs, pair)
            found[found == len(self.pairs)] = 0
            begins |= (self.pairs[found] == pair) & (flat[:-1] > 0) & (flat[1:] > 0)
        at = np.flatnonzero(begins)
        if not len(at):
            return none, none
        padded = np.concatenate([flat, np.zeros(self.window, dtype=flat.dtype)])
        suffixes = _key(padded[at[:, None] + np.arange(self.window)])
        order = np.argsort(suffixes, kind="stable")  # the shard's suffix array
        suffixes, at = suffixes[order], at[order]
        lo, hi = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        n = hi - lo
        test = np.repeat(np.arange(len(n)), n)
        start = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at[start], test


def _scan(ids: list, texts: list, index: Index):
    """Per document of a shard: id, words, hit words, matches as (item, doc word, item word, words)."""
    get = index.vocab.get
    docs, flat, first = [], [], []
    size = 0
    for doc_id, text in zip(ids, texts):
        words = words_of(text)
        docs.append((doc_id, len(words)))
        first.append(size)
        flat += [np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words)), np.zeros(1, np.uint32)]
        size += len(words) + 1
    starts = np.array(first, dtype=np.int64)
    at, test = index.matches(np.concatenate(flat)) if flat else (np.array([], np.int64), np.array([], np.int64))
    length, item, item_at = index.lengths[test], index.owner[test], index.at[test]
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    hit = np.cumsum(edge)[:-1] > 0
    order = np.lexsort((at, item, at - item_at, np.searchsorted(starts, at, "right")))
    at, length, item, item_at = at[order], length[order], item[order], item_at[order]
    doc = np.searchsorted(starts, at, "right") - 1
    longer = np.zeros(len(at), bool)
    if len(at) > 1:  # a window that begins where the one before moves on by one word continues it
        longer[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (item_at[1:] == item_at[:-1] + 1)
    begin = np.flatnonzero(~longer)
    end = np.concatenate([begin[1:], [len(at)]]) - 1 if len(begin) else begin
    spans = [[] for _ in docs]
    for b, e in zip(begin.tolist(), end.tolist()):
        spans[doc[b]].append((int(item[b]), int(at[b] - starts[doc[b]]), int(item_at[b]), int(at[e] + length[e] - at[b])))
    bounds = np.concatenate([starts, [size]]).tolist()
    for k, (doc_id, n) in enumerate(docs):
        yield doc_id, n, np.flatnonzero(hit[bounds[k] : bounds[k + 1]]) if spans[k] else [], spans[k]


def _shards(batches: Iterator[pa.RecordBatch], where: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about shard_words words (six bytes each) of their text column; one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(where).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + 6 * shard_words, "right")))
            yield batch.slice(at, end - at)
            at = end


class _Blocks:
    """The benchmark's items in blocks of about block_words words at most; a block is broadcast when asked for."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
        integer_ids(benchmark, item_col)
        self.items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
        size = self.items.agg(F.sum(F.length("t"))).first()[0] or 0
        self.n = 1 + size // (2 * block_words)  # a word and its gap take two characters at least

    def held(self, block: int):
        part = self.items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(self.n)) == block)
        return self.items.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in part.toLocalIterator()])


MATCHES = "array<struct<item_id:bigint,doc_word:int,item_word:int,n_words:int>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))


def _found(source: DataFrame, held, window: int, shard_words: int, only_hit: bool) -> DataFrame:
    """(first column, n_words, hits, matches) of source's rows (anything, text) in one block; only_hit: just the rows that it hits."""
    first = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, window)
        for part in _shards(batches, 1, shard_words):
            rows = list(_scan(range(part.num_rows), part.column(1).to_pylist(), index))
            if only_hit:
                rows = [r for r in rows if r[3]]
            ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([list(r[2]) for r in rows], pa.list_(pa.int32())), pa.array([[dict(zip(("item_id", "doc_word", "item_word", "n_words"), m)) for m in r[3]] for r in rows], _KIND)], [first.name, "n_words", "hits", "matches"])

    return source.mapInArrow(tidied(run), f"`{first.name}` {first.dataType.simpleString()}, n_words bigint, hits array<int>, matches {MATCHES}")


def _by_blocks(numbered: DataFrame, blocks: _Blocks, window: int, shard_words: int) -> DataFrame:
    """(row, hits, matches) of the rows that some block hits, put together; numbered: (row, text)."""
    every = None
    for block in range(blocks.n):
        held = blocks.held(block)
        part = materialize(_found(numbered, held, window, shard_words, True))
        held.destroy()
        every = part if every is None else every.unionByName(part)
    row = numbered.columns[0]
    return every.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000, shard_words: int = 200_000) -> DataFrame:
    """(id, n_words, hits, matches) for every row of docs.

    hits: sorted places of the words inside any occurrence of a window (window
    consecutive item words; an item of fewer, but not none, is one window).
    matches: longest verbatim matches as (item_id, doc_word, item_word,
    n_words).  Null and empty texts have no words; repeated rows, and rows with equal or null ids, are judged
    each, whatever the benchmark's size; an empty benchmark hits nothing; items with equal texts all match.
    Item ids must be integers; document ids may be of any type.  Extra columns are ignored.
    """
    blocks = _Blocks(benchmark, item_col, item_text_col, block_words)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if blocks.n == 1:
        return _found(source, blocks.held(0), window, shard_words, False).withColumnRenamed("doc_id", id_col)
    numbered = materialize(source.withColumn("row", F.monotonically_increasing_id()))
    hit = _by_blocks(numbered.select("row", "text"), blocks, window, shard_words)
    n_words = F.size(F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD.pattern), 0)).cast("long")
    counted = numbered.select("row", F.col("doc_id").alias(id_col), n_words.alias("n_words"))
    return counted.join(hit, "row", "left").select(id_col, "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000, shard_words: int = 200_000) -> DataFrame:
    """docs without the affected rows; all columns pass through.  With a benchmark of one block nothing is shuffled; with more, only the numbers of the rows hit are."""
    blocks = _Blocks(benchmark, item_col, item_text_col, block_words)
    where = docs.columns.index(text_col)
    if blocks.n > 1:
        row, gone = fresh(docs.columns, "row", "gone")
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
        hit = _by_blocks(numbered.select(row, text_col), blocks, window, shard_words).select(F.col(row).alias(gone))
        return numbered.join(hit, F.col(row) == F.col(gone), "left_anti").drop(row)
    held = blocks.held(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, window)
        for part in _shards(batches, where, shard_words):
            clean = [not spans for _, _, _, spans in _scan(range(part.num_rows), part.column(where).to_pylist(), index)]
            yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
