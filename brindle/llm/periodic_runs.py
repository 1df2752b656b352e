"""Periodic runs of words: stretches that repeat with a smallest period and that no neighbouring word extends.

A harmonic grid of queries finds them.  For a period p a run of ``power`` * p words or more
spans (power - 1) * p places x at which word x equals word x + p, so one of every (power - 1) * p places is
asked.  At a grid place the longest common extension forward from (x, x + p) and backward from (x - 1, x + p - 1) gives
the whole stretch.  Extensions come from a suffix array of the words and one of the words reversed: the least common prefix between two ranks
is a range minimum.  Periods ascend, so a stretch keeps the smallest it is found with.

Documents are laid end to end in batches of about ``batch_words`` words with a different end mark after each, and
words are numbered apart in each document, so no suffix reaches into another one.  Only documents with a grid
place where three neighbouring words agree with those a period on enter the suffix arrays: every place inside a run has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_runs

BLOCK = 16
_FAR = np.int32(2**31 - 1)
PAIRS = 1_000_000  # grid places asked at once


class Least:
    """Minima of any piece of an array: from both ends of blocks of 16, and by doubling over whole blocks."""

    def __init__(self, a: np.ndarray):
        grid = np.concatenate([a, np.full(-len(a) % BLOCK, _FAR, a.dtype)]).reshape(-1, BLOCK)
        self.a = a
        self.up = np.minimum.accumulate(grid, axis=1).ravel()
        self.down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.wide = [grid.min(axis=1)]
        while len(self.wide[-1]) > 1 << (len(self.wide) - 1):
            last, half = self.wide[-1], 1 << (len(self.wide) - 1)
            self.wide.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of a[lo..hi], both ends counted."""
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.down[lo], self.up[hi])
        many = last - first - 1
        level = np.frexp(many.astype(np.float64))[1] - 1
        for k in np.unique(level[many > 0]).tolist():
            some = np.flatnonzero((many > 0) & (level == k))
            both = np.minimum(self.wide[k][first[some] + 1], self.wide[k][last[some] - (1 << k)])
            out[some] = np.minimum(out[some], both)
        inside = np.flatnonzero(first == last)
        out[inside] = self.a[lo[inside]]
        for k in range(1, BLOCK):
            inside = inside[lo[inside] + k <= hi[inside]]
            if not len(inside):
                break
            out[inside] = np.minimum(out[inside], self.a[lo[inside] + k])
        return out


def _heads(size: int, new: np.ndarray) -> np.ndarray:
    """For each of size entries the first entry of its group; new marks where groups begin."""
    return np.maximum.accumulate(np.where(new, np.arange(size), 0))


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each suffix, common[r]: words that the suffixes of ranks r - 1 and r share).  The last word must stand nowhere else.

    Ranks are doubled: each round sorts only what is still tied by the rank of the rest.  Where it splits
    two neighbours, they share the depth so far and what the rests share, a range minimum over the splits of earlier rounds.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    common = np.where(new, np.int32(0), _FAR)
    rank = np.empty(n, np.int32)
    rank[order] = _heads(n, new)
    alone = new & np.concatenate([new[1:], [True]])
    tied, depth = np.flatnonzero(~alone), 1
    while len(tied):
        at = order[tied]
        group, rest = rank[at].astype(np.int64), rank[at + depth].astype(np.int64)
        place = np.argsort(group * n + rest, kind="stable")
        at, group, rest = at[place], group[place], rest[place]
        order[tied] = at
        new = np.ones(len(tied), bool)
        other = group[1:] != group[:-1]
        new[1:] = other | (rest[1:] != rest[:-1])
        split = np.flatnonzero(new[1:] & ~other) + 1
        if len(split):
            least = Least(common)
            common[tied[split]] = depth + least(rest[split - 1] + 1, rest[split])
        rank[at] = tied[_heads(len(tied), new)]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        depth *= 2
    return rank, common


class Extensions:
    """Longest common extensions of pairs of places."""

    def __init__(self, words: np.ndarray):
        self.rank, common = suffix_array(words)
        self.least = Least(common)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def _grid(sizes: np.ndarray, power: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place in it, places a run of the period spans at least), periods of a document ascending, in parts of about PAIRS; a period that alone has more is cut, too."""
    top = np.where(sizes >= least, sizes // power, 0)
    doc = np.repeat(np.arange(len(sizes)), top)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(top) - top, top) + 1
    step = np.maximum(least, power * period) - period
    count = np.maximum(0, sizes[doc] - period - 1) // step + 1
    ends = np.cumsum(count)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        number = np.arange(at, min(total, at + PAIRS))
        row = np.searchsorted(ends, number, "right")
        yield doc[row], period[row], (number - (ends[row] - count[row])) * step[row], step[row]
        at += PAIRS


def _agree(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether three neighbouring words at x, one of them x itself, equal those at y.  words has two marks at least on either side."""
    l2, l1, own, r1, r2 = (words[x + d] == words[y + d] for d in (-2, -1, 0, 1, 2))
    return own & ((l1 & (l2 | r1)) | (r1 & r2))


def runs_of(docs: list[np.ndarray], *, power: int = 4, least: int = 6) -> list[np.ndarray]:
    """Runs of documents (arrays of word numbers >= 0) as rows (start, length, period), by start, then period."""
    sizes = np.array([len(d) for d in docs], np.int64)
    flat, base = _laid_out(docs)
    live = np.zeros(len(docs), bool)
    short = least - 1 < 3 or power - 1 < 3  # then a run may span fewer than three places
    for doc, period, x, _ in _grid(sizes, power, least):
        at = base[doc] + x
        live[doc[_meets(flat, at, at + period, short)]] = True
    out = [np.zeros((0, 3), np.int64)] * len(docs)
    some = np.flatnonzero(live)
    if not len(some):
        return out
    flat, base = _laid_out([docs[i] for i in some.tolist()])
    forward, backward = Extensions(flat), Extensions(flat[::-1])
    found = []
    for doc, period, x, _ in _grid(sizes[some], power, least):
        at = base[doc] + x
        keep = np.flatnonzero(_meets(flat, at, at + period, short))
        doc, period, x, at = doc[keep], period[keep], x[keep], at[keep]
        ahead = forward(at, at + period)
        behind = backward(len(flat) - at, len(flat) - at - period)  # the mirror of place i is len - 1 - i
        length = ahead + behind + period
        good = length >= np.maximum(least, power * period)
        found.append(np.unique(np.stack([doc, x - behind, length, period], axis=1)[good], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by document, start, length, period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(some) + 1))
    for k, i in enumerate(some.tolist()):
        out[i] = rows[cuts[k] : cuts[k + 1], 1:]
    return out


def _meets(flat: np.ndarray, x: np.ndarray, y: np.ndarray, short: bool) -> np.ndarray:
    return flat[x] == flat[y] if short else _agree(flat, x, y)


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words, first place of each document): two different marks before each document and behind the last, words of different documents different."""
    sizes = np.array([len(d) for d in docs], np.int64)
    width = max([int(d.max()) for d in docs if len(d)], default=0) + 1
    parts, mark = [], len(docs) * width
    for k, d in enumerate(docs):
        parts += [np.array([mark + 2 * k, mark + 2 * k + 1]), d.astype(np.int64) + k * width]
    parts.append(np.array([mark + 2 * len(docs), mark + 2 * len(docs) + 1]))
    return np.concatenate(parts), np.cumsum(sizes + 2) - sizes


class _Numbers(dict):
    """word -> number."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """Words outside the repeats of every run's first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]).decode()


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", power: int = 4, least: int = 6, batch_words: int = 200_000) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row of docs.

    Words are maximal stretches without space, tab, line feed, vertical tab, form feed and carriage return.  runs lists
    (start, length, period) of every run of max(least, power * period) words or more, by start, then period; start counts words
    from 0, and period is the smallest.  collapsed is the text without what any run repeats of its first period,
    words joined by one space.  power is 2 or more, least 1 or more.

    Ids may be of any type, null too, and are carried along.  Null, empty and blank texts have no words, no runs and an empty collapsed text;
    repeated rows are judged each; an empty table gives no rows; extra columns are ignored.
    Nothing is shuffled.  A task holds one batch, or one text that is longer, at about 150 bytes a word.
    """
    if power < 2 or least < 1:
        raise ValueError("a run repeats its period at least once: power >= 2, least >= 1")
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_runs(batches, 1, 6 * batch_words):
            texts = [t.encode().split() if t else [] for t in part.column(1).to_pylist()]  # bytes.split() cuts at exactly these six blanks
            number = _Numbers()
            docs = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
            runs = runs_of(docs, power=power, least=least)
            flat = np.concatenate(runs)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            collapsed = [_collapsed(words, r) for words, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(ends, structs), pa.array(collapsed, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, f"`{id_col}` {kind.dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
