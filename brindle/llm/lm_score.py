"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token is predicted from the words on both sides of it, itself masked: the
hidden layer sums one learned vector per window place and word, and a
two-level softmax (class, then word in class; classes are wider for rarer words) gives the conditional
probability.  A document's score is the sum of its tokens' conditional log-probabilities.

The vocabulary comes from word counts over all documents: the words that occur
at least ``often`` times the square root of the number of tokens, so that it grows with
the corpus.  The network predicts one of ``buckets`` classes for any other word, and
the word within its class has the probability of its letters, from last to first, by a
model of four-letter windows counted over all rarer words of the corpus.  The network is trained in numpy by rounds of
parameter averaging: every partition takes the same start, runs stochastic gradient
steps on its own documents (a round takes every share-th place of a document, each from
another offset, so that all rounds together take every place), and the parameters are
averaged, weighted by the places seen, in a grouping by parameter block.  So what is gathered grows with the
input, and the driver holds one set of parameters whatever its size.  Since every partition trains on its own, scores
depend a little on how the documents are dealt to partitions.

Documents lie end to end in one stream of word numbers, with the edge's number between them; the words at
one distance from all places of a step are one gather.  Steps begin small and grow with the places seen, since a step costs
about the same for a few hundred places as for a few thousand.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, materialize, mix64

TOKEN = re.compile(r"\w+|[^\w\s]")
PLACES = (-3, -2, -1, 1, 2, 3)
FIRST_CLASS, END = 0xF0000, chr(0x10FFFF)  # signs that stand for classes and for the end of a word
EDGE = 0  # stands beyond both ends of a document
BLOCK = 4096  # parameters in one row while averaging
BATCH = (512, 8192)  # least and most places in a gradient step
REPEATS = 32  # occurrences of a word in a step that count in full towards its vectors
ROWS = 1024  # rows whose class scores are held at once, so that they stay in a core's cache
MOST = 16  # rows that totals adds one after the other
LIMIT = 60  # scores up to here need no shift ahead of exp


#: signs that stand alone: neither letters, digits and _ nor blanks
_ALONE = r"([^\pL\pN_\s\pZ\x0b\x1c-\x1f\x85])"


def tokens_of(text: str | None) -> list[str]:
    """The rule for one text."""
    return TOKEN.findall(text.lower()) if text else []


def strings_of(words: pa.Array) -> list[str]:
    """The same as to_pylist, without a scalar object for each value."""
    return words.to_numpy(zero_copy_only=False).tolist()


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same as cut_words, the words as strings of Python."""
    words, codes, n = cut_words(texts)
    return strings_of(words), codes, n


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, their numbers in order, tokens per text) of many texts, by the same rule in Arrow's kernels, which lower-case sign by sign."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), pattern=_ALONE, replacement=r" \1 ")
    parts = pc.utf8_split_whitespace(spaced)
    flat = parts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.diff(upto)


def class_of(word: str, buckets: int) -> int:
    """The number, from 1 on, of the class that stands for a word outside the vocabulary: a hash of its end and length class."""
    return 1 + zlib.crc32(f"{word[-2:]}{min(len(word) // 4, 3)}".encode()) % buckets


def letters_of(word: str, group: int) -> str:
    """A word from last to first letter, after three signs of its class and before a sign of its end."""
    return chr(FIRST_CLASS + group) * 3 + word[::-1] + END


class Spelling:
    """Probabilities of a word's letters given its class; windows: counts of four letters in a row.

    A letter's share after three letters is mixed with that after two, one and
    none, and at last with the same share for every code point, so all words sum to one in a class.
    """

    def __init__(self, windows: dict[str, int], weight: float = 2.0):
        self.weight = weight
        self.counts: Counter = Counter()
        self.totals: Counter = Counter()
        for w, n in windows.items():
            for k in range(4):
                self.counts[w[k:]] += n
                self.totals[w[k:3]] += n
        self.logs: dict[str, float] = {}

    def letter(self, window: str) -> float:
        p = 1 / 0x110000
        for k in range(3, -1, -1):
            p = (self.counts[window[k:]] + self.weight * p) / (self.totals[window[k:3]] + self.weight)
        return math.log(p)

    def __call__(self, word: str, group: int) -> float:
        s, total = letters_of(word, group), 0.0
        for i in range(len(s) - 3):
            w = s[i : i + 4]
            lp = self.logs.get(w)
            if lp is None:
                lp = self.logs[w] = self.letter(w)
            total += lp
        return total


def sign_windows(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all four signs in a row, windows per string)."""
    joined = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    if len(joined) < 4:
        return np.zeros(0, np.uint64), np.maximum(sizes - 3, 0)
    low, high = joined[:-3] | joined[1:-2] << np.uint64(32), joined[2:-1] | joined[3:] << np.uint64(32)
    inside = np.ones(len(joined), bool)
    ends = np.cumsum(sizes)
    for k in range(1, 4):
        inside[ends - k] = False
    return (mix64(low) + mix64(high ^ np.uint64(0x9E3779B97F4A7C15)))[inside[:-3]], sizes - 3


class Letters:
    """Log-probabilities of all windows of a corpus's rarer words, by hash: what tasks need of a Spelling."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        self.hashes, self.logs = hashes, logs

    @staticmethod
    def arrays(windows: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, log-probabilities): what Letters is made of, and all that is broadcast of it."""
        spelling = Spelling(windows)
        hashes, _ = sign_windows(list(windows))
        order = np.argsort(hashes)
        return hashes[order], np.array([spelling.letter(w) for w in windows])[order]

    def __call__(self, words: list[str], groups: np.ndarray) -> np.ndarray:
        """Log-probabilities of words in their classes."""
        if not words:
            return np.zeros(0)
        hashes, sizes = sign_windows([letters_of(w, g) for w, g in zip(words, groups.tolist())])
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        if not len(self.hashes) or (self.hashes[at] != hashes).any():
            raise ValueError("a word outside the vocabulary that was not counted")
        return np.add.reduceat(self.logs[at], np.cumsum(sizes) - sizes)


class Vocabulary:
    """Frequent words by falling count from number 1 + buckets on; others by their class, and spelt for the rest of their probability."""

    def __init__(self, words: list[str], buckets: int, letters: Letters):
        self.buckets, self.letters = buckets, letters
        self.classes: dict[tuple[str, int], int] = {}  # by all that class_of reads of a word
        self.ids = {w: 1 + buckets + i for i, w in enumerate(words)}
        self.size = 1 + buckets + len(words)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, and the log-probability of the rarer ones within their classes, 0 for the others."""
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        rare = np.flatnonzero(ids < 0)
        some = [words[i] for i in rare.tolist()]
        ids[rare] = np.array([self.class_at(w) for w in some], dtype=np.int64)
        spelt = np.zeros(len(words))
        spelt[rare] = self.letters(some, ids[rare])
        return ids, spelt

    def class_at(self, word: str) -> int:
        key = word[-2:], min(len(word) // 4, 3)
        group = self.classes.get(key)
        if group is None:
            group = self.classes[key] = class_of(word, self.buckets)
        return group


def width_of(size: int) -> str:
    """Type of word numbers at rest."""
    return "<u2" if size <= 1 << 16 else "<u4"


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents, summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([table["word"].combine_chunks(), table["n_sum"].combine_chunks()], ["word", "n"])

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                words, codes, _ = cut_words(batch.column(0).slice(at, 2048))
                held.append(pa.table({"word": words.cast(pa.string()), "n": pa.array(np.bincount(codes, minlength=len(words)), pa.int64())}))
                rows += len(words)
                if rows > 1_000_000:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return docs.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def choose_words(counts: DataFrame, words: int, often: float) -> tuple[list[str], DataFrame]:
    """The vocabulary, by falling count, and (word, n) of the rarer words.  words is the least number of words taken, if there are so many."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = counts.filter(F.col("n") >= often * math.sqrt(total)).count()
    taken = counts.orderBy(F.desc("n"), "word").limit(max(words, many)).collect()
    if not taken:
        return [], counts
    last = taken[-1]
    return [r["word"] for r in taken], counts.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))


def count_windows(rarer: DataFrame, buckets: int) -> dict[str, int]:
    """Counts of four letters in a row over all occurrences of the rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["window", "n"])

        counts: dict[str, int] = {}
        for batch in batches:
            for word, n in zip(strings_of(batch.column(0)), batch.column(1).to_pylist()):
                s = letters_of(word, class_of(word, buckets))
                for i in range(len(s) - 3):
                    w = s[i : i + 4]
                    counts[w] = counts.get(w, 0) + n
            if len(counts) > 500_000:
                yield out(counts)
                counts = {}
        if counts:
            yield out(counts)

    found = rarer.select("word", "n").mapInArrow(run, "window string, n bigint").groupBy("window").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found["window"].to_pylist(), found["n"].to_pylist()))


class Network:
    """size words in classes; hidden units; parameters in one flat array.

    Words are numbered by falling frequency, and class k begins at word k * k * spread: classes grow with the square root of
    the rank, which keeps both the number of classes and the expected size of a word's class small where counts fall as ranks rise.
    """

    def __init__(self, size: int, hidden: int, flat: np.ndarray | None = None):
        self.size, self.hidden = size, hidden
        self.spread = max(1.0, math.log(size + 1) / 4)
        self.classes = int(math.sqrt((size - 1) / self.spread)) + 1 if size else 0
        self.begins = np.ceil(np.arange(self.classes + 1) ** 2 * self.spread).astype(np.int64)
        self.begins[-1] = size
        shapes = [(size, len(PLACES), hidden), (hidden,), (self.classes, hidden + 1), (size, hidden + 1)]
        self.n = sum(int(np.prod(s)) for s in shapes)
        self.flat, at = np.empty(self.n, np.float32) if flat is None else flat, 0
        views = []
        for s in shapes:
            k = int(np.prod(s))
            views.append(self.flat[at : at + k].reshape(s))
            at += k
        self.vectors, self.b, self.of_classes, self.of_words = views
        self.embed = self.vectors.transpose(1, 0, 2)  # by place and word
        (self.wc, self.bc), (self.ww, self.bw) = ((v[:, :hidden], v[:, hidden]) for v in (self.of_classes, self.of_words))
        if flat is None:
            rng = np.random.default_rng(7)
            for view in (self.embed, self.b, self.wc, self.bc, self.ww, self.bw):
                view[:] = rng.standard_normal(view.shape) * 0.05
        self.ones = np.ones(max(size, hidden + 1), np.float32)

    def class_at(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, words, "right") - 1

    def small(self, w: np.ndarray) -> bool:
        """Whether no score can be too large for exp; hidden units are within -1 and 1."""
        return (np.abs(w) @ self.ones[: w.shape[1]]).max(initial=0) <= LIMIT

    @staticmethod
    def weigh(h: np.ndarray, w: np.ndarray, small: bool) -> np.ndarray:
        """Scores of rows of hidden units, small enough for exp."""
        z = h @ w.T
        if not small:
            z -= z.max(axis=1, keepdims=True)
        return z

    def hidden_at(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hidden units for the places at of a stream of word numbers, and a 1 for the bias."""
        vectors, places = self.vectors.reshape(-1, self.hidden), len(PLACES)
        out = np.empty((len(at), self.hidden + 1), np.float32)
        out[:, -1] = 1
        for f in range(0, len(at), ROWS):
            some = at[f : f + ROWS]
            h = np.take(vectors, stream[some + PLACES[0]].astype(np.int64) * places, axis=0)
            for k in range(1, places):
                h += np.take(vectors, stream[some + PLACES[k]].astype(np.int64) * places + k, axis=0)
            h += self.b
            out[f : f + ROWS, :-1] = np.tanh(h, out=h)
        return out

    def hidden_of(self, context: np.ndarray) -> np.ndarray:
        h = np.repeat(self.b[None, :], len(context), axis=0)
        for k in range(len(PLACES)):
            h += self.embed[k][context[:, k]]
        return np.concatenate([np.tanh(h), np.ones((len(h), 1), np.float32)], axis=1)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, out = np.argsort(target, kind="stable"), np.empty(len(target))
        out[order] = self.of_hidden(self.hidden_of(context[order]), target[order])
        return out

    def log_probability_at(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of the words at the places at of a stream of word numbers."""
        order, out = np.argsort(stream[at], kind="stable"), np.empty(len(at))
        some = at[order]
        out[order] = self.of_hidden(self.hidden_at(stream, some), stream[some].astype(np.int64))
        return out

    def of_hidden(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of rising targets: of their class, and in their class."""
        if not len(target):
            return np.zeros(0, np.float32)
        c = self.class_at(target)
        lp, numbers = np.empty(len(c), np.float32), np.arange(ROWS)

        def one_of(z, own):
            mine = z[numbers[: len(z)], own]
            return mine - np.log(np.exp(z, out=z) @ self.ones[: z.shape[1]])

        small = self.small(self.of_classes)
        for f in range(0, len(c), ROWS):
            lp[f : f + ROWS] = one_of(self.weigh(h[f : f + ROWS], self.of_classes, small), c[f : f + ROWS])
        small = self.small(self.of_words)
        for f, e, k in self.groups(c):
            first, last = self.begins[k], self.begins[k + 1]
            for g in range(f, e, ROWS):
                d = min(e, g + ROWS)
                lp[g:d] += one_of(self.weigh(h[g:d], self.of_words[first:last], small), target[g:d] - first)
        return lp

    @staticmethod
    def groups(c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first, end, class) of the stretches of one class."""
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(c) > 0, [True]])).tolist()
        return zip(cuts[:-1], cuts[1:], c[cuts[:-1]].tolist())

    def step(self, stream: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One gradient step on the places at of a stream of word numbers."""
        n = len(at)
        at = at[np.argsort(stream[at], kind="stable")]
        target = stream[at].astype(np.int64)
        h = self.hidden_at(stream, at)
        c = self.class_at(target)
        dh, numbers = np.empty_like(h), np.arange(n)

        def missed(own, w, small, hit):
            """Probabilities less those wished for."""
            p = self.weigh(own, w, small)
            np.exp(p, out=p)
            p *= np.reciprocal(p @ self.ones[: p.shape[1]])[:, None]
            p[numbers[: len(p)], hit] -= 1
            return p

        small, change = self.small(self.of_classes), np.zeros_like(self.of_classes)
        for f in range(0, n, ROWS):
            own = h[f : f + ROWS]
            p = missed(own, self.of_classes, small, c[f : f + ROWS])
            np.matmul(p, self.of_classes, out=dh[f : f + ROWS])
            change += p.T @ own
        change *= np.float32(rate / n)
        self.of_classes -= change
        small = self.small(self.of_words)
        for f, e, k in self.groups(c):
            first, own, w = self.begins[k], h[f:e], self.of_words[self.begins[k] : self.begins[k + 1]]
            p = missed(own, w, small, target[f:e] - first)
            dh[f:e] += p @ w
            change = p.T @ own
            change *= np.float32(rate / (e - f))
            w -= change
        h *= h
        dh *= np.subtract(1, h, out=h)
        dh *= np.float32(rate * 0.05)
        self.b -= (np.ones(n, np.float32) @ dh)[:-1] / np.float32(n)
        places = len(PLACES)
        words = np.stack([stream[at + p] for p in PLACES])
        order = np.argsort(words, axis=1, kind="stable")
        words = words.ravel()[(order + np.arange(places)[:, None] * n).ravel()]
        heads = np.concatenate([[True], words[1:] != words[:-1]])
        heads[::n] = True
        starts = np.flatnonzero(heads)
        times = np.diff(starts, append=len(words))
        sums = totals(dh[:, :-1].copy(), order.ravel(), starts, times)
        sums *= np.minimum(1, REPEATS / times).astype(np.float32)[:, None]
        hit = words[starts].astype(np.int64) * places + starts // n
        vectors = self.vectors.reshape(-1, self.hidden)
        vectors[hit] = np.take(vectors, hit, axis=0) - sums


def totals(rows: np.ndarray, source: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of rows[source[s : s + t]] for each start s and its number t, at least 1.

    The j-th rows of all sums are added at once, for j below MOST; what is longer is cut in pieces, whose sums are summed likewise.
    """
    pieces = (times + (MOST - 1)) // MOST
    if not len(times) or int(pieces.max()) == 1:
        return short_totals(rows, source, starts, times)
    first = np.cumsum(pieces) - pieces
    skipped = (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * MOST
    parts = short_totals(rows, source, np.repeat(starts, pieces) + skipped, np.minimum(MOST, np.repeat(times, pieces) - skipped))
    out, many = np.take(parts, first, axis=0), np.flatnonzero(pieces > 1)
    out[many] = totals(parts, np.arange(len(parts)), first[many], pieces[many])
    return out


def short_totals(rows: np.ndarray, source: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The same for numbers from 1 to MOST."""
    order = np.argsort((MOST - times).astype(np.uint8), kind="stable")
    starts = starts[order]
    as_many = np.cumsum(np.bincount(times, minlength=MOST + 1)[::-1])[::-1].tolist()  # sums of at least so many rows
    sums = np.take(rows, source[starts], axis=0)
    for j in range(1, MOST):
        k = as_many[j + 1]
        if not k:
            break
        sums[:k] += np.take(rows, source[starts[:k] + j], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def lay_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(stream, first places): documents of word numbers end to end, with the edge between and around them."""
    reach = max(PLACES)
    edge = np.full(reach, EDGE, docs[0].dtype if docs else np.int64)
    parts = [edge]
    for d in docs:
        parts += [d, edge]
    sizes = np.array([len(d) + reach for d in docs], dtype=np.int64)
    return np.concatenate(parts), reach + np.cumsum(sizes) - sizes


def contexts(ids: np.ndarray) -> np.ndarray:
    reach = max(PLACES)
    padded = np.concatenate([np.full(reach, EDGE), ids, np.full(reach, EDGE)])
    return np.stack([padded[reach + p : reach + p + len(ids)] for p in PLACES], axis=1)


def encode_docs(docs: DataFrame, vocab: list[str], windows: dict[str, int], buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(id, ids, spelt): word numbers of every whole text, as little-endian integers, and the log-probability of rarer words within their classes."""
    held = docs.sparkSession.sparkContext.broadcast((vocab, *Letters.arrays(windows)))
    source = docs.select(id_col, text_col)
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(held.value[0], buckets, Letters(*held.value[1:]))
        kind = np.dtype(width_of(vocabulary.size))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words, codes, n = cut(part.column(1))
                ids, spelt = vocabulary(words)
                raw, ends = ids.astype(kind)[codes].tobytes(), np.cumsum(n)
                total = np.concatenate([[0.0], np.cumsum(spelt[codes])])
                cuts = (ends * kind.itemsize).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[f:e] for f, e in zip([0, *cuts], cuts)], pa.binary()), pa.array(total[ends] - total[ends - n])], ["id", "ids", "spelt"])

    return materialize(source.mapInArrow(run, f"id {id_type}, ids binary, spelt double"))


def places_of(n: int, round_no: int, share: int) -> np.ndarray:
    """The places of a document of n tokens that a round trains on: share rounds in a row take each place once."""
    return np.arange((n * 7 + round_no) % share, n, share)


def average_round(encoded: DataFrame, size: int, hidden: int, flat: np.ndarray, *, round_no: int, share: int, rate: float) -> np.ndarray:
    """One round: local steps in every partition, then the weighted mean of the parameters."""
    held = encoded.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(size, hidden, held.value.copy())
        kind, seen = width_of(size), 0

        def learn(docs):
            stream, firsts = lay_out(docs)
            at = np.concatenate([f + places_of(len(d), round_no, share) for f, d in zip(firsts.tolist(), docs)])
            for some in np.array_split(at, max(1, round(len(at) / most_places()))):
                net.step(stream, some, rate)
            return len(at)

        def most_places():
            return min(BATCH[1], max(BATCH[0], seen // 4))

        held_docs, waiting = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                n = len(places_of(len(ids), round_no, share))
                if n:
                    held_docs.append(ids)
                    waiting += n
                if waiting >= 4 * most_places():
                    seen += learn(held_docs)
                    held_docs, waiting = [], 0
        if waiting:
            seen += learn(held_docs)
        if not seen:
            return
        starts = range(0, net.n, BLOCK)
        parts = [net.flat[i : i + BLOCK] * np.float32(seen) for i in starts]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "seen", "part"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, seen, part in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(part, np.float32).astype(np.float64)
                if block in sums:
                    sums[block][0] += seen
                    sums[block][1] += values
                else:
                    sums[block] = [seen, values]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()]), pa.array([s[1].astype(np.float32).tobytes() for s in sums.values()], pa.binary())], ["block", "seen", "part"])

    shape = "block int, seen double, part binary"
    most = 8 * encoded.sparkSession.sparkContext.defaultParallelism  # parameters travel once a task
    trained = encoded.select("ids").coalesce(most).mapInArrow(run, shape).repartition("block").mapInArrow(mean, shape)
    rows = sorted(trained.collect())
    return np.concatenate([np.frombuffer(r["part"], np.float32) / np.float32(r["seen"]) for r in rows]) if rows else flat


@contextmanager
def one_thread(spark: SparkSession) -> Iterator[None]:
    """Functions that are sent off meanwhile use one thread for matrix products: a task has one core, and more threads only wait for each other."""
    env, name = spark.sparkContext.environment, "OPENBLAS_NUM_THREADS"
    before = env.get(name)
    env.setdefault(name, "1")
    try:
        yield
    finally:
        if before is None:
            env.pop(name, None)


def lm_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 1500, often: float = 0.1, buckets: int = 64, hidden: int = 24, rounds: int = 2, share: int = 2, rate: float = 0.7) -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_likelihood) for every document.

    Null, empty and blank texts have no tokens, a sum of 0 and no mean.
    Repeated rows and rows with null ids are scored each, equal texts (ties) alike up to rounding; an empty table gives no
    rows; extra columns are ignored.  Sums run over
    every token of the whole text, however long, and the network is trained on every place.
    The vocabulary is all words with at least often * sqrt(tokens) occurrences, and no fewer than words.
    """
    if rounds % share:
        raise ValueError("rounds must be a multiple of share, so that every place is trained on equally often")
    with one_thread(docs.sparkSession):
        return _scored(docs, id_col, text_col, words, often, buckets, hidden, rounds, share, rate)


def _scored(docs: DataFrame, id_col: str, text_col: str, words: int, often: float, buckets: int, hidden: int, rounds: int, share: int, rate: float) -> DataFrame:
    spark = docs.sparkSession
    counts = materialize(count_words(docs, text_col))
    vocab, rarer = choose_words(counts, words, often)
    windows = count_windows(rarer, buckets)
    discard(counts)
    size = 1 + buckets + len(vocab)
    encoded = encode_docs(docs, vocab, windows, buckets, id_col, text_col)
    flat = Network(size, hidden).flat
    for r in range(rounds):
        flat = average_round(encoded, size, hidden, flat, round_no=r, share=share, rate=rate / (1 + r))
    held = spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(size, hidden, held.value.copy())
        kind = width_of(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(b, kind) for b in part.column(1).to_pylist()]
                n = np.array([len(i) for i in ids])
                stream, firsts = lay_out(ids)
                places = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())
                lp = np.zeros(len(places))
                for f in range(0, len(lp), 65_536):
                    lp[f : f + 65_536] = net.log_probability_at(stream, places[f : f + 65_536])
                total, ends = np.concatenate([[0.0], np.cumsum(lp)]), np.cumsum(n)
                sums = total[ends] - total[ends - n] + part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sums), pa.array([s / k if k else None for s, k in zip(sums.tolist(), n.tolist())], pa.float64())], ["id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    id_type = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"id {id_type}, n_tokens bigint, log_likelihood double, mean_log_likelihood double").withColumnRenamed("id", id_col)
