"""Repeated-substring removal with longest-previous-factor arrays.

A byte goes when a span-byte string that covers it also starts earlier in the
corpus (smaller id, or same document and earlier start).  The corpus is too
large for one suffix array, so suffixes are dealt to buckets in which equal
span-byte prefixes meet:

1. Every span-byte window elects an anchor, its gram of the least hash (a
   minimizer).  Equal windows elect equal anchors at equal places, so windows
   need comparing only within an anchor's bucket.  Consecutive windows with one
   anchor travel as one row with a 128-bit hash (XXH3) of the bytes that they cover.
2. A bucket holds each different covering text once, at its first place; rows with an equal
   hash are that text at later places, where every window is a later copy.  Buckets with one
   covering text have nothing else to compare.
3. For the others the covered bytes are fetched.  Their suffix array is built by prefix doubling, the common
   prefixes of neighbours in it by lifting over the doubled ranks, and the previous and next smaller positions
   (the nearest suffixes on both sides in suffix order that start earlier in the corpus) by pointer jumping.  A suffix's
   longest previous factor is the longer of the common prefixes with these two; a window whose factor
   is span bytes long is removed.  Lengths are counted up to span, and below it in steps of five bytes, which is all the rule asks.
4. Buckets with more than ``hot`` covering texts are dealt once more, each window by its own hash, after the
   longest previous factors within each batch of texts have removed what they can; then as in 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hash_strings, materialize, mix64, placed
from .ngram_join import _bounded_runs, _runs

GRAM = 24
_MULT = 0x9E3779B97F4A7C15
_BACK = pow(_MULT, -1, 1 << 64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
CHUNK = 2_000_000  # bytes hashed at once


class Roller:
    """Hashes of any piece of a byte array, by prefix sums."""

    powers = back = None

    def __init__(self, data: np.ndarray):
        n = len(data)
        if Roller.powers is None or len(Roller.powers) <= n:
            size = max(n + 1, 1 << 16)
            Roller.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _MULT, np.uint64)]), dtype=np.uint64)
            Roller.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BACK, np.uint64)]), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * Roller.powers[:n], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        return mix64((self.sums[width:] - self.sums[:-width]) * Roller.back[: len(self.sums) - width])


def anchors(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, windows) of documents laid end to end; a row for each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    width = span - GRAM + 1
    if len(data) < span:
        return none, none, none
    roll = Roller(data)
    grams = roll.all(GRAM)
    place = np.uint64((1 << 24) - 1)
    low = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = np.arange(len(low))
    valid = np.ones(len(low), bool)
    for e in ends[:-1].tolist():  # windows that would cross into the next document
        valid[max(0, e - span + 1) : e] = False
    at = at[valid]
    if not len(at):
        return none, none, none
    anchor = (low[valid] & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    s0, s1 = at[first], at[last]
    return grams[anchor[first]].view(np.int64), s0, s1 - s0 + 1


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of pieces, as two columns of 64 bits."""
    import xxhash

    held, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(held[s:e]) for s, e in zip(start.tolist(), end.tolist())]), np.int64).reshape(-1, 2)


def merge(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans, per document; touching spans join."""
    if not len(start):
        return start, end, doc
    order = np.lexsort((start, doc))
    start, end, doc = start[order], end[order], doc[order]
    new = np.ones(len(start), bool)
    _, number = np.unique(doc, return_inverse=True)
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + number * far)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] + number[1:] * far > reach[:-1])
    first = np.flatnonzero(new)
    top = reach[np.concatenate([first[1:], [len(start)]]) - 1] - number[first] * far
    return start[first], top, doc[first]


def _slices(ids: list, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document ends, document numbers, places of the parts in their documents) in pieces of about CHUNK bytes.  Longer documents come in parts that overlap by one window less a byte."""
    parts, size = [], 0

    def out():
        ends = np.cumsum([len(p[1]) for p in parts])
        return np.frombuffer(b"".join(p[1] for p in parts), np.uint8), ends, np.array([p[0] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)

    for doc, text in zip(ids, texts):
        data = (text or "").encode()
        at = 0
        while True:
            piece = data[at : at + CHUNK]
            if parts and size + len(piece) > CHUNK:
                yield out()
                parts, size = [], 0
            parts.append((doc, piece, at))
            size += len(piece)
            if at + CHUNK >= len(data):
                break
            at += CHUNK - 99 if len(data) > CHUNK else CHUNK
    if parts:
        yield out()


_ROW = ("key", "cover", "more", "doc", "start", "meta")


def anchor_rows(docs: DataFrame, span: int) -> DataFrame:
    """(key, cover, more, doc, start, meta) of docs (doc, text); cover and more are the hash.  meta > 0: windows in a row; meta < 0: a settled span of -meta bytes."""
    if span != 100:
        raise ValueError("parts of long documents overlap by 99 bytes: span must be 100")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = [[], [], [], [], [], []]
                for data, ends, ids, shift in _slices(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    key, s0, n = anchors(data, ends, span)
                    if len(key):
                        number = np.searchsorted(ends, s0, "right")
                        base = np.concatenate([[0], ends[:-1]])[number]
                        both = digests(data, s0, s0 + n + span - 1)
                        for k, x in enumerate((key, both[:, 0], both[:, 1], ids[number], s0 - base + shift[number], n)):
                            rows[k].append(x)
                if not rows[0]:
                    continue
                key, cover, more, doc, start, meta = (np.concatenate(x) for x in rows)
                order = np.lexsort((start, doc, cover))
                again = np.zeros(len(order), bool)
                again[1:] = (cover[order[1:]] == cover[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
                kept, later = order[~again], order[again]
                s, e, d = merge(start[later], start[later] + meta[later] + span - 1, doc[later])
                none = np.zeros(len(d), np.int64)
                spread = mix64(d.view(np.uint64) + np.uint64(1)).view(np.int64) ^ s  # settled spans go anywhere
                cols = (np.concatenate([x, y]) for x, y in ((key[kept], spread), (cover[kept], none), (more[kept], none), (doc[kept], d), (start[kept], s), (meta[kept], s - e)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], _ROW)

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in _ROW))


def settle_buckets(rows: DataFrame, span: int, hot: int, most: int = 1_000_000) -> DataFrame:
    """(key, doc, start, meta): settled spans (meta < 0), and the rows whose covered bytes must be compared; theirs is a key of 0 in hot buckets.

    A bucket of over ``most`` rows is hot whatever it holds, and passes through in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, (key, cover, more, doc, start, meta) in _bounded_runs(batches, most):
            ready = meta < 0
            k, c, m2, d, s, m = (x[~ready] for x in (key, cover, more, doc, start, meta))
            order = np.lexsort((s, d, c, k))
            k, c, m2, d, s, m = k[order], c[order], m2[order], d[order], s[order], m[order]
            later = np.zeros(len(k), bool)
            later[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1]) & (m2[1:] == m2[:-1])
            fk, fd, fs, fm = k[~later], d[~later], s[~later], m[~later]
            heads = np.flatnonzero(np.concatenate([[True], fk[1:] != fk[:-1]])) if len(fk) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([heads, [len(fk)]]))
            many = np.repeat(size, size)
            check = (many > 1) | cut
            ck = np.where((many[check] > hot) | cut, 0, fk[check])
            ss, se, sd = merge(np.concatenate([s[later], start[ready]]), np.concatenate([s[later] + m[later] + span - 1, start[ready] - meta[ready]]), np.concatenate([d[later], doc[ready]]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.concatenate([ck, np.ones(len(ss), np.int64)]), np.concatenate([fd[check], sd]), np.concatenate([fs[check], ss]), np.concatenate([fm[check], ss - se]))], ["key", "doc", "start", "meta"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, doc bigint, start bigint, meta bigint")


def _ranks(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of keys of so many bits.  Where key and place fit in 64 bits they are sorted as one number, which is several times as fast as sorting places by key."""
    n = len(keys)
    low = max(1, n.bit_length())
    if bits + low <= 64:
        packed = keys.astype(np.uint64) << np.uint64(low) | np.arange(n, dtype=np.uint64)
        packed.sort()
        place, keys = (packed & np.uint64((1 << low) - 1)).view(np.int64), packed >> np.uint64(low)
    else:
        place = np.argsort(keys)
        keys = keys[place]
    new = np.zeros(n, np.int32)
    new[1:] = keys[1:] != keys[:-1]
    out = np.empty(n, np.int32)
    out[place] = np.cumsum(new, dtype=np.int32)
    return out


def _paired(left: np.ndarray, right: np.ndarray, many: int) -> np.ndarray:
    """Ranks of pairs of ranks below many."""
    width = max(1, many.bit_length())
    return _ranks(left.astype(np.uint64) << np.uint64(width) | right.astype(np.uint64), 2 * width)


def suffix_array(data: np.ndarray, starts: np.ndarray, order: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in starts by their suffixes' first span bytes, then by order; common prefix with the one before: span, or less in steps of five).

    Every start has span bytes left.  Ranks are doubled from five bytes on; the common prefix of two neighbours adds up the
    widths, from the widest down, at which their ranks agree.
    """
    padded = np.concatenate([data, np.zeros(5, np.uint8)])
    first = np.zeros(len(data), np.uint64)
    for k in range(5):
        first = (first << np.uint64(8)) | padded[k : k + len(data)]
    ranks = [(5, _ranks(first, 40))]
    while ranks[-1][0] * 2 <= span:
        depth, rank = ranks[-1]
        ranks.append((depth * 2, _paired(rank[:-depth], rank[depth:], len(data))))
    depth, rank = ranks[-1]
    deep = rank[starts] if depth == span else _paired(rank[starts], rank[starts + span - depth], len(data))
    by_order = np.empty(len(starts), np.int64)
    by_order[order] = np.arange(len(starts))
    line = by_order[np.argsort(deep[by_order], kind="stable")]
    common = np.zeros(len(line), np.int64)
    if len(line) > 1:
        same = deep[line[1:]] == deep[line[:-1]]
        common[1:][same] = span
        part = np.flatnonzero(~same) + 1
        a, b, n = starts[line[part - 1]], starts[line[part]], np.zeros(len(part), np.int64)
        for depth, rank in reversed(ranks):
            some = np.flatnonzero(n + depth <= span)
            at = n[some]
            n[some] = at + depth * (rank[a[some] + at] == rank[b[some] + at])
        common[part] = n
    return line, common


def previous_smaller(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest entry before it of a smaller place (-1: none), and the least of common on the way; common[i] lies between i - 1 and i.

    All entries jump at once: whoever meets a greater place goes on to where that one has got.  Between an entry and where it stands all places are greater.
    """
    at, least = np.arange(-1, len(place) - 1), common.copy()
    least[:1] = 0
    going = np.arange(len(place))
    while len(going):
        going = going[(at[going] >= 0) & (least[going] > 0)]
        going = going[place[at[going]] > place[going]]
        via = at[going]
        at[going], least[going] = at[via], np.minimum(least[going], least[via])
    return np.where(least > 0, at, -1), least


def longest_previous(data: np.ndarray, starts: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Lengths of the longest previous factors of the suffixes at starts, the longest prefix that also starts at a place of a lower order: span, or less in steps of five."""
    line, common = suffix_array(data, starts, order, span)
    place = order[line]
    _, before = previous_smaller(place, common)
    turned = np.concatenate([common[:1] * 0, common[1:][::-1]])
    _, behind = previous_smaller(place[::-1], turned)
    out = np.empty(len(line), np.int64)
    out[line] = np.maximum(before, behind[::-1])
    return out


def _windows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, held: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """(row, place in its document, place in the joined bytes, longest previous factor) of every window of the covering texts."""
    sizes = n + span - 1
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where = start[row] + inner
    order = np.empty(len(row), np.int64)
    order[np.lexsort((where, doc[row]))] = np.arange(len(row))
    data = np.frombuffer(b"".join(held), np.uint8)
    return row, where, base[row] + inner, longest_previous(data, base[row] + inner, order, span)


_TEXTS = "key bigint, doc bigint, start bigint, n bigint, held binary"


def _groups(key: np.ndarray, most: int) -> Iterator[slice]:
    """Rows sorted by key in groups of about most, none of which cuts a key's rows."""
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)][: len(key)]])
    at = 0
    while at < len(cuts) - 1:
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1)
        yield slice(cuts[at], cuts[end])
        at = end


def _compare(texts: DataFrame, span: int, most: int = 2000) -> DataFrame:
    """(doc, start, end) of the removed windows of rows (key, doc, start, n, bytes); rows of n < 0 are settled spans of -n bytes, which pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((cols[0], cols[1:]) for cols in _runs(batches, 1))
        for doc, start, n, held in ([c[some] for c in cols] for key, cols in every for some in _groups(key, most)):
            ready = n < 0
            row, where, _, factor = _windows(doc[~ready], start[~ready], n[~ready], held[~ready].tolist(), span)
            gone = factor >= span
            own = doc[~ready][row][gone]
            s, e, d = merge(np.concatenate([where[gone], start[ready]]), np.concatenate([where[gone] + span, (start - n)[ready]]), np.concatenate([own, doc[ready]]))
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["doc", "start", "end"])

    return texts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc bigint, start bigint, end bigint")


def _by_window(texts: DataFrame, span: int, size: int = 256) -> DataFrame:
    """Rows of hot buckets dealt anew: (key, doc, start, n, held), a row for each window that nothing in its batch of texts precedes, under its own hash; n < 0: a settled span of -n bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in range(0, batch.num_rows, size):
                doc, start, n, held = (c.to_numpy(zero_copy_only=False) for c in batch.slice(f, size).columns[1:])
                row, where, at, factor = _windows(doc, start, n, held.tolist(), span)
                gone = factor >= span
                s, e, d = merge(where[gone], where[gone] + span, doc[row][gone])
                data = b"".join(held.tolist())
                left = [data[i : i + span] for i in at[~gone].tolist()]
                key = hash_strings(left).view(np.int64)
                spread = mix64(d.view(np.uint64) + np.uint64(1)).view(np.int64) ^ s
                cols = [pa.array(np.concatenate([x, y]), pa.int64()) for x, y in ((key, spread), (doc[row][~gone], d), (where[~gone], s), (np.ones(len(left), np.int64), s - e))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([*left, *[None] * len(s)], pa.binary())], ["key", "doc", "start", "n", "held"])

    return texts.mapInArrow(run, _TEXTS)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 100, hot: int = 20_000) -> DataFrame:
    """(id, text, found) for every row: found lists removed runs (start, end) in bytes of UTF-8, which may overlap.

    Null counts as empty; texts under span bytes lose nothing.  Copies within one document count.
    Of rows with one id each counts as a document: they stand behind one another by a hash of
    their texts, so one copy of a repeated row stays; null ids come last.  Ids must be integers.  An empty table gives no rows; extra columns are ignored.
    """
    numbered, moved = placed(docs, id_col, text_col)
    source = numbered.select("doc", "text")
    rows = materialize(settle_buckets(anchor_rows(source, span), span, hot))
    settled = rows.filter("meta < 0").select("doc", "start", (F.col("start") - F.col("meta")).alias("end"))
    dealt = source.repartition("doc")  # read by all joins below, in one plan: one shuffle of the texts

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                key, doc, start, n, held = [], [], [], [], []
                for d, text, checks in zip(*(c.to_pylist() for c in part.columns)):
                    data = text.encode()
                    for c in checks:
                        m = c["meta"]
                        key.append(c["key"])
                        doc.append(d)
                        start.append(c["start"])
                        n.append(m)
                        held.append(data[c["start"] : c["start"] + m + span - 1])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.binary())], ["key", "doc", "start", "n", "held"])

    def covered(which: str) -> DataFrame:
        checks = rows.filter(f"meta > 0 AND {which}").groupBy("doc").agg(F.collect_list(F.struct("key", "start", "meta")).alias("checks"))
        return dealt.join(checks, "doc").select("doc", "text", "checks").mapInArrow(fetch, _TEXTS)

    texts = covered("key <> 0")
    if rows.filter("meta > 0 AND key = 0").limit(1).count():
        texts = texts.unionByName(_by_window(covered("key = 0"), span))
    found = settled.unionByName(_compare(texts, span))
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    whole = dealt.join(per_doc, "doc", "left")
    if moved:
        whole = whole.join(numbered.select("doc", "id"), "doc")
    return whole.select("id" if moved else F.col("doc").alias("id"), "text", "found")


def suffix_dedup(docs: DataFrame, *, keep_text: bool = True, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): what is left of every document, the first copy of every passage kept.  kept is binary: a cut may fall inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for doc, text, found in zip(*(c.to_pylist() for c in part.columns)):
                    data = (text or "").encode()
                    if found:
                        s, e, _ = merge(np.array([f["start"] for f in found]), np.array([f["end"] for f in found]), np.zeros(len(found), np.int64))
                    else:
                        s = e = np.zeros(0, np.int64)
                    edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(data)]
                    kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    out.append((doc, len(data), len(data) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                k = 6 if keep_text else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds)], names[:k])

    shape = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")
    return repeated_spans(docs, **how).mapInArrow(run, shape)
