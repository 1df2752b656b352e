"""N-gram Jaccard self-join: a grouped prefix join.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  In one
global order (shingles that are common in the corpus last, else by hash) two
sets of Jaccard t or more share a shingle among the first n - ceil(t*n) + 1 of
each.  Documents with equal sets are one class; classes with the same size and
the same prefix are one group, and only groups enter the inverted lists.  Lists
of groups expand to members; pairs of members are filtered by size and by a
parity bitmap of a length that follows the set's size, which bounds the overlap from
above, and the rest are verified on whole sets.

Inside a list, pairs that can only confirm a connection already proposed are
left to a second round: the first verifies a spanning forest of the filtered
pairs, the second verifies every remaining pair between different components.
So no link between different components is lost, and a large group of near
copies does not expand to all its pairs: the first round deals a long list into blocks that share some hubs, which
is linear in its length, and the second leaves out lists of one component and pairs only what lies
outside a list's largest component with the rest of it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialize, mix64, placed, tidied
from .components import connected_components
from .exact_dedup import settle

BITS = (512, 32_768)  # least and most bits of a parity bitmap
CACHE_WORDS = 300_000
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    """word -> number; the words' 64-bit hashes stand in one growing array."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.hashes, self.digest = array("Q"), xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(self.digest(word))
        return n


class Shingler:
    """Texts -> shingle hashes.  bytes.split() cuts at exactly the six ASCII blanks of the word rule."""

    def __init__(self, width: int = 5):
        self.width, self.numbers = width, _Numbers()

    def raw(self, texts: list[str | None]) -> list[np.ndarray]:
        """Hashes of every text's shingles, repeats kept."""
        if len(self.numbers) > CACHE_WORDS:
            self.numbers = _Numbers()
        words, counts = [], []
        for t in texts:
            w = t.encode().translate(_LOWER).split() if t else ()
            words += w
            counts.append(len(w))
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        h = np.array(self.numbers.hashes, dtype=np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
        width = self.width
        full = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for k in range(width):
            full += h[k : k + len(full)] * _ODD[k % 5] * np.uint64(2 * (k // 5) + 1)
        full = mix64(full)
        out, at = [], 0
        for n in counts:
            if n >= width:
                out.append(full[at : at + n - width + 1])
            elif n:
                short = np.full(1, n, np.uint64)
                for k in range(n):
                    short += h[at + k : at + k + 1] * _ODD[k % 5] * np.uint64(2 * (k // 5) + 1)
                out.append(mix64(short))
            else:
                out.append(h[:0])
            at += n
        return out

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of every text's shingles."""
        return [np.unique(x) for x in self.raw(texts)]


def least_overlap(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set it links with: ceil(t*n)."""
    return -(-percent * n // 100)


def common_shingles(docs: DataFrame, id_col: str, text_col: str, *, width: int, most: int) -> np.ndarray:
    """At most ``most`` shingles with the highest document counts, sorted; only the order of prefixes depends on them.

    Every occurrence in every document counts.  A task sums over blocks of documents
    and passes on what it saw twice or more, so a count falls short by one a block at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        held, size = [], 0

        def block():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n > 1
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = shingle.raw(batch.column(0).slice(at, 256).to_pylist())
                held += some
                size += sum(map(len, some))
                if size > 4_000_000:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    counts = materialize(docs.select(F.col(text_col)).mapInArrow(tidied(count), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 8"))
    steps = {r["k"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    total, floor = 0, None
    for k in sorted(steps, reverse=True):
        total += steps[k]
        if total > most:
            break
        floor = k
    if floor is None:
        return np.zeros(0, np.uint64)
    rows = counts.filter(F.floor(F.log2("n")) >= floor).select("h").toArrow().column(0)
    discard(counts)
    return np.sort(rows.to_numpy().view(np.uint64))


def _bitmap(h: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by hash: over four times as many bits as shingles, within BITS, a power of two."""
    size = min(BITS[1], max(BITS[0], 1 << (4 * len(h)).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8).tobytes()


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of size bytes: longer ones folded, which is what a shorter bitmap of the same set holds."""
    out = np.empty((len(bits), size), np.uint8)
    for i, b in enumerate(bits):
        x = np.frombuffer(b, np.uint8)
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out.view(np.uint64)


def _fold64(x: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(x + np.uint64(seed)).sum(dtype=np.uint64).view(np.int64))


def describe(docs: DataFrame, common: np.ndarray, *, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, digest, gid, bits, prefix) per document; prefix is null where the task has sent that group's already."""
    held = docs.sparkSession.sparkContext.broadcast(common)
    schema = "id bigint, n bigint, digest string, gid bigint, bits binary, prefix array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, heavy = Shingler(width), held.value
        mask = np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[(heavy & mask).astype(np.int64)] = True
        sent: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, digest, gids, bits, prefixes = [], [], [], [], []
                for h in shingle(part.column(1).to_pylist()):
                    n.append(len(h))
                    digest.append(f"{len(h)}:{_fold64(h, 1)}:{_fold64(h, 77)}")
                    bits.append(_bitmap(h))
                    hot = maybe[(h & mask).astype(np.int64)]
                    if hot.any():
                        found = np.searchsorted(heavy, h[hot])
                        hot[hot] = heavy[np.minimum(found, len(heavy) - 1)] == h[hot]
                    token = np.sort((mix64(h) >> np.uint64(1)) | (hot.astype(np.uint64) << np.uint64(63)))
                    token = token[: len(h) - least_overlap(len(h), percent) + 1] if len(h) else token
                    gid = int(mix64(np.array([_fold64(token * _ODD[0], len(h))], np.int64).view(np.uint64)).view(np.int64)[0])
                    gids.append(gid)
                    if len(h) and gid not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(gid)
                        prefixes.append(token.view(np.int64))
                    else:
                        prefixes.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest), pa.array(gids, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "digest", "gid", "bits", "prefix"])

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first ``keys`` columns, cut so that no run of equal keys is cut."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        last = np.ones(len(cols[0]), bool)
        for k in range(keys):
            last &= cols[k] == cols[k][-1]
        cutoff = len(last) - int(last.sum())
        if cutoff:
            yield [c[:cutoff] for c in cols]
        held = [c[cutoff:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _bounded_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Like _runs for one key, but a run of over ``most`` rows comes in parts.  True with every part of such a run, and only with these."""
    held, cut = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        if cut is not None:  # the rest of a run that has been cut
            own = int((cols[0] == cut).sum())
            if own:
                yield True, [c[:own] for c in cols]
                cols = [c[own:] for c in cols]
            if not len(cols[0]):
                held = None
                continue
            cut = None
        at = len(cols[0]) - int((cols[0] == cols[0][-1]).sum())
        if at:
            yield False, [c[:at] for c in cols]
        held = [c[at:] for c in cols]
        if len(held[0]) > most:
            yield True, held
            cut, held = held[0][0], None
    if held is not None and len(held[0]):
        yield False, held


def group_lists(postings: DataFrame, percent: int, most: int = 1_000_000) -> DataFrame:
    """(lid, gid): groups that share a prefix shingle, one list for each different set of groups.

    postings: (token, gid, place), place being size * 2**32 + position.  Lists of over
    ``most`` groups pass through in parts under the token's own number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for cut, (token, gid, place) in _bounded_runs(batches, most):
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(gid, pa.int64())], ["lid", "gid"])
                continue
            n, pos = place >> 32, place & 0xFFFFFFFF
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
            token, gid, n, pos = token[new], gid[new], n[new], pos[new]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.concatenate([first, [len(token)]]))
            two = first[size == 2]
            # size and place filters for the pairs
            low, high = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
            room = np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1])
            need = -(-percent * (low + high) // (100 + percent))
            two = two[(100 * low >= percent * high) & (room >= need)]
            lists = [np.stack([two, two + 1], axis=1)] if len(two) else []
            out_l, out_g = [], []
            if lists:
                g = np.sort(gid[lists[0]], axis=1).view(np.uint64)
                lid = mix64(mix64(g[:, 0]) + g[:, 1]).view(np.int64)
                _, pick = np.unique(lid, return_index=True)
                out_l.append(np.repeat(lid[pick], 2))
                out_g.append(g[pick].view(np.int64).ravel())
            for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                g = gid[f : f + s]
                if (100 * n[f : f + s].min() >= percent * n[f : f + s].max()) or s > 64:
                    kept = g
                else:  # members with a partner in size
                    ns = n[f : f + s]
                    fit = (100 * np.minimum(ns[:, None], ns[None, :]) >= percent * np.maximum(ns[:, None], ns[None, :])).sum(axis=1) > 1
                    kept = g[fit]
                    if not len(kept):
                        continue
                lid = _fold64(kept.view(np.uint64), 5)
                if lid in sent:
                    continue
                if len(sent) > 500_000:
                    sent.clear()
                sent.add(lid)
                out_l.append(np.full(len(kept), lid))
                out_g.append(kept)
            if out_l:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_l), pa.int64()), pa.array(np.concatenate(out_g), pa.int64())], ["lid", "gid"])

    return postings.repartition("token").sortWithinPartitions("token", "gid").mapInArrow(tidied(run), "lid bigint, gid bigint").distinct()


def best_forest(likeness: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of most likeness (a symmetric table, 0 for no edge), by Prim's rule on the dense table."""
    m = len(likeness)
    best, near = np.zeros(m, likeness.dtype), np.zeros(m, np.int64)
    out, left = [], np.ones(m, bool)
    for _ in range(m):
        k = int(np.argmax(np.where(left, best, -1)))
        if best[k] > 0:
            out.append((int(near[k]), k))
        left[k] = False
        closer = likeness[k] > best
        best[closer], near[closer] = likeness[k][closer], k
    return out


def member_pairs(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b): pairs of the same list that pass the filters, with different components; only the spanning forest of most estimated likeness unless every, so that likely links come before doubtful ones.

    members: (lid, x, y, blk, id, n, bits, component); x and y number the two
    blocks of a list that a task pairs, blk the member's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lid, x, y, blk, ids, n, bits, comp in _runs(batches, 3):
            cuts = np.flatnonzero(np.concatenate([[True], (lid[1:] != lid[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            ends = np.concatenate([cuts[1:], [len(lid)]])
            out_a, out_b = [], []
            for f, e in zip(cuts.tolist(), ends.tolist()):
                _, own = np.unique(ids[f:e], return_index=True)
                own += f
                if len(own) < 2 or (comp[own] == comp[own[0]]).all():
                    continue
                own = own[np.argsort(n[own], kind="stable")]
                i_, n_, c_, k_ = ids[own], n[own], comp[own], blk[own]
                held = bits[own].tolist()
                sizes = np.array([len(h) for h in held])  # grow with n, so partners' bitmaps are as long or longer
                level, table, first = 0, None, 0
                cross = x[f] != y[f]
                found: list[tuple[int, int]] = []
                likeness = None if every else np.zeros((len(own), len(own)), np.float32)
                tops = np.searchsorted(percent * n_, 100 * n_, "right")  # partners in size end here
                for k in range(len(i_) - 1):
                    top = int(tops[k])
                    if top <= k + 1:
                        continue
                    if sizes[k] != level:
                        level, first = int(sizes[k]), k
                        end = int(tops[np.searchsorted(sizes, level, "right") - 1])
                        table = _folded(held[first:end], level)
                    other = slice(k + 1, top)
                    ham = np.bitwise_count(table[k + 1 - first : top - first] ^ table[k - first]).sum(axis=1, dtype=np.int64)
                    total = n_[other] + n_[k]
                    ok = (100 + percent) * (total - ham) >= 2 * percent * total
                    ok &= c_[other] != c_[k]
                    if cross:
                        ok &= k_[other] != k_[k]
                    if every:
                        found += [(k, j) for j in (np.flatnonzero(ok) + k + 1).tolist()]
                    elif ok.any():
                        likeness[k, k + 1 : top] = likeness[k + 1 : top, k] = np.where(ok, (total - ham + 1) / (total + ham + 1), 0)
                for k, j in found if every else best_forest(likeness):
                    out_a.append(min(i_[k], i_[j]))
                    out_b.append(max(i_[k], i_[j]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    dealt = members.select("lid", "x", "y", "blk", "id", "n", "bits", "component").repartition("lid", "x", "y").sortWithinPartitions("lid", "x", "y")
    return dealt.mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def _dealt(members: DataFrame, blk: Column, other: Column) -> DataFrame:
    """members with a row for each block number in other; x and y are that pair of blocks in order."""
    spread = members.withColumn("blk", blk.cast("int")).withColumn("other", F.explode(other.cast("array<int>")))
    return spread.withColumn("x", F.least("blk", "other")).withColumn("y", F.greatest("blk", "other")).select("lid", "x", "y", "blk", "id", "n", "component")


def shared_blocks(members: DataFrame, block: int, hubs: int = 16) -> DataFrame:
    """Lists of more than block members in blocks of about that many; about ``hubs`` members of a list stand in all its blocks and hold them together."""
    sizes = members.groupBy("lid").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    sized = members.join(sizes, "lid", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)))
    hub = F.pmod(F.xxhash64("id", F.lit(7)), F.col("size")) < hubs
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    every = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    spread = sized.withColumn("blk", F.explode(every.cast("array<int>")))
    return spread.select("lid", F.col("blk").alias("x"), F.col("blk").alias("y"), "blk", "id", "n", F.col("id").alias("component"))


def open_blocks(members: DataFrame, block: int) -> DataFrame:
    """Lists with several components as pairs of blocks: all that lies outside the largest component with all of the list.

    Lists of up to block members are one block.  In a longer one the blocks outside the largest component come
    first, and meet one another and those of the largest; these do not meet among themselves.
    """
    kinds = members.groupBy("lid", "component").agg(F.count(F.lit(1)).alias("c"))
    per = kinds.groupBy("lid").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "component")).alias("top")).filter("kinds > 1")
    per = per.select("lid", "size", F.col("top.c").alias("most"), F.col("top.component").alias("main"))
    j = members.join(per, "lid")
    long = F.col("size") > block
    n_rest = F.when(long, F.ceil((F.col("size") - F.col("most")) / block)).otherwise(F.lit(1))
    n_main = F.when(long, F.ceil(F.col("most") / block)).otherwise(F.lit(0))
    j = j.withColumn("n_rest", n_rest.cast("int")).withColumn("n_main", n_main.cast("int")).withColumn("in_main", long & (F.col("component") == F.col("main")))
    h = F.xxhash64("id")
    blk = F.when(F.col("in_main"), F.col("n_rest") + F.pmod(h, F.greatest("n_main", F.lit(1)))).otherwise(F.pmod(h, F.col("n_rest")))
    last = F.when(F.col("in_main"), F.col("n_rest") - 1).otherwise(F.col("n_rest") + F.col("n_main") - 1)
    return _dealt(j, blk, F.sequence(F.lit(0), last))


def verify(pairs: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, width: int, percent: int, broadcast_rows: int = 1_000_000, chunk: int = 64) -> DataFrame:
    """(a, b) of the pairs that link, by the shingles of their whole texts.

    Of a pair the text in more pairs is the hub.  Pairs are dealt by hub and chunk of about
    ``chunk`` partners; a hub's text travels once a chunk, ahead of its partners, so a frequent hub is neither copied to each of its pairs nor left to one task.
    Up to broadcast_rows pairs are broadcast to where the texts are read, so only
    texts that some pair needs are shuffled; above that the texts are joined by a shuffle.
    """
    near = F.broadcast if pairs.count() <= broadcast_rows else (lambda df: df)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    of_a, of_b = (ends.select(F.col("id").alias(c), F.col("deg").alias(f"deg_{c}")) for c in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b")
    first = F.col("deg_a") >= F.col("deg_b")
    other = F.when(first, F.col("b")).otherwise(F.col("a"))
    part = F.pmod(F.xxhash64(other), F.ceil(F.greatest("deg_a", "deg_b") / chunk)).cast("int")
    turned = materialize(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), part.alias("part"), other.alias("id")))
    wanted = turned.withColumn("tag", F.lit(1)).unionByName(turned.select("hub", "part", F.col("hub").alias("id")).distinct().withColumn("tag", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        own = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hubs, ids, tags, texts = (part.column(k).to_pylist() for k in (0, 2, 3, 4))
                a, b = [], []
                for hub, i, tag, x in zip(hubs, ids, tags, shingle(texts)):
                    if not tag:
                        own = x
                        continue
                    shared = len(x) + len(own) - len(np.union1d(x, own))
                    if 100 * shared >= percent * (len(x) + len(own) - shared):
                        a.append(min(hub, i))
                        b.append(max(hub, i))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("t"))
    rows = texts.join(near(wanted), F.col("__id") == F.col("id")).select("hub", "part", "id", "tag", "t")
    found = materialize(rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "tag").mapInArrow(tidied(run), "a bigint, b bigint"))
    discard(turned)
    return found


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, most_common: int = 500_000, block: int = 512) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    Documents link when 100 * intersection >= percent * union of their
    distinct shingles; component_id is the smallest id a document reaches by
    links.  Texts of fewer than width words have one shingle, the whole
    sequence; null, empty and blank texts have none and link with nothing.
    Ids must be integers.  Rows with equal or null ids are documents of their own, null being the greatest id; equal texts (ties, repeated
    rows) are linked.  An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    numbered, moved = placed(docs, id_col, text_col)
    found = _components(numbered.select("doc", "text"), width, percent, most_common, block)
    if not moved:
        return found.withColumnsRenamed({"id": id_col})
    ids = numbered.select("doc", F.col("id").alias("__own"))
    own = found.join(ids, found["id"] == ids["doc"]).select("__own", "n_shingles", "component_id")
    least = ids.select(F.col("doc").alias("__least"), F.col("__own").alias("__component"))
    return own.join(least, own["component_id"] == least["__least"]).select(F.col("__own").alias(id_col), "n_shingles", F.col("__component").alias("component_id"))


def _components(docs: DataFrame, width: int, percent: int, most_common: int, block: int) -> DataFrame:
    """(id, n_shingles, component_id) of docs (doc, text), doc being unique."""
    common = common_shingles(docs, "doc", "text", width=width, most=most_common)
    rows = materialize(describe(docs, common, id_col="doc", text_col="text", width=width, percent=percent))
    filled = rows.filter("n > 0").select("id", "n", "digest", "gid")
    classes = materialize(settle(filled, [F.min("id").alias("rep")]))
    reps = materialize(rows.join(classes.filter("id = rep").select("id"), "id", "left_semi").select("id", "n", "gid", "bits"))
    bits = reps.select("id", "bits")
    postings = rows.filter("prefix is not null").select("gid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", (F.col("n") * F.lit(1 << 32) + F.col("pos")).alias("place"))
    same = reps.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("gid").alias("lid"), "gid")
    lists = group_lists(postings, percent).unionByName(same)
    members = materialize(lists.join(reps.select("gid", "id", "n"), "gid").select("lid", "id", "n"))  # bitmaps join only what is dealt
    alone = materialize(rows.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    discard(rows)
    how = {"id_col": "doc", "text_col": "text", "width": width, "percent": percent}
    first = materialize(member_pairs(shared_blocks(members, block).join(bits, "id"), percent, every=False))
    links = verify(first, docs, **how)
    parts = connected_components(links)
    reached = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    second = materialize(member_pairs(open_blocks(reached, block).join(bits, "id"), percent, every=True).join(first, ["a", "b"], "left_anti"))
    discard(members, reps, first)
    if second.limit(1).count():
        more = verify(second, docs, **how)
        parts = connected_components(links.unionByName(more))
        discard(more)
    discard(second, links)
    done = classes.select("id", "n", "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    linked = done.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return linked.unionByName(alone)
