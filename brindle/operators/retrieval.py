"""Full-text retrieval for batches of queries over inverted postings.

Postings hold one row per (document, field, token) with its count, so every
route is an equi-join on token followed by aggregations that combine map-side;
ranks come from windows that Spark limits before the shuffle.  Queries travel as a
DataFrame (query_id, ...): one job answers all of them.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import STOP_WORDS, terms, words
from . import counted as c

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_col: str, fields: Mapping[str, Column | str], tokenizer=terms, *, only: DataFrame | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, field, token, tf).  Queries over the same documents can share what write_postings keeps.

    With only, a frame of tokens, all other tokens of a field are counted together under a null token: lengths stay whole, and
    far fewer rows are shuffled or written.  It is broadcast up to broadcast_rows tokens.
    """
    plain = tokenizer is terms  # its stop words are dropped behind the explode, in generated code
    parts = [docs.select(F.col(id_col).alias("doc_id"), F.lit(name).alias("field"), F.explode(words(col) if plain else tokenizer(col)).alias("token")) for name, col in fields.items()]
    if plain:
        parts = [p.filter(~F.col("token").isin(*STOP_WORDS)) for p in parts]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if only is not None:
        known = only.select(F.col("token").alias("known")).distinct()
        known = F.broadcast(known) if known.count() <= broadcast_rows else known
        every = every.join(known, F.col("token") == F.col("known"), "left").select("doc_id", "field", F.col("known").alias("token"))
    return every.groupBy("doc_id", "field", "token").agg(F.count(F.lit(1)).alias("tf"))


def write_postings(post: DataFrame, path: str) -> DataFrame:
    """Postings written once, sorted by token, for all routes that read them."""
    return write_once(post.sortWithinPartitions("token"), path)


def write_once(rows: DataFrame, path: str) -> DataFrame:
    """Rows in a shared folder, for several routes to read: what made them, such as cutting texts into tokens, is done once."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Counted(NamedTuple):
    """Documents as rows (doc_id, n, tokens, times[, phrases, phrase_times]) of numbers of a vocabulary and of phrases."""

    rows: DataFrame
    vocabulary: list[str]
    phrases: list[list[str]]


def vocabulary_of(queries: DataFrame, most: int) -> list[str] | None:
    """The different tokens of queries (query_id, token), if there are no more than most of both."""
    wanted = queries.select("query_id", "token").filter("token is not null").distinct().limit(most + 1).toArrow()
    return None if wanted.num_rows > most else sorted(set(wanted["token"].to_pylist()))


def _countable(frame: DataFrame, id_col: str) -> bool:
    return frame.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def count_texts(docs: DataFrame, queries: DataFrame | None = None, phrases: DataFrame | None = None, *, path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> Counted | None:
    """What bm25 needs of documents for queries (query_id, token), and phrase_route for phrases (query_id, phrase), from one reading of the texts, written to path.

    None where queries, phrases or their words are more than broadcast_rows, or ids are no integers: then postings and arrays of tokens serve.
    """
    vocabulary = vocabulary_of(queries, broadcast_rows) if queries is not None else []
    found = phrases.filter(F.size("phrase") > 0).select("phrase").distinct().limit(broadcast_rows + 1).toArrow()["phrase"].to_pylist() if phrases is not None else []
    if vocabulary is None or len(found) > broadcast_rows or not _countable(docs, id_col):
        return None
    every = sorted({*vocabulary, *(w for p in found for w in p)})
    return Counted(write_once(c.count_texts(docs, id_col, text_col, every, found), path), every, found)


def count_postings(post: DataFrame, vocabulary: list[str], *, weights: Mapping[str, float] | None = None, fields: tuple[str, ...] | None = None, path: str | None = None) -> Counted:
    """The same from postings, with the counts of a field scaled by weights; fields restricts where tokens may match.  Written to path, or else computed whenever read."""
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("field") == name, F.lit(float(w))).otherwise(weight)
    numbers = post.sparkSession.createDataFrame(pa.table({"token": pa.array(vocabulary, pa.string()), "number": pa.array(range(len(vocabulary)), pa.int32())}))
    inside = F.lit(True) if fields is None else F.col("field").isin(*fields)
    met = post.join(F.broadcast(numbers), "token", "left").withColumn("hit", F.when(inside & F.col("number").isNotNull(), F.struct("number", (weight * F.col("tf")).alias("times"))))
    rows = met.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.collect_list("hit").alias("hits"))  # nulls are not collected
    rows = rows.select("doc_id", "n", F.col("hits.number").alias("tokens"), F.col("hits.times").alias("times"))
    return Counted(rows if path is None else write_once(rows, path), vocabulary, [])


def whole_documents(rows: DataFrame) -> DataFrame:
    """Counted rows with those of one id together; they are dealt anew only if an id occurs twice."""
    rows = rows.select("doc_id", "n", "tokens", "times")
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("tokens", "times")).alias("held")).select("doc_id", "n", F.flatten("held.tokens").alias("tokens"), F.flatten("held.times").alias("times"))


def with_tokens(counted: Counted, docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): the different asked tokens, as words, of the documents (doc_id)."""
    words = F.lit(counted.vocabulary) if counted.vocabulary else F.array().cast("array<string>")
    held = whole_documents(counted.rows).join(docs, "doc_id", "left_semi")
    return held.select("doc_id", F.transform(F.array_distinct("tokens"), lambda t: F.get(words, t)).alias("tokens"))


def bm25_counted(counted: Counted, queries: DataFrame, k: int = 350) -> DataFrame:
    """bm25 of counted documents, as a product of two sparse matrices by blocks of documents; queries hold tokens of their vocabulary."""
    spark, number = queries.sparkSession, {t: i for i, t in enumerate(counted.vocabulary)}
    wanted = queries.select("query_id", "token").filter("token is not null").distinct().toArrow()
    ids = wanted.select(["query_id"]).group_by("query_id").aggregate([])["query_id"].combine_chunks()
    place = {x: i for i, x in enumerate(ids.to_pylist())}
    asked: list[list[int]] = [[] for _ in place]
    for x, t in zip(wanted["query_id"].to_pylist(), wanted["token"].to_pylist()):
        asked[place[x]].append(number[t])
    rows = whole_documents(counted.rows).filter("n > 0")
    n_docs, average = rows.agg(F.count(F.lit(1)), F.avg("n")).first()
    frequency = rows.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).toArrow()
    weights = c.idf_weights(frequency, len(number), n_docs, LEAST_IDF)
    found = c.best_documents(rows, [np.array(sorted(a), np.int64) for a in asked], weights, average or 1.0, k, K1, B)
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(place)), pa.int32()), "query_id": ids}), queries.select(F.lit(0).alias("query"), "query_id").schema)
    best = top_k(found, k, query="query")
    return best.join(F.broadcast(names), "query").select("query_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), "score", "rank")


def doc_lengths(post: DataFrame) -> DataFrame:
    """(doc_id, n): tokens over all indexed fields."""
    return post.groupBy("doc_id").agg(F.sum("tf").alias("n"))


def top_k(scored: DataFrame, k: int, *, by: str = "score", query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(by), F.asc(doc))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def term_score(weighted_tf: Column, length: Column, average: Column, weight: Column) -> Column:
    return weight * weighted_tf * (K1 + 1) / (weighted_tf + K1 * (1 - B + B * length / average))


def bm25(post: DataFrame, queries: DataFrame, *, weights: Mapping[str, float] | None = None, fields: tuple[str, ...] | None = None, k: int | None = 350, broadcast_rows: int = 200_000, path: str | None = None) -> DataFrame:
    """(query_id, doc_id, score[, rank]) of queries (query_id, token).

    Document frequency and length are those of all indexed fields; weights
    scale the counts of a field (0 still admits the document); fields
    restricts where tokens may match.  Up to broadcast_rows query tokens the documents are counted, in path if it is given, and
    multiplied with all queries; beyond that, without k, or where ids are no integers, postings are joined with the tokens by a shuffle.
    """
    if k is not None and _countable(post, "doc_id"):
        vocabulary = vocabulary_of(queries, broadcast_rows)
        if vocabulary is not None:
            return bm25_counted(count_postings(post, vocabulary, weights=weights, fields=fields, path=path), queries, k)
    totals = doc_lengths(post).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len"))
    wanted = queries.select("query_id", "token").distinct()
    near = F.broadcast if wanted.count() <= broadcast_rows else (lambda df: df)
    used = post.withColumn("n", F.sum("tf").over(Window.partitionBy("doc_id"))).join(near(wanted.select("token").distinct()), "token", "left_semi")
    if fields is not None:
        used = used.filter(F.col("field").isin(*fields))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("field") == name, F.lit(float(w))).otherwise(weight)
    tf = used.groupBy("token", "doc_id", "n").agg(F.sum(weight * F.col("tf")).alias("wtf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(near(df), "token").crossJoin(F.broadcast(totals))  # totals is one row; df has a row a query token
    value = scored.select("token", "doc_id", term_score(F.col("wtf"), F.col("n"), F.col("avg_len"), idf(F.col("n_docs"), F.col("df"))).alias("s"))
    out = value.join(near(wanted), "token").groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))
    return out if k is None else top_k(out, k)


def phrase_route(docs: DataFrame, queries: DataFrame, k: int | None = 180, *, broadcast_rows: int = 200_000) -> DataFrame:
    """Documents (doc_id, tokens) that contain a query's phrase (query_id, phrase) in order, by BM25 of the phrase as one term.

    Every token is met with the phrases that begin with it, broadcast up to broadcast_rows of them, and the tokens behind it are compared; only
    places of whole phrases leave the documents.  Of places that touch or overlap the first counts.
    """
    asked = queries.filter(F.size("phrase") > 0).select("query_id", "phrase", F.get("phrase", F.lit(0)).alias("token"))
    few, longest = asked.agg(F.count(F.lit(1)) <= broadcast_rows, F.coalesce(F.max(F.size("phrase")), F.lit(1))).first()
    each = docs.select("doc_id", F.size("tokens").alias("n"), "tokens", F.posexplode("tokens").alias("at", "token"))
    if not few:  # what a phrase may need is cut before the shuffle
        each = each.select("doc_id", "n", F.slice("tokens", F.col("at") + 1, longest).alias("tokens"), "at", "token")
    met = each.join(F.broadcast(asked) if few else asked, "token")
    begin, size = F.col("at") if few else F.lit(0), F.size("phrase")
    second = (size == 1) | (F.get("tokens", begin + 1) == F.get("phrase", F.lit(1)))
    whole = met.filter(second).filter(F.slice("tokens", begin + 1, size) == F.col("phrase")).select("query_id", "doc_id", "n", size.alias("size"), "at")
    step = lambda a, at: F.when(at >= a["free"], F.struct((at + F.col("size") + 1).alias("free"), (a["tf"] + 1).alias("tf"))).otherwise(a)
    places = whole.groupBy("query_id", "doc_id", "n", "size").agg(F.sort_array(F.collect_list("at")).alias("places"))
    found = places.select("query_id", "doc_id", "n", F.aggregate("places", F.struct(F.lit(0).alias("free"), F.lit(0).alias("tf")), step, lambda a: a["tf"]).alias("tf"))
    return _phrase_scores(found, docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len")), k)


def phrases_counted(counted: Counted, queries: DataFrame, k: int | None = 180) -> DataFrame:
    """phrase_route of counted documents."""
    numbers = queries.sparkSession.createDataFrame([(i, p) for i, p in enumerate(counted.phrases)], "number int, phrase array<string>")
    asked = queries.filter(F.size("phrase") > 0).join(F.broadcast(numbers), "phrase").select("query_id", "number")
    held = counted.rows.filter(F.size("phrases") > 0).select("doc_id", "n", F.explode(F.arrays_zip("phrases", "phrase_times")).alias("p"))
    found = held.select("doc_id", "n", F.col("p.phrases").alias("number"), F.col("p.phrase_times").alias("tf")).join(F.broadcast(asked), "number")
    return _phrase_scores(found, counted.rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len")), k)


def _phrase_scores(found: DataFrame, totals: DataFrame, k: int | None) -> DataFrame:
    """Found (query_id, doc_id, n, tf) by BM25 of the phrase as one term."""
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    scored = found.join(counts, "query_id").crossJoin(F.broadcast(totals))
    out = scored.select("query_id", "doc_id", F.round(term_score(F.col("tf").cast("double"), F.col("n"), F.col("avg_len"), idf(F.col("n_docs"), F.col("df"))), 9).alias("score"))
    return out if k is None else top_k(out, k)


def divide(matches: DataFrame, wanted: DataFrame, *, doc: str = "doc_id", query: str = "query_id", clause: str = "clause") -> DataFrame:
    """Relational division: (query, doc) pairs such that matches (doc, clause) cover every clause wanted (query, clause)."""
    need = wanted.select(query, clause).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("need"))
    have = wanted.select(query, clause).distinct().join(matches, clause).groupBy(query, doc).agg(F.countDistinct(clause).alias("have"))
    return have.join(need, query).filter(F.col("have") == F.col("need")).select(query, doc)


def exact_intersection(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents having every recognised value; values no document has are ignored, none recognised gives none."""
    known = wanted.join(entries.select("value").distinct(), "value", "left_semi")
    return divide(entries.select("doc_id", F.col("value").alias("clause")).distinct(), known.select("query_id", F.col("value").alias("clause")))


def factored(post: DataFrame, queries: DataFrame, groups: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(query_id, doc_id) having a token of every group (query_id, group, token) in that group's fields."""
    parts = None
    for name, fields in groups.items():
        hit = queries.filter(F.col("group") == name).join(post.filter(F.col("field").isin(*fields)), "token").select("query_id", "doc_id").distinct()
        parts = hit if parts is None else parts.join(hit, ["query_id", "doc_id"], "left_semi")
    return parts


def document_frequency(rows: DataFrame, group: str, doc: str, tokens: str) -> DataFrame:
    """(group, token, df): candidates that have a token, not its occurrences."""
    return rows.select(group, doc, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(group, "token").agg(F.count(F.lit(1)).alias("df"))
