"""A corpus pipeline of five stages over documents.

Every stage works on all rows its predecessor kept and returns the columns of
documents, but the last, which returns the packed pieces.  Stages learn only from
``labels`` and ``benchmark``; the statistics of a stage are those of its own input.

Null and empty texts are clean, have no lines to lose, link with nothing, hit nothing and pack as the end token alone;
repeated rows share an id, so all rows of an id stay or go together; documents of any length pass whole; an empty table
gives an empty result; extra columns travel with their rows up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import toxicity
from brindle.llm.common import discard, fresh, materialize, read
from brindle.llm.decontaminate import remove_contaminated
from brindle.llm.line_dedup import line_dedup
from brindle.llm.ngram_join import ngram_components
from brindle.llm.packing import pack, pieces
from brindle.llm.queries import held_out, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores under 0.3 stay.  It learns from labelled rows of the training folds among docs."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels").filter(~held_out())))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; every document stays, with n_chars counted anew."""
    done = line_dedup(docs, host_col="source")
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str, *, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Of documents linked by shingle sets of Jaccard 0.8 or more, the one with the smallest id stays.

    The ids that go are broadcast up to broadcast_rows of them (16 MB), else joined by a shuffle.
    """
    (name,) = fresh(docs.columns, "gone")
    gone = materialize(ngram_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)))
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    return remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, in sequences of 1024 tokens: one row for each piece."""
    return pieces(pack(docs, tokenizer_path(), keep_ids=False))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", one_of_each_group), ("decontaminate", decontaminate), ("pack", pack_rest)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            discard(before)
    return docs


#: The random field cannot be written in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
