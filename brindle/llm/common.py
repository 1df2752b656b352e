"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: str.translate table that lower-cases A-Z and nothing else
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, JVM-side."""
    return F.translate(col, UPPER, LOWER)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no input column has them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def integer_ids(df: DataFrame, *columns: str) -> None:
    """Refuse ids that are no integers before any job runs."""
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
            raise TypeError(f"ids must be integers, but {c} is {kind}")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir.  A temporary one only where that is unset and the session is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no more than the files' readers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.brindle_path = path
    return held


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "brindle_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc, id, text) of every row, doc being a different number for every row that ascends with the id; and whether doc differs from id.

    Where ids are unique and not null, doc is the id and nothing is moved.  Otherwise
    null ids come last and rows with equal ids follow one another by a hash of their texts; (id, hash, row) is
    sorted by ranges, so a frequent id does not stay in one task, and the number is the place in that order.
    """
    integer_ids(docs, id_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not source.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 OR id IS NULL").limit(1).count():
        return source.select(F.col("id").alias("doc"), "id", "text"), False
    rows = materialize(source.withColumn("row", F.monotonically_increasing_id()))
    order = rows.select("id", F.xxhash64("text").alias("h"), "row").orderBy(F.asc_nulls_last("id"), "h", "row")
    numbers = materialize(order.select("row", F.monotonically_increasing_id().alias("doc")))
    out = materialize(rows.join(numbers, "row").select("doc", "id", "text"))
    discard(rows, numbers)
    return out, True


def give_back() -> None:
    """Give freed memory back to the system: a process that lives on must not add up what each piece of work has freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back when a task ends; its worker goes on to the next one."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def text_runs(batches: Iterator[pa.RecordBatch], where: int, size: int, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about size bytes of their text column, most rows at most; one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(where).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = min(at + most, max(at + 1, int(np.searchsorted(ends, base + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def crc_fold(doc_id) -> int:
    """crc32 of an id written as decimal text."""
    return zlib.crc32(str(doc_id).encode())


def hash_strings(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, the same on every machine."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
