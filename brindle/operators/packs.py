"""Deterministic dataset packs: hash-ordered sampling, family splits, quotas, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import FACETS, hash_order

# Popularity bands by number of reviews.
BANDS = ((0, 5), (5, 100), (100, 1_000), (1_000, 5_000), (5_000, 20_000), (20_000, None))


def family_key(title: Column | str, loose: bool = False) -> Column:
    """Near-duplicate family of a title: lower-case words; loose also drops colours and digits."""
    t = F.lower(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    if loose:
        t = F.regexp_replace(F.regexp_replace(t, rf"\b({FACETS['color']})\b", " "), r"\d+", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def one_per_family(rows: DataFrame, family: str, id_col: str, seed: str) -> DataFrame:
    """The member of each family that comes first in hash order."""
    key = hash_order(F.lit(seed), F.col(id_col))
    return rows.groupBy(family).agg(F.min_by(id_col, key).alias(id_col), F.count(F.lit(1)).alias("members"))


def deal(rows: DataFrame, id_col: str, seed: str, cycle: tuple[str, ...], within: str | None = None) -> DataFrame:
    """Deal rows in hash order to a repeating cycle of splits, within each group.

    Rows are numbered inside 4096 ranges of the hash, and each range begins where the one before ends, so that no
    task holds a whole group, or, without groups, all rows.
    """
    group = F.col(within) if within else F.lit(1)
    keyed = rows.withColumn("__g", group).withColumn("__h", hash_order(F.lit(seed), F.col(id_col))).withColumn("__r", F.substring("__h", 1, 3))
    sizes = keyed.groupBy("__g", "__r").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__g").alias("__g2"), F.col("__r").alias("__r2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__g", "__r").orderBy("__h", id_col)) - 1
    placed = keyed.withColumn("__i", local).join(starts, F.col("__g").eqNullSafe(F.col("__g2")) & (F.col("__r") == F.col("__r2")))
    names = F.array(*[F.lit(c) for c in cycle])
    split = F.get(names, F.pmod(F.col("__i") + F.col("__start"), F.lit(len(cycle))).cast("int"))
    return placed.withColumn("split", split).drop("__g", "__h", "__r", "__i", "__g2", "__r2", "__start")


def band(reviews: Column) -> Column:
    out = F.lit(len(BANDS) - 1)
    for i, (_, high) in reversed(list(enumerate(BANDS[:-1]))):
        out = F.when(reviews < high, i).otherwise(out)
    return out


def quotas(counts: DataFrame, total: int) -> DataFrame:
    """(band, n, quota): total places shared in proportion, largest remainders first, ties by band."""
    everything = F.sum("n").over(Window.partitionBy(F.lit(1)))
    exact = counts.withColumn("exact", F.col("n") * F.lit(float(total)) / everything).withColumn("low", F.floor("exact").cast("long"))
    left = F.lit(total) - F.sum("low").over(Window.partitionBy(F.lit(1)))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("exact") - F.col("low"), 9)), "band"))
    return exact.withColumn("left", left).withColumn("i", order).select("band", "n", (F.col("low") + F.when(F.col("i") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def round_robin(rows: DataFrame, strata: str, id_col: str, seed: str, k: int) -> DataFrame:
    """The first k rows taken in turn from the strata, each in hash order."""
    inner = F.row_number().over(Window.partitionBy(strata).orderBy(hash_order(F.lit(seed), F.col(id_col)), id_col))
    return rows.withColumn("i", inner).orderBy("i", strata).limit(k)


def overlap(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(dimension, value, splits): values that more than one split holds."""
    out = None
    for d in dimensions:
        part = rows.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")
        out = part if out is None else out.unionByName(part)
    return out


def stratified_split(rows: DataFrame, id_col: str, scenario: str, quotas: dict[str, int], seed: str, *, group: str | None = None) -> DataFrame:
    """rows with split 'validation' for each scenario's quota of groups in hash order, 'train' for the others; all rows of a group (default: a row) go one way, by the scenario of its first row."""
    key = group or id_col
    first = rows.groupBy(key).agg(F.min_by(scenario, F.struct(hash_order(F.lit(seed), F.col(id_col)), F.col(id_col))).alias("__s"))
    wanted = F.lit(0)
    for name, n in quotas.items():
        wanted = F.when(F.col("__s") == name, n).otherwise(wanted)
    place = F.row_number().over(Window.partitionBy("__s").orderBy(hash_order(F.lit(seed), F.col(key)), key))
    dealt = first.withColumn("split", F.when(place <= wanted, "validation").otherwise("train")).drop("__s")
    return rows.join(dealt, key)


def unseen_sessions(products: DataFrame, id_col: str, bucket: str, per_bucket: int, scenarios: tuple[str, ...], seed: str) -> DataFrame:
    """(id, bucket, scenario, ordinal): per_bucket products of each bucket in hash order as targets of synthetic sessions, scenarios dealt in turn."""
    i = F.row_number().over(Window.partitionBy(bucket).orderBy(hash_order(F.lit(seed), F.col(id_col)), id_col))
    some = products.withColumn("ordinal", i).filter(F.col("ordinal") <= per_bucket)
    return some.select(F.col(id_col).alias("id"), F.col(bucket).alias("bucket"), F.get(F.array(*[F.lit(s) for s in scenarios]), F.pmod(F.col("ordinal") - 1, F.lit(len(scenarios))).cast("int")).alias("scenario"), "ordinal")
