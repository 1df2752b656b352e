"""Catalog sources and sinks: JSONL scans, derived index tables, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import FACETS, facet, finite, money
from ..operators.retrieval import postings

CATALOG = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("store", T.StringType()),
        T.StructField("description", T.ArrayType(T.StringType())),
        T.StructField("price", T.StringType()),
        T.StructField("average_rating", T.StringType()),
        T.StructField("rating_number", T.StringType()),
    ]
)
TEXT_FIELDS = ("title", "categories", "features", "details", "store", "description")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the fixed schema: unknown keys are ignored, numbers stay text until parsed."""
    return spark.read.schema(CATALOG).json(path)


def flatten(catalog: DataFrame) -> DataFrame:
    """One text column a field, and the parsed numbers; null is unknown."""
    details = F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    text = {"title": F.col("title"), "categories": F.array_join("categories", "; "), "features": F.array_join("features", "; "), "details": details, "store": F.col("store"), "description": F.array_join("description", "; ")}
    return catalog.select(F.col("parent_asin").alias("product_id"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in text.items()], F.col("categories").alias("path"), money("price")["value"].alias("price"), money("price")["lower_bound"].alias("price_is_lower_bound"), F.when(finite("average_rating") <= 5, finite("average_rating")).alias("rating"), F.floor(finite("rating_number")).cast("long").alias("reviews"))


def problems(catalog: DataFrame) -> DataFrame:
    """(problem, product_id, n): blank and repeated ids."""
    blank = catalog.filter(F.coalesce(F.trim("parent_asin"), F.lit("")) == "").agg(F.lit("blank id").alias("problem"), F.lit("").alias("product_id"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    twice = catalog.groupBy("parent_asin").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND parent_asin IS NOT NULL")
    return blank.unionByName(twice.select(F.lit("repeated id").alias("problem"), F.col("parent_asin").alias("product_id"), "n"))


def constraint_entries(flat: DataFrame) -> DataFrame:
    """(index_name, value, product_id): category suffixes, features, details, and material and colour facets."""
    n = F.size("path")
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.lower(F.array_join(F.slice("path", i, n - i + 1), " > ")))).otherwise(F.array().cast("array<string>"))
    parts = {"category": suffixes, "feature": F.split(F.lower("features"), "; "), "detail": F.split(F.lower("details"), "; ")}
    body = F.concat_ws(" ", "title", "features", "details")
    parts |= {name: facet(body, name) for name in ("material", "color")}
    out = None
    for name, values in parts.items():
        part = flat.select(F.lit(name).alias("index_name"), F.explode(values).alias("value"), "product_id").filter("value <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def build_index(flat: DataFrame, path: str) -> None:
    """Write the index tables to a new version's folder and then, last, a manifest that names it, with counts that open_index checks; postings are clustered by token.

    Readers go by the newest manifest, so a rebuild never shows them a mix of versions.
    """
    import uuid

    version = uuid.uuid4().hex
    tables = {"products": flat, "postings": postings(flat, "product_id", {f: f for f in TEXT_FIELDS}).repartitionByRange("token").sortWithinPartitions("token"), "entries": constraint_entries(flat)}
    spark = flat.sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/v={version}")
    counts = [(name, spark.read.parquet(f"{path}/{name}/v={version}").count(), version) for name in tables]
    spark.createDataFrame(counts, "name string, n long, version string").withColumn("built", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path}/manifest")


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index, after checking counts against the manifest and membership both ways."""
    built = spark.read.schema("name string, n long, version string, built timestamp").json(f"{path}/manifest")
    manifest = {r["name"]: r["last"] for r in built.groupBy("name").agg(F.max_by(F.struct("n", "version"), F.struct("built", "version")).alias("last")).collect()}
    tables = {name: spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{name}/v={manifest[name]['version']}") for name in ("products", "postings", "entries")}
    held = {r["name"]: r["n"] for r in built.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    for name, df in tables.items():
        everything = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{name}")  # all versions, and nothing beside them
        if df.count() != manifest[name]["n"] or everything.count() != held[name]:
            raise ValueError(f"{name} does not match the manifest")
    stray = tables["entries"].join(tables["products"], "product_id", "left_anti").limit(1).count()
    if stray:
        raise ValueError("entries without a product")
    return tables


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side: an empty result proves equal content."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def facets_of(flat: DataFrame) -> DataFrame:
    """(product_id, attribute, value, confidence): structured fields 0.95, titles 0.65, other text 0.5; the best source of a value counts."""
    out = None
    for field, confidence in (("details", 0.95), ("title", 0.65), ("features", 0.5), ("description", 0.5)):
        for name in FACETS:
            part = flat.select("product_id", F.lit(name).alias("attribute"), F.explode(facet(field, name)).alias("value"), F.lit(confidence).alias("confidence"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("product_id", "attribute", "value").agg(F.max("confidence").alias("confidence"))


def write_once(df: DataFrame, path: str) -> None:
    """A result sink that refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def fingerprint(flat: DataFrame) -> str:
    """A digest of the content, whatever the order of rows or files."""
    row = F.sha2(F.to_json(F.struct(*sorted(flat.columns))), 256)
    lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
    r = flat.agg(*lanes, F.count(F.lit(1)).alias("n")).first()
    import hashlib

    return hashlib.sha256(",".join(str(x) for x in r).encode()).hexdigest()


def fingerprints(flat: DataFrame, group: str) -> DataFrame:
    """(group, fingerprint, n): a digest of each group's rows, whatever their order: sums of four parts of the rows' digests, so no group is gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in flat.columns if c != group))), 256)
    lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    g = flat.groupBy(group).agg(*[lane.cast("string").alias(f"l{i}") for i, lane in enumerate(lanes)], F.count(F.lit(1)).alias("n"))
    return g.select(group, F.sha2(F.concat_ws(",", "l0", "l1", "l2", "l3", "n").cast("binary"), 256).alias("fingerprint"), "n")


def vectors_valid(vectors: DataFrame, vec: str, dims: int) -> DataFrame:
    """(rows, right_size, finite, unit): the checks of a vector table in one aggregate."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.size(vec) == dims).alias("right_size"), F.bool_and(~F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("finite"), F.bool_and(F.abs(norm - 1) < 1e-3).alias("unit"))


def ids_in_order(vectors: DataFrame, id_col: str) -> DataFrame:
    """(ids_in_order): whether ids are 0, 1, 2, ... without gaps or repeats, as positions in a matrix must be."""
    same = (F.count(F.lit(1)) == F.countDistinct(id_col)) & (F.min(id_col) == 0) & (F.max(id_col) == F.count(F.lit(1)) - 1)
    return vectors.agg(same.alias("ids_in_order"))


def read_fields(spark: SparkSession, path: str, id_key: str = "parent_asin") -> DataFrame:
    """(product_id, field, value, raw): every key of every JSON line as atomic values; lists give each item, objects each 'label: value' and the value."""
    v = spark.read.text(path).select(F.col("value").alias("raw"))
    entries = v.select("raw", F.explode(F.from_json("raw", "map<string,string>")).alias("field", "text"))
    plain = lambda x: F.array(x)
    listed = F.from_json("text", "array<string>")
    nested = F.flatten(F.transform(F.map_entries(F.from_json("text", "map<string,string>")), lambda e: F.array(F.concat_ws(": ", e["key"], e["value"]), e["value"])))
    values = F.when(F.col("text").startswith("["), F.coalesce(listed, plain(F.col("text")))).when(F.col("text").startswith("{"), F.coalesce(nested, plain(F.col("text")))).otherwise(plain(F.col("text")))
    rows = entries.withColumn("product_id", F.get_json_object("raw", f"$.{id_key}")).filter(F.col("field") != id_key)
    return rows.select("product_id", "field", F.explode(F.array_distinct(values)).alias("value"), "raw").filter(F.trim("value") != "")


def lock_pack(rows: DataFrame, path: str) -> None:
    """Write a data pack and, last, a manifest with its row count and content digest; refuses to overwrite."""
    rows.write.mode("errorifexists").json(f"{path}/rows")
    spark = rows.sparkSession
    spark.createDataFrame([(rows.count(), fingerprint(rows), rows.schema.json())], "n long, digest string, shape string").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def verify_pack(spark: SparkSession, path: str) -> bool:
    """Whether a pack still holds what its manifest says."""
    import json

    m = spark.read.schema("n long, digest string, shape string").json(f"{path}/manifest").first()
    rows = spark.read.schema(T.StructType.fromJson(json.loads(m["shape"]))).json(f"{path}/rows")
    return rows.count() == m["n"] and fingerprint(rows) == m["digest"]


__all__ = ["CATALOG", "build_index", "constraint_entries", "difference", "facets_of", "fingerprint", "flatten", "ids_in_order", "lock_pack", "open_index", "problems", "read_catalog", "read_fields", "vectors_valid", "verify_pack", "write_once"]
