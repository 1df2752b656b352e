"""The opN_ queries: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read
from .decontaminate import find_contamination
from .exact_dedup import exact_dedup
from .fingerprints import compare_edits
from .html_extract import extract_pages
from .line_dedup import line_dedup
from .lm_score import lm_score
from .ngram_join import ngram_components
from .packing import pack, pieces
from .periodic_runs import periodic_runs
from .ranked_search import ranked_search
from .secrets import scan_secrets
from .suffix_dedup import suffix_dedup
from .toxicity import score_toxicity, train


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(read(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = {k: _kind_count(k) for k in ("assign", "access", "hex")}
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", *[c.alias(f"n_{k}") for k, c in count.items()], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _kind_count(kind: str):
    return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = train(docs, read(spark, sf_dir, "labels").filter(~held_out()))
    return score_toxicity(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), keep_text=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform(F.array_distinct("matches.item_id"), lambda i: i.cast("string")))
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read(spark, sf_dir, "documents"), host_col="source")
    return done.select("doc_id", "source", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents whose id's crc32, written in decimal, ends in 0, with the words from one place on replaced by repeats of a stretch; all others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    sized = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    repeats = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    return period.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeats), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(read(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("power"), (-r["start"]).alias("early"), (-r["period"]).alias("small"), r["length"].alias("length")))
    best = found.withColumn("best", F.array_max(ranked))
    start, length, period = -F.col("best.early"), F.col("best.length"), -F.col("best.small")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compare_edits(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op1_pack": op1_pack, "op2_secrets": op2_secrets, "op3_toxicity": op3_toxicity, "op4_extract": op4_extract, "op5_suffix_dedup": op5_suffix_dedup, "op6_decontaminate": op6_decontaminate, "op7_line_dedup": op7_line_dedup, "op8_exact_dedup": op8_exact_dedup, "op9_lm_score": op9_lm_score, "op10_ngram_join": op10_ngram_join}
QUERIES |= {"op11_periodic_runs": op11_periodic_runs, "op12_ranked_search": op12_ranked_search, "op13_fingerprints": op13_fingerprints}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op6_decontaminate": r"""
        WITH tok AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '%(u)s', '%(l)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        item AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '%(u)s', '%(l)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        cand AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tok, sizes WHERE len(w) >= n)),
        occ AS (SELECT c.doc_id, c.i, c.n, win.item_id FROM cand c JOIN win ON win.n = c.n AND win.k = c.k),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY 1)
        SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM tok t LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""" % {"u": _UP, "l": _LOW},
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
        c AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM t WHERE k <> '' GROUP BY 1, 2),
        p AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
        b AS (SELECT c.source, c.k FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE c.n >= 5 AND c.n > 0.05::DOUBLE * p.n),
        m AS (SELECT t.*, b.k IS NOT NULL AS gone FROM t LEFT JOIN b ON t.source IS NOT DISTINCT FROM b.source AND t.k = b.k),
        r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS txt FROM m GROUP BY 1)
        SELECT d.doc_id, d.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(txt, '')) AS text_sha256
        FROM documents d LEFT JOIN r USING (doc_id)""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '%s', '%s')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""" % (_UP, _LOW),
    "op12_ranked_search": r"""
        WITH tok AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '%(u)s', '%(l)s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        item AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '%(u)s', '%(l)s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total FROM tok WHERE len(w) > 0),
        tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM tok) WHERE t IN (SELECT t FROM item) GROUP BY 1, 2, 3),
        df AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t, n_docs),
        imp AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // total)) AS x FROM tf, s),
        scored AS (SELECT item_id, doc_id, sum(w * x)::BIGINT AS score FROM item JOIN df USING (t) JOIN imp USING (t) GROUP BY 1, 2)
        SELECT item_id, rank, doc_id, score
        FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
        WHERE rank <= 50""" % {"u": _UP, "l": _LOW},
}
