"""Category-bucket search: admission of candidates, requirement matching by levels, and the order over them.

A product's fields are an array of (text, words, affirmed); a requirement is an array of branches (phrase, words, owner, limit),
of which one must hold.  Both meet as columns of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import BUCKET_FILLER, singular
from .evidence import held

# Materials, colours, components, question facets of this backend and words that say nothing in a request.
MATERIALS = "cotton polyester nylon leather wool spandex silk rayon linen suede denim rubber canvas viscose acrylic elastane".split()
COLORS = "black white blue red pink green brown gray grey purple yellow orange navy beige cream gold silver".split()
OWNERS = "shell lining upper sole outsole insole strap footbed".split()
REQUEST_FILLER = [*BUCKET_FILLER, *"that this have has be been also really must should ideally ideal option options".split()]
QUESTION_FACETS = {"material": MATERIALS, "color": COLORS, "size": "small medium large wide narrow petite plus".split(), "style": "casual formal slim relaxed fitted classic vintage".split(), "use_case": "hiking running gym winter outdoor work travel".split()}
LIMIT = r"(under|below|less than|at most|up to|maximum|max|budget(?: of)?|around|about|over|above|more than|at least|minimum|min|<=|>=|<|>)\s*(?::|is|of)?\s*\$?([0-9]+(?:\.[0-9]+)?)"
BETWEEN = r"\bbetween\s*\$?([0-9]+(?:\.[0-9]+)?)\s*(?:and|to|-)\s*\$?([0-9]+(?:\.[0-9]+)?)"
PREFIX = r"(?i)^(?:(?:for that|actually)[,:]?\s*)?(?:i\s+)?(?:would\s+)?(?:prefer|need|want|require|am looking for|have a preference for)\s+|^either\s+"


def _among(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words_of(text: Column) -> Column:
    """Lower-case words; decimals stay whole."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)?"), 0)


def affirmed_words(text: Column) -> Column:
    """Different words that nothing near them in their clause denies: no, without or neither among the three before, not without only, free behind or 'free of' before."""

    def stated(words):
        def denied(w, i):
            before = F.slice(words, F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3)))
            after = F.get(words, i + 1)
            says = lambda x: F.array_contains(before, F.lit(x))
            free_of = (F.get(words, i - 2) == "free") & (F.get(words, i - 1) == "of")
            return says("no") | says("without") | says("neither") | (says("not") & ~says("only")) | F.coalesce(after == "free", F.lit(False)) | F.coalesce(free_of, F.lit(False))

        return F.filter(words, lambda w, i: ~denied(w, i))

    clauses = F.split(F.coalesce(text, F.lit("")), r"[.!?;\n]|,\s*")
    return F.array_distinct(F.flatten(F.transform(clauses, lambda c: held(words_of(c), stated))))


def fields_of(texts: list[Column]) -> Column:
    return F.array(*[F.struct(F.array_join(words_of(t), " ").alias("text"), words_of(t).alias("words"), affirmed_words(t).alias("affirmed")) for t in texts])


def category_words(text: Column) -> Column:
    """Singular words of a category without filler."""
    return F.transform(F.filter(words_of(text), lambda w: ~F.array_contains(_among(BUCKET_FILLER), w)), singular)


def interval(text: Column) -> Column:
    """struct(lower, upper, lower_in, upper_in, target) of the limit that a text states; all null for none."""
    t = F.replace(F.lower(text), F.lit(","), F.lit(""))
    number = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).cast("double")
    low, high = number(BETWEEN, 1), number(BETWEEN, 2)
    word, amount = F.regexp_extract(t, LIMIT, 1), number(LIMIT, 2)
    near, above = word.isin("around", "about"), word.isin("over", "above", "more than", "at least", "minimum", "min", ">=", ">")
    between = low.isNotNull()
    return F.struct(
        F.when(between, low).when(above, amount).alias("lower"),
        F.when(between, high).when(~near & ~above, amount).alias("upper"),
        (between | ~word.isin("over", "above", "more than", ">")).alias("lower_in"),
        (between | ~word.isin("under", "below", "less than", "<")).alias("upper_in"),
        F.when(~between & near, amount).alias("target"),
    )


def interval_match(price: Column, b: Column) -> Column:
    """struct(level, share, violated) of a price: 4 within, 1 near a target, 0 when unknown or outside."""
    out = (price < b["lower"]) | (price == b["lower"]) & ~b["lower_in"] | (price > b["upper"]) | (price == b["upper"]) & ~b["upper_in"]
    bad = F.coalesce((price < b["lower"]) | ((price == b["lower"]) & ~b["lower_in"]), F.lit(False)) | F.coalesce((price > b["upper"]) | ((price == b["upper"]) & ~b["upper_in"]), F.lit(False))
    far = F.abs(price - b["target"])
    level = F.when(price.isNull() | bad, 0).when(b["target"].isNotNull(), F.when(far == 0, 4).otherwise(1)).otherwise(4)
    share = F.when(price.isNull() | bad, 0.0).when(b["target"].isNotNull(), 1 / (1 + far / F.greatest(b["target"], F.lit(1.0)))).otherwise(1.0)
    return F.struct(level.alias("level"), share.alias("share"), (price.isNotNull() & bad).alias("violated"))


def branches_of(text: Column) -> Column:
    """The alternatives of a request: (phrase, words, owner, limit); those without a word are left out."""

    def one(raw):
        bare = F.regexp_replace(F.regexp_replace(F.trim(raw), PREFIX, ""), r"(?i)^either\s+", "")
        words = F.array_distinct(F.filter(words_of(bare), lambda w: ~F.array_contains(_among(REQUEST_FILLER), w)))
        owners = F.array_intersect(words, _among(OWNERS))
        return F.struct(F.array_join(words_of(bare), " ").alias("phrase"), words.alias("words"), F.when(F.size(owners) == 1, owners[0]).alias("owner"), interval(bare).alias("limit"))

    return F.filter(F.transform(F.split(text, r"(?i)\s+or\s+"), one), lambda b: F.size(b["words"]) > 0)


def _locals(f: Column, owner: Column) -> Column:
    """A field's words of one component, a struct for every mention of it: from it up to the next component.

    As a field's last word a component also owns the words before it, back to the component before, if it is the first
    one or a material or colour stands right before it ("lining cotton, leather upper").
    """
    words, n = f["words"], F.size(f["words"])
    at = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(_among(OWNERS), w), i + 1)), lambda i: i.isNotNull())

    def spans(at):
        def span(p, k):
            stop, back = F.coalesce(F.get(at, k + 1), n + 1), F.coalesce(F.get(at, k - 1), F.lit(0))
            close = (k == 0) | F.array_contains(_among([*MATERIALS, *COLORS]), F.get(words, p - 2))
            begin = F.when((p == n) & (p > 1) & close, back + 1).otherwise(p)
            return F.when(F.get(words, p - 1) == owner, F.slice(words, begin, stop - begin))

        return F.filter(F.transform(at, span), lambda own: own.isNotNull())

    every = F.flatten(F.transform(F.array(at), spans))
    return F.transform(every, lambda own: F.struct(F.array_join(own, " ").alias("text"), own.alias("words"), F.array_intersect(own, f["affirmed"]).alias("affirmed")))


def branch_match(fields: Column, price: Column, b: Column) -> Column:
    """struct(level, share, violated): 4 a whole field, 3 the phrase in a field, 2 all words in a field, 1 some words, 0 none; materials or colours other than the wanted violate."""
    seen = F.when(b["owner"].isNull(), fields).otherwise(F.flatten(F.transform(F.filter(fields, lambda f: F.array_contains(f["words"], b["owner"])), lambda f: _locals(f, b["owner"]))))

    def judged(seen):
        stated = F.array_distinct(F.flatten(F.transform(seen, lambda f: f["affirmed"])))
        full = F.filter(seen, lambda f: F.size(F.array_except(b["words"], f["affirmed"])) == 0)
        share = F.size(F.array_intersect(b["words"], stated)) / F.size(b["words"])

        def other(kind):
            wanted, there = F.array_intersect(b["words"], _among(kind)), F.array_intersect(stated, _among(kind))
            return (F.size(wanted) > 0) & (F.size(there) > 0) & (F.size(F.array_except(wanted, there)) > 0)

        padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
        level = F.when(F.exists(full, lambda f: f["text"] == b["phrase"]), 4).when(F.exists(full, lambda f: F.contains(padded(f["text"]), padded(b["phrase"]))), 3).when(F.size(full) > 0, 2).when(share > 0, 1).otherwise(0)
        return F.struct(level.alias("level"), F.when(F.size(full) > 0, 1.0).otherwise(share).alias("share"), (other(MATERIALS) | other(COLORS)).alias("violated"))

    limited = b["limit"]["lower"].isNotNull() | b["limit"]["upper"].isNotNull() | b["limit"]["target"].isNotNull()
    return F.when(limited, interval_match(price, b["limit"])).otherwise(held(seen, judged))


def tallies(fields: Column, price: Column, requirements: Column) -> Column:
    """struct of sums over requirements (text, hard, exclude): violations, hard and all counts at levels 2 to 4, shares."""

    def one(r):
        def best(matches):
            order = F.array_max(F.transform(matches, lambda m: F.struct((~m["violated"]).alias("ok"), m["level"].alias("level"), m["share"].alias("share"), m["violated"].alias("violated"))))
            out = F.when(r["exclude"], F.struct(F.lit(0).alias("level"), F.lit(0.0).alias("share"), F.exists(matches, lambda m: m["level"] >= 2).alias("violated"))).otherwise(F.struct(order["level"].alias("level"), order["share"].alias("share"), order["violated"].alias("violated")))
            return F.struct(out.alias("m"), r["hard"].alias("hard"), r["exclude"].alias("exclude"))

        return held(F.transform(branches_of(r["text"]), lambda b: branch_match(fields, price, b)), best)

    def summed(rows):
        total = lambda f: F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x).cast("double"))
        at = lambda n, hard: total(lambda x: ~x["exclude"] & (x["m"]["level"] >= n) & (x["hard"] if hard else F.lit(True)))
        share = lambda hard: total(lambda x: F.when(~x["exclude"] & (x["hard"] if hard else F.lit(True)), x["m"]["share"]).otherwise(0.0))
        return F.struct(total(lambda x: x["m"]["violated"]).alias("violations"), at(2, True).alias("hard_complete"), at(4, True).alias("hard_exact"), at(3, True).alias("hard_phrases"), F.round(share(True), 9).alias("hard_share"), at(4, False).alias("exact"), at(3, False).alias("phrases"), at(2, False).alias("complete"), F.round(share(False), 9).alias("share"))

    return held(F.transform(requirements, one), summed)


def rank(rows: DataFrame, *, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """rows (in_category, t, quality, reviews) with rank by the twelve keys and id."""
    t = lambda name: F.desc(F.col(f"t.{name}"))
    w = Window.partitionBy(query).orderBy(F.desc("in_category"), F.asc("t.violations"), t("hard_complete"), t("hard_exact"), t("hard_phrases"), t("hard_share"), t("exact"), t("phrases"), t("complete"), t("share"), F.desc("quality"), F.desc("reviews"), F.asc(doc))
    return rows.withColumn("rank", F.row_number().over(w))


def admit(in_category: DataFrame, exact: DataFrame, lexical: DataFrame, products: DataFrame, queries: DataFrame, *, limit: int = 2000, least: int = 10) -> DataFrame:
    """(query_id, doc_id, rank): the union of category members, exact matches (query_id, doc_id, n) and lexical hits (query_id, doc_id, rank), filled up from the best products where it is small.

    Order: category, exact matches, lexical rank, quality, id.
    """
    keys = ["query_id", "doc_id"]
    every = in_category.select(*keys).unionByName(exact.select(*keys)).unionByName(lexical.select(*keys)).distinct()
    sizes = queries.select("query_id").distinct().join(every.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").fillna(0, ["n"])
    best = products.orderBy(F.desc("quality"), "doc_id").limit(limit).withColumn("place", F.row_number().over(Window.orderBy(F.desc("quality"), "doc_id")))  # at most limit rows
    few = sizes.filter(F.col("n") < least).withColumn("fill", F.when(F.col("n") == 0, limit).otherwise(least))
    filled = few.join(F.broadcast(best), F.col("place") <= F.col("fill")).select(*keys)
    pool = every.unionByName(filled).distinct().join(products, "doc_id")
    pool = pool.join(in_category.select(*keys).distinct().withColumn("c", F.lit(1)), keys, "left").join(exact.select(*keys, F.col("n").alias("x")), keys, "left").join(lexical.select(*keys, F.col("rank").alias("l")), keys, "left")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("c", F.lit(0))), F.desc(F.coalesce("x", F.lit(0))), F.coalesce("l", F.lit(1 << 30)), F.desc("quality"), "doc_id")
    return pool.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(*keys, "rank")


def question_information(candidates: DataFrame, *, first: int = 30) -> DataFrame:
    """(query_id, attribute, information): entropy of the facet signatures of the first candidates (query_id, rank, affirmed) times the share that has one."""
    top = candidates.filter(F.col("rank") <= first)
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.array_join(F.array_sort(F.array_intersect("affirmed", _among(v))), " ").alias("s")) for a, v in QUESTION_FACETS.items()]))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    rows = top.withColumn("n", n).select("query_id", "n", kinds.alias("k")).select("query_id", "n", "k.*").filter("s <> ''")
    counts = rows.groupBy("query_id", "n", "attribute", "s").agg(F.count(F.lit(1)).alias("c"))
    known = F.sum("c").over(Window.partitionBy("query_id", "attribute"))
    share = counts.withColumn("known", known).withColumn("q", F.col("c") / F.col("known"))
    return share.groupBy("query_id", "attribute").agg(F.round(-F.sum(F.col("q") * F.log2("q")) * F.max("known") / F.max("n"), 9).alias("information")).filter("information > 0")
