"""Text functions as Spark columns: tokens, facets, polarity, keys.  No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop words of the lexical backend and of the typed backend; facet vocabularies; polarity wording.
STOP_WORDS = "a about additional am an and are as at be but by do for from have i in is it looking me my need not of on or please preference some still that the these this those to want what with would you your".split()
TYPED_STOP_WORDS = "a an and are as at be but by for from i in is it me my of on or please some that the this to want with would you looking need like prefer something any more options choices find show should must can could".split()
BUCKET_FILLER = "a an the i am im s for to of with and or either is are it my me please would like prefer need want looking searching something some but still exploring".split()
FACETS = {
    "material": "cotton|polyester|nylon|leather|wool|spandex|silk|rayon|linen|denim|fleece|suede|canvas|rubber|synthetic|acrylic|fabric",
    "color": "black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange|beige|navy|gold|silver|multicolor",
    "size": "x{0,3}s|x{0,4}l|small|medium|large|wide|narrow|petite|plus size",
    "style": "casual|formal|classic|modern|vintage|slim|regular|relaxed|fitted|loose|athletic|crew neck|v-neck|long sleeve|short sleeve",
    "use_case": "running|hiking|walking|work|office|gym|workout|sports|travel|winter|outdoor|wedding|party|sleep|swimming|cycling",
}
FREE = r"(?i)\b(\w+)[- ]free\b"
NOT_ONLY = r"(?i)\bnot (?:only|just|exclusively)\b"
UNCERTAIN = r"(?i)\b(?:not (?:necessarily|always)|may not|might not|not (?:sure|clear|known|certain)(?: whether| if)?)\b[^,;.!?]*"
DENIAL = r"(?:no(?![- ]show\b)|not|without|free of|doesn't contain|does not contain)"
NEGATED = rf"(?i)\b{DENIAL}\b[^,;.!?]*?(?=$|[,;.!?]|\b(?:but|however|whereas|while)\b|\band\s+(?:the|its|a|an|with)\b)"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """Lower-case ASCII letter-and-digit runs, in order, repeats kept.  Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("[a-z0-9]+"), 0)


def terms(x: Column | str) -> Column:
    """words() without stop words."""
    return F.filter(words(x), lambda t: ~t.isin(*STOP_WORDS))  # a set: an array would be searched word by word


def typed_terms(x: Column | str, most: int = 64) -> Column:
    """First ``most`` different words of two characters or digits, without the typed stop words."""
    stop = F.array(*[F.lit(w) for w in TYPED_STOP_WORDS])
    kept = F.filter(words(x), lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]$")) & ~F.array_contains(stop, t))
    return F.slice(F.array_distinct(kept), 1, most)


def query_terms(x: Column | str, most: int = 48) -> Column:
    """The different terms of a query in order, at most ``most``."""
    return F.slice(F.array_distinct(terms(x)), 1, most)


def facet(x: Column | str, name: str) -> Column:
    """Sorted distinct values of a facet in a text, lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit(rf"\b({FACETS[name]})\b"), 1)
    return F.array_sort(F.array_distinct(found))


def affirmed(x: Column | str) -> Column:
    """The text without what it denies or leaves uncertain; null gives ''."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(_col(x), F.lit("")), NOT_ONLY, ""), UNCERTAIN, "")
    return F.regexp_replace(F.regexp_replace(text, FREE, " "), NEGATED, " ")


def denied(x: Column | str) -> Column:
    """Arrays of terms, one for each explicit denial."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(_col(x), F.lit("")), NOT_ONLY, ""), UNCERTAIN, "")
    free = F.regexp_extract_all(text, F.lit(FREE), 1)
    rest = F.regexp_extract_all(F.regexp_replace(text, FREE, " "), F.lit(NEGATED), 0)
    bare = F.transform(rest, lambda m: F.regexp_replace(m, rf"(?i)^{DENIAL}\b", ""))
    return F.filter(F.transform(F.concat(free, bare), terms), lambda t: F.size(t) > 0)


def has_sequence(fields: Column | str, phrase: Column | str) -> Column:
    """Whether an array of tokens stands contiguously in any of an array of token arrays.  An empty phrase does not."""
    needle = F.concat(F.lit(" "), F.array_join(_col(phrase), " "), F.lit(" "))
    return (F.size(_col(phrase)) > 0) & F.exists(_col(fields), lambda f: F.contains(F.concat(F.lit(" "), F.array_join(f, " "), F.lit(" ")), needle))


def singular(t: Column) -> Column:
    """Plural stripping of category words: -ies, -sses, -s."""
    return (
        F.when((F.length(t) > 4) & t.endswith("ies"), F.regexp_replace(t, "ies$", "y"))
        .when(t.endswith("sses"), F.regexp_replace(t, "es$", ""))
        .when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def finite(x: Column | str, least: float = 0.0, inclusive: bool = False) -> Column:
    """A number from anything castable; null for text, NaN, infinities and values out of range."""
    d = _col(x).try_cast("double")
    fits = d >= least if inclusive else d > least
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")) & fits, d)


def money(x: Column | str) -> Column:
    """struct(value, lower_bound) of price texts such as $1,299.00 and from $20."""
    text = F.lower(F.trim(_col(x).cast("string")))
    number = F.regexp_extract(text, r"^(?:from\s+)?\$?\s*((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)$", 1)
    return F.struct(finite(F.regexp_replace(number, ",", "")).alias("value"), text.startswith("from").alias("lower_bound"))


def hash_order(*parts: Column | str) -> Column:
    """A deterministic ordering key: sha2 over parts joined by a zero byte."""
    return F.sha2(F.concat_ws("\0", *[_col(p).cast("string") if not isinstance(p, str) else F.col(p).cast("string") for p in parts]), 256)


# Words that open a request, and departments that may stand before a category.
REQUESTS = "show me; find; find me; i want; i need; i would like; i am looking for; looking for"
DEPARTMENTS = "men women mens womens boys girls kids unisex".split()


def category_terms(x: Column | str) -> Column:
    """Singular words of a category text, without stop words."""
    return F.transform(terms(x), singular)


def asserted_category(message: Column, names: list[str]) -> Column:
    """struct(name, rest): the known category, the longest that fits, which a request begins with, singular or plural and behind articles and departments; and what follows it.  Null where none does."""
    opened = F.regexp_replace(F.lower(F.trim(message)), "^(?:" + "|".join(r.replace(" ", r"\s+") for r in sorted(REQUESTS.split("; "), key=len, reverse=True)) + r")\s+", "")
    bare = F.regexp_replace(opened, rf"^(?:(?:a|an|the|some|{'|'.join(DEPARTMENTS)})\s+)+", "")
    found = F.lit(None).cast("struct<name:string,rest:string>")
    for name in sorted(names, key=lambda n: (len(n), n)):
        stem = name[:-1] if name.endswith("s") else name
        pattern = rf"^\Q{stem}\E(?:s|es)?\b"
        rest = F.btrim(F.regexp_replace(bare, pattern, ""), F.lit(" ,.;!?"))
        found = F.when(bare.rlike(pattern) & (opened != F.lower(F.trim(message))), F.struct(F.lit(name).alias("name"), rest.alias("rest"))).otherwise(found)
    return found


def category_choices(x: Column | str) -> Column:
    """The alternatives of a category text joined by 'or', each as singular words."""
    return F.filter(F.transform(F.split(_col(x), r"(?i)\s+or\s+"), category_terms), lambda c: F.size(c) > 0)
