"""Known wording in whole texts, with offsets.  The given prose is invented, so its own commonest words stand for cues and denials."""

from pyspark.sql import functions as F

from ..operators import spans
from .registry import query, table

_W = r"[\p{L}\p{N}_]"
#: words of lower-cased documents (doc_id, i, word, what stands before it, its place from 0)
WORDS = r"""d AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(regexp_extract_all(low, '[\pL\pN_]+')) AS word, unnest(string_split_regex(low, '[\pL\pN_]+')) AS gap, generate_subscripts(string_split_regex(low, '[\pL\pN_]+'), 1) AS i FROM d),
    ws AS (SELECT doc_id, i, word, gap, (sum(length(gap)) OVER o + coalesce(sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start FROM e WHERE word IS NOT NULL WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""


def _said(words: str, rest: str = "") -> str:
    """RE2 has no word bounds beyond ASCII."""
    return rf"(?:^|[^\pL\pN_])(?:{words})(?:$|[^\pL\pN_]{rest})"


CUES = {"material": "de|der|of|an", "color": "la|the|die", "style": "los|on|von", "feature": "et|und|and|y", "category": "is|que|zu"}
DENIED, RELEASED, OCCUPIED = "to|des|mit", "in|en", ("it", "le", "el", "ist")
ATTRIBUTES = list(CUES)
_CUE_SQL = " OR ".join(rf"(attribute = '{a}' AND regexp_matches(win, '{_said(c)}'))" for a, c in CUES.items())


@query(rf"""WITH RECURSIVE {WORDS},
    b AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM benchmark),
    al AS (SELECT array_to_string(w[1:k], ' ') AS alias, k, min(item_id) AS item FROM b, (SELECT unnest([1, 2, 8]) AS k) WHERE len(w) >= k GROUP BY 1, 2 HAVING count(DISTINCT item_id) = 1),
    g AS (SELECT doc_id, i, word, regexp_full_match(gap, '[-\s]+') AS near FROM ws),
    v AS (SELECT doc_id, i, [word, CASE WHEN lead(near) OVER o THEN word || ' ' || lead(word) OVER o END, CASE WHEN bool_and(near) OVER n AND count(*) OVER n = 7 THEN word || ' ' || string_agg(word, ' ' ORDER BY i) OVER n END] AS said FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i), n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
    c AS (SELECT doc_id, i, k, alias, item FROM (SELECT doc_id, i, unnest(said) AS alias FROM v) JOIN al USING (alias)),
    best AS (SELECT doc_id, i, max(k) AS k, arg_max(alias, k) AS alias, arg_max(item, k) AS item FROM c GROUP BY 1, 2),
    nxt AS (SELECT a.doc_id, a.i, a.k, a.alias, a.item, min(n.i) AS next FROM best a LEFT JOIN best n ON n.doc_id = a.doc_id AND n.i >= a.i + a.k GROUP BY 1, 2, 3, 4, 5),
    pick AS (SELECT * FROM nxt WHERE (doc_id, i) IN (SELECT doc_id, min(i) FROM best GROUP BY 1) UNION ALL SELECT n.* FROM pick p JOIN nxt n ON n.doc_id = p.doc_id AND n.i = p.next),
    s AS (SELECT p.doc_id, p.alias, p.item, a.start, (z.start + length(z.word))::INT AS stop FROM pick p JOIN ws a ON a.doc_id = p.doc_id AND a.i = p.i JOIN ws z ON z.doc_id = p.doc_id AND z.i = p.i + p.k - 1),
    o AS (SELECT doc_id, start, start + length(word) AS stop FROM ws WHERE word IN {OCCUPIED}),
    f AS (SELECT s.*, ['{"', '".join(ATTRIBUTES)}'][item % 5 + 1] AS attribute, CASE WHEN item % 4 < 3 THEN 'object' ELSE 'part' END AS role, item % 3 < 2 AS state, low FROM s JOIN d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = s.doc_id AND s.start < o.stop AND s.stop > o.start)),
    t AS (SELECT *, substr(low, greatest(1, start - 47), stop + 32 - greatest(0, start - 48)) AS win, regexp_matches(substr(low, greatest(1, start - 31), start - greatest(0, start - 32)), '(?:^|[^\pL\pN_])(?:{DENIED})(?:$|[^\pL\pN_,;.!?][^,;.!?]*$)') AS denied, regexp_matches(substr(low, stop + 1, 24), '{_said(RELEASED)}') AS released FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM t WHERE NOT denied AND NOT released)
    SELECT doc_id, 'state' AS lane, start, stop AS "end", alias, attribute, 'item ' || item AS canonical, role FROM t WHERE state AND NOT denied AND (attribute <> 'category' OR role = 'object') AND ({_CUE_SQL})
    UNION ALL SELECT doc_id, 'expansion', start, stop, alias, attribute, 'item ' || item, role FROM r WHERE i <= 8""")
def alias_matches(spark, sf_dir):
    """The first one, two and eight words of benchmark items as aliases in whole documents: the lane that may change a session's state and the one that only widens its search."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"{_W}+"), 0)
    item = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.explode(F.array(*map(F.lit, (1, 2, 8)))).alias("k")).filter(F.size("w") >= F.col("k"))
    alias = item.groupBy(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("alias")).agg(F.min("item_id").alias("i"), F.count_distinct("item_id").alias("n")).filter("n = 1")
    known = alias.select("alias", F.get(F.array(*map(F.lit, ATTRIBUTES)), (F.col("i") % 5).cast("int")).alias("attribute"), F.concat(F.lit("item "), "i").alias("canonical"), F.when(F.col("i") % 4 < 3, "object").otherwise("part").alias("role"), (F.col("i") % 3 < 2).alias("state"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = spans.typed_facets(docs, {"connective": {w: w for w in OCCUPIED}}, id_col="doc_id").groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("occupied"))
    texts = docs.join(held, F.col("id") == F.col("doc_id"), "left").select(F.col("doc_id").alias("id"), "text", "occupied")
    wording = spans.Wording(denial=rf"\b(?:{DENIED})\b[^,;.!?]*$", release=rf"\b(?:{RELEASED})\b", cues={a: rf"\b(?:{c})\b" for a, c in CUES.items()})
    return spans.alias_spans(texts, known, occupied_col="occupied", wording=wording).withColumnRenamed("id", "doc_id")


NEGATIVE, UNCERTAIN, BREAKS = ("the", "la", "der", "no"), ("of", "de la", "und", "que"), ("and", "y")
CLAIMS = spans.Claims(negative=NEGATIVE, uncertain=UNCERTAIN, clause_words=BREAKS, denied_behind=r"\s*(?:is|de)\b")


def _one_of(words) -> str:
    return "|".join(w.replace(" ", r"\s+") for w in words)


WITNESSES = rf"""{WORDS},
    q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\pL\pN_]+')[1:2] AS p FROM benchmark),
    m AS (SELECT query_id, a.doc_id, a.start, (b.start + length(b.word))::INT AS stop FROM q JOIN ws a ON a.word = p[1] JOIN ws b ON b.doc_id = a.doc_id AND b.i = a.i + 1 AND b.word = p[2] WHERE len(p) = 2 AND regexp_full_match(b.gap, '\s+')),
    c AS (SELECT m.*, substr(text, start + 1, stop - start) AS own, regexp_replace(substr(low, greatest(1, start - 95), start - greatest(0, start - 96)), '^.*(?:[.;!?\n]|(?:^|[^\pL\pN_])(?:{_one_of(BREAKS)})($|[^\pL\pN_]))', '\1', 's') AS before, substr(low, stop + 1, 40) AS behind FROM m JOIN d USING (doc_id)),
    f AS (SELECT query_id, doc_id, start, stop AS "end", CASE WHEN regexp_matches(own, '[.;!?\n]') THEN 0 WHEN regexp_matches(before, '{_said(_one_of(NEGATIVE))}') OR regexp_matches(behind, '^\s*(?:is|de)(?:$|[^\pL\pN_])') THEN -1 WHEN regexp_matches(before, '{_said(_one_of(UNCERTAIN))}') THEN 0 ELSE 1 END AS status FROM c)"""


@query(f"WITH {WITNESSES} SELECT * FROM f")
def phrase_witnesses(spark, sf_dir):
    """Every place of a benchmark item's first two words in whole documents, and whether the clause asserts, denies or doubts it."""
    return _witnesses(spark, sf_dir)


def _witnesses(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"{_W}+"), 0)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).filter(F.size("w") >= 2).select("query_id", F.array_join(F.slice("w", 1, 2), " ").alias("phrase"))
    return spans.witnesses(table(spark, sf_dir, "documents").select("doc_id", "text"), asked, claims=CLAIMS)


@query(f"""WITH {WITNESSES}, n AS (SELECT count(*) AS n FROM documents), h AS (SELECT query_id, count(DISTINCT doc_id) AS docs FROM f GROUP BY 1),
    j AS (SELECT query_id, doc_id, min(start) FILTER (status = 1) AS start, min("end") FILTER (status = 1) AS "end" FROM f GROUP BY 1, 2 HAVING min(status) >= 0 AND max(status) = 1),
    s AS (SELECT query_id, doc_id, start, "end", round(0.08::DOUBLE * ln(1 + n / docs) / ln(1 + n), 9) AS bonus, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS i FROM j JOIN h USING (query_id), n WHERE docs <= least(64, greatest(1, floor(0.01::DOUBLE * n))))
    SELECT query_id, doc_id, start, "end", bonus FROM s WHERE i <= 32""")
def witnessed_phrases(spark, sf_dir):
    """Documents that a rare phrase admits because they assert it, with the place of the first witness."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    return spans.admitted(_witnesses(spark, sf_dir), n).withColumn("bonus", F.round("bonus", 9))


SYNONYMS = {"size": {"small": "s", "large": "l", "x large": "xl"}, "color": {"crimson": "red"}, "category": {"gadget": "gizmos", "widget": "gizmos"}}
_TYPED = spans.typed_aliases(synonyms=SYNONYMS)
_TYPED_SQL = ", ".join(f"('{a}', '{k}', '{v}')" for a, known in SYNONYMS.items() for k, v in known.items())
_VALUE_SQL = ", ".join(f"('{a}', '{v}')" for a, listed in spans.TYPED.items() for v in listed.split("; ") if " " not in v and "-" not in v)


@query(rf"""WITH v(attribute, canonical) AS (VALUES {_VALUE_SQL}), syn(attribute, alias, canonical) AS (VALUES {_TYPED_SQL}),
    al AS (SELECT attribute, canonical AS alias, canonical FROM v UNION SELECT attribute, CASE WHEN canonical SIMILAR TO '.*(ch|sh|ss|x)es' THEN left(canonical, -2) WHEN canonical SIMILAR TO '.*[^s]s' AND NOT canonical SIMILAR TO '.*(ies|ves)' THEN left(canonical, -1) ELSE canonical || 's' END, canonical FROM v WHERE NOT canonical SIMILAR TO '.*(ies|ves)'
        UNION SELECT attribute, replace(canonical, 'ies', 'ie'), canonical FROM v WHERE canonical LIKE '%ies' UNION SELECT attribute, replace(canonical, 'ies', 'y'), canonical FROM v WHERE canonical LIKE '%ies' UNION SELECT attribute, replace(canonical, 'ves', 'f'), canonical FROM v WHERE canonical LIKE '%ves' UNION SELECT attribute, alias, canonical FROM syn),
    one AS (SELECT attribute, alias, CASE WHEN bool_or(alias = canonical) THEN alias ELSE min(canonical) END AS canonical FROM al GROUP BY 1, 2),
    t AS (SELECT p_partkey AS id, p_name || ', ' || p_type AS text, regexp_extract_all(p_name || ', ' || p_type, '\w+') AS w FROM part), e AS (SELECT id, text, w[i] AS word, i, w FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t))
    SELECT id, attribute, canonical, word AS said, (instr(text, word) - 1)::INT AS start, (instr(text, word) - 1 + length(word))::INT AS "end", CASE WHEN lower(word) = canonical THEN 'canonical' ELSE 'alias' END AS provenance FROM e JOIN one ON alias = lower(word)""")
def typed_facets(spark, sf_dir):
    """Canonical values of every attribute in the catalog's titles and types, with the wording that stands for them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(", ", "p_name", "p_type").alias("text"))
    return spans.typed_facets(p, _TYPED)
