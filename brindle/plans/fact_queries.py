"""The ledger of facts over the given conversations.  Their prose is invented, so its own commonest words stand for values and cues."""

from pyspark.sql import functions as F

from ..operators import facts
from ..streaming import transactions, windows
from .registry import _shared, query, table

VALUES = {"material": "of is de von", "color": "and der und la", "style": "was that en es", "feature": "it this are den", "other": "for on les los", "category": "be with que an"}
CUES = facts.Cues(denial=("in", "die", "le"), neutral=("as", "by", "er"), relaxed=("at", "re", "ed"), quantities=("the", "ha", "th", "of"), additive=("to", "des"), replacement=("a", "un", "zu"))


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _array(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STATEMENTS = rf"""v(word, attribute) AS (VALUES {", ".join(f"('{w}', '{a}')" for a, listed in VALUES.items() for w in listed.split())}),
    p AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '[.;!?\n]+')) AS said, generate_subscripts(string_split_regex(lower(text), '[.;!?\n]+'), 1) AS clause FROM src WHERE text IS NOT NULL),
    c AS (SELECT conv_id, turn, clause, regexp_extract_all(said, '[\pL\pN_]+') AS w FROM p),
    e AS (SELECT conv_id, turn, clause, unnest(w) AS word, generate_subscripts(w, 1) AS place, list_has_any(w, {_array(CUES.additive)}) AS additive, list_has_any(w, {_array(CUES.replacement)}) AS replacement FROM c),
    n AS (SELECT *, lag(word) OVER o AS prior, lead(word) OVER o AS next, min(CASE WHEN word IN {_list(CUES.denial)} THEN place END) OVER (PARTITION BY conv_id, turn, clause) AS denied FROM e WINDOW o AS (PARTITION BY conv_id, turn, clause ORDER BY place)),
    m AS (SELECT n.*, attribute, coalesce(next IN {_list(CUES.neutral)}, FALSE) AS neutral, coalesce(next IN {_list(CUES.relaxed)}, FALSE) AS relaxed, CASE WHEN coalesce(denied < place, FALSE) THEN -1 ELSE 1 END AS pol FROM n JOIN v USING (word)),
    s AS (SELECT conv_id, turn, clause, place, attribute, CASE WHEN neutral THEN 'any' ELSE word END AS value, CASE WHEN neutral OR relaxed THEN 0 ELSE pol END AS polarity, additive, replacement, NULL::VARCHAR AS oa, NULL::VARCHAR AS ov FROM m
        UNION ALL SELECT conv_id, turn, clause, place, 'other', prior || ' ' || word, pol, additive, replacement, attribute, word FROM m WHERE prior IN {_list(CUES.quantities)} AND NOT neutral)"""


def _fold(mode: str) -> str:
    """One step after the other: each takes the list of facts so far, ends some, adds its own, and lets fall what hangs on nothing."""
    step = "turn, clause" if mode == "ledger" else "turn"
    trim = "any_at IS NULL OR spot > any_at OR (spot = any_at AND value = 'any' AND last_at = any_at)" if mode != "history" else "TRUE"
    same = "f.attribute = i.attribute AND f.value = i.value"
    exists = lambda condition: f"len(list_filter(items, lambda i: {condition})) > 0"
    ends = {
        "history": exists(f"{same} AND f.polarity = i.polarity AND f.ov IS NOT DISTINCT FROM i.ov AND f.oa IS NOT DISTINCT FROM i.oa"),
        "latest": exists("f.attribute = i.attribute"),
        "ledger": " OR ".join([
            exists(same), exists("f.attribute = i.attribute AND i.value = 'any' AND i.polarity = 0"), f"(f.polarity = 1 AND {exists('f.attribute = i.attribute AND i.slot')})", f"(f.value = 'any' AND f.polarity = 0 AND {exists('f.attribute = i.attribute')})",
            f"(f.ov IS NOT NULL AND {exists('f.attribute = i.attribute AND f.oa = i.oa AND f.ov = i.ov')})",
            "(f.attribute = 'other' AND f.polarity = 1 AND " + exists("i.attribute = 'other' AND i.polarity = -1 AND contains(' ' || f.value || ' ', ' ' || i.value || ' ')") + ")",
        ]),
    }[mode]
    put = lambda f, until: f"{{'attribute': {f}.attribute, 'value': {f}.value, 'polarity': {f}.polarity, 'oa': {f}.oa, 'ov': {f}.ov, 'since': {f}.since, 'until': {until}}}"
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), {STATEMENTS},
    t AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY {step}) AS k, clause * 100000 + place AS spot FROM s),
    g AS (SELECT *, bool_or(replacement) OVER x AS replaces, bool_or(additive) OVER x AND NOT bool_or(replacement) OVER x AS adds, max(CASE WHEN value = 'any' AND polarity = 0 THEN spot END) OVER x AS any_at, max(spot) OVER x AS last_at FROM t WINDOW x AS (PARTITION BY conv_id, k, attribute)),
    h AS (SELECT *, bool_or(polarity = 1) OVER x AND NOT adds AND attribute NOT IN {_list(facts.OPEN)} AND (attribute NOT IN {_list(facts.STICKY + ("",))} OR (replaces AND NOT bool_or(polarity = -1) OVER x)) AS slot FROM g WHERE {trim} WINDOW x AS (PARTITION BY conv_id, k, attribute)),
    items AS (SELECT conv_id, k, max(turn) AS turn, list(DISTINCT {{'attribute': attribute, 'value': value, 'polarity': polarity, 'oa': oa, 'ov': ov, 'slot': slot}}) AS items FROM h GROUP BY 1, 2),
    fold AS (
        SELECT conv_id, 0::BIGINT AS k, CAST([] AS STRUCT(attribute VARCHAR, value VARCHAR, polarity INTEGER, oa VARCHAR, ov VARCHAR, since BIGINT, until BIGINT)[]) AS facts FROM (SELECT DISTINCT conv_id FROM items)
        UNION ALL
        SELECT conv_id, k, list_transform(facts, lambda f: {put("f", "CASE WHEN f.until IS NULL AND f.ov IS NOT NULL AND f.polarity = 1 AND len(list_filter(facts, lambda o: o.until IS NULL AND o.polarity = 1 AND o.ov IS NULL AND o.attribute = f.oa AND o.value = f.ov)) = 0 THEN turn ELSE f.until END")})
        FROM (SELECT fold.conv_id, i.k, i.turn, list_concat(list_transform(facts, lambda f: {put("f", f"CASE WHEN f.until IS NULL AND ({ends}) THEN i.turn ELSE f.until END")}), list_transform(items, lambda n: {put("n", "NULL::BIGINT").replace("n.since", "i.turn")})) AS facts FROM fold JOIN items i ON i.conv_id = fold.conv_id AND i.k = fold.k + 1)),
    last AS (SELECT conv_id, unnest(arg_max(facts, k)) AS f FROM fold GROUP BY 1)
    SELECT conv_id AS session_id, f.attribute AS attribute, f.value AS value, f.polarity AS polarity, f.oa AS owner_attribute, f.ov AS owner_value, f.since AS since, f.until AS until FROM last"""


def _versions(spark, sf_dir, mode: str):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", "text")
    known = spark.createDataFrame([(w, a, w) for a, listed in VALUES.items() for w in listed.split()], "word string, attribute string, value string")
    return facts.versions(facts.statements(c, known, CUES), mode).drop("version")


@query(_fold("ledger"))
def fact_ledger(spark, sf_dir):
    """Versions of every fact by clause: replaced, extended, denied, relaxed and released values, and quantities that fall with what they count."""
    return _versions(spark, sf_dir, "ledger")


@query(_fold("latest"))
def fact_latest(spark, sf_dir):
    """The mode in which a turn's statements about an attribute replace all before."""
    return _versions(spark, sf_dir, "latest")


@query(_fold("history"))
def fact_history(spark, sf_dir):
    """The mode in which nothing but a repetition ends a fact."""
    return _versions(spark, sf_dir, "history")


MOST = 7  # a turn that leaves more facts fails

_SENT = "SELECT conv_id, turn * 10 + j AS seq, turn + 1 AS turn, CASE j WHEN 0 THEN NULL WHEN 3 THEN 'x ' || text ELSE text END AS message FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE role = 'user' AND (j = 1 OR (j = 0 AND (conv_id + turn) % 4 = 0) OR (j = 2 AND (conv_id + turn) % 3 = 0) OR (j = 3 AND (conv_id + turn) % 5 = 0))"


@query(rf"""WITH RECURSIVE sent AS ({_SENT}), src AS (SELECT conv_id, seq AS turn, message AS text FROM sent), {STATEMENTS},
    g AS (SELECT *, turn AS seq, clause * 100000 + place AS spot, max(CASE WHEN value = 'any' AND polarity = 0 THEN clause * 100000 + place END) OVER x AS any_at, max(clause * 100000 + place) OVER x AS last_at FROM s WINDOW x AS (PARTITION BY conv_id, turn, attribute)),
    it AS (SELECT conv_id, seq, list(DISTINCT {{'attribute': attribute, 'value': value, 'polarity': polarity, 'oa': oa, 'ov': ov}}) AS items FROM g WHERE any_at IS NULL OR spot > any_at OR (spot = any_at AND value = 'any' AND last_at = any_at) GROUP BY 1, 2),
    r AS (SELECT conv_id, seq, turn, message, sha256(coalesce(message, '')) AS digest, coalesce(items, []) AS items, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS k FROM sent LEFT JOIN it USING (conv_id, seq)),
    run AS (
        SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS turn, '' AS status, NULL::INT AS facts, NULL::VARCHAR AS answer, -1::BIGINT AS last_turn, '' AS last_digest, NULL::INT AS last_n, NULL::VARCHAR AS last_answer, CAST([] AS STRUCT(attribute VARCHAR, value VARCHAR, polarity INTEGER, oa VARCHAR, ov VARCHAR)[]) AS held FROM (SELECT DISTINCT conv_id FROM sent)
        UNION ALL
        SELECT conv_id, k, seq, turn, status, CASE status WHEN 'committed' THEN len(staged) WHEN 'cached' THEN last_n END::INT, CASE status WHEN 'committed' THEN ans WHEN 'cached' THEN last_answer END,
            CASE status WHEN 'committed' THEN turn ELSE last_turn END, CASE status WHEN 'committed' THEN digest ELSE last_digest END, CASE status WHEN 'committed' THEN len(staged) ELSE last_n END::INT, CASE status WHEN 'committed' THEN ans ELSE last_answer END, CASE status WHEN 'committed' THEN staged ELSE held END
        FROM (SELECT *, sha256(array_to_string(list_sort(list_transform(staged, lambda f: f.attribute || '|' || f.value || '|' || f.polarity || '|' || coalesce(f.oa, '') || '|' || coalesce(f.ov, ''))), chr(10))) AS ans,
                CASE WHEN message IS NOT NULL AND turn = last_turn AND digest = last_digest THEN 'cached' WHEN turn <= last_turn THEN 'rejected' WHEN message IS NULL OR len(staged) > {MOST} THEN 'failed' ELSE 'committed' END AS status
            FROM (SELECT *, list_filter(now, lambda f: f.polarity <> 1 OR f.ov IS NULL OR len(list_filter(now, lambda o: o.polarity = 1 AND o.ov IS NULL AND o.attribute = f.oa AND o.value = f.ov)) > 0) AS staged
                FROM (SELECT r.conv_id, r.k, r.seq, r.turn, r.message, r.digest, last_turn, last_digest, last_n, last_answer, held, list_concat(list_filter(held, lambda f: len(list_filter(items, lambda i: i.attribute = f.attribute)) = 0), items) AS now FROM run JOIN r ON r.conv_id = run.conv_id AND r.k = run.k + 1))))
    SELECT conv_id AS session_id, seq, turn::INT AS turn, status, facts, answer FROM run WHERE k > 0""")
def transactional_turns(spark, sf_dir):
    """The conversations as a keyed stream with repeated, changed, empty and overfull turns: every turn commits whole or not at all."""
    path = _shared(spark)
    c, j = table(spark, sf_dir, "conversations").filter("role = 'user'"), F.col("j")
    each = c.withColumn("j", F.explode(F.array(*map(F.lit, range(4))))).withColumn("at", F.col("conv_id") + F.col("turn"))
    sent = each.filter((j == 1) | ((j == 0) & (F.col("at") % 4 == 0)) | ((j == 2) & (F.col("at") % 3 == 0)) | ((j == 3) & (F.col("at") % 5 == 0)))
    message = F.when(j == 3, F.concat(F.lit("x "), "text")).when(j > 0, F.col("text"))
    rows = sent.select(F.col("conv_id").alias("session_id"), (F.col("turn") * 10 + j).alias("seq"), (F.col("turn") + 1).cast("int").alias("turn"), message.alias("message"))
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    settings = transactions.Settings(tuple((w, a, w) for a, listed in VALUES.items() for w in listed.split()), CUES, "latest", MOST)
    return transactions.run(transactions.transact(stream, settings), f"{path}-run")
