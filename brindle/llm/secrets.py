"""Secret scans built from SQL functions only.

Base kinds (assign, access, hex) are regular expressions; their spans come from
the pieces between matches.  The method adds entropy spans: over candidate
strings a window slides one character at a time, the counts of the characters
in it are kept incrementally (one leaves, one enters), and with them the sum of
c*log2(c), from which the window's Shannon entropy follows.  A candidate whose
highest window entropy reaches the threshold of its character class is a span,
unless the allow-list suppresses it.

Work is linear in the text: candidates are cut into characters once, patterns
repeat groups possessively (Java's engine recurses on other repeated groups), and
lists of spans are summed up in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

# The base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
BLOCK = 64  # spans summed up in one go
#: character class -> least window entropy in bits (a window of 20 has at most 4.32)
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "alnum": (r"^[A-Za-z0-9]+$", 3.7), "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.8)}
#: suppressed candidates: no digit at all, words joined by - _ /, UUIDs, dates and file-like paths, placeholders
ALLOW = (
    r"^[^0-9]*$",
    r"^[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+[-_/=+]?[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/_=+-]+$",
    r"(?i)example|placeholder|xxxxx|00000|12345678",
)
_SPANS = "array<struct<m:string,s:int,e:int>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.transform(F.array(value), then)[0]


def _spans(text: Column, pattern: str) -> Column:
    """Matches of pattern as structs (text, start, end) in code points, leftmost first and not overlapping.

    The text between matches gives the places: a running sum over the lengths of gaps and
    matches, inside blocks of matches first and over the blocks' sums next, so that no long list is copied at each of its steps.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)

    def lay(pairs: Column) -> Column:
        shape = f"struct<at:int,out:{_SPANS}>"
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")).cast(shape)

        def step(acc, x):
            s = acc["at"] + F.length(x["gap"])
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out")).cast(shape)

        return F.aggregate(pairs, start, step)

    def shifted(blocks: Column) -> Column:
        """The blocks' spans behind one another; blocks of blocks keep the lists of sums short."""
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = F.transform(blocks, lambda b, i: F.struct(b["out"].alias("out"), i.alias("i")))
        return _let(ends, lambda at: F.flatten(F.transform(moved, lambda b: F.transform(b["out"], lambda x: F.struct(x["m"].alias("m"), (x["s"] + at[b["i"]]).alias("s"), (x["e"] + at[b["i"]]).alias("e"))))))

    def placed(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))
        return _let(F.transform(firsts, lambda f: lay(F.slice(pairs, f, F.lit(BLOCK)))), shifted)

    zipped = F.arrays_zip(hits.alias("m"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(zipped, placed)).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def max_window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any window-long piece of text; of the whole text if that is shorter.

    Each step sees the character that enters and the one that leaves, window places before.
    """
    shape = "struct<n:map<string,int>,s:double,i:int,best:double>"
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(1e9).alias("best")).cast(shape)
    clog = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    got = lambda n, ch: F.coalesce(F.try_element_at(n, ch), F.lit(0))

    def put(n, ch, c):
        return F.map_concat(F.map_filter(n, lambda k, v: k != ch), F.map_from_arrays(F.array(ch), F.array(c.cast("int"))))

    def step(acc, x):
        ch, gone = x["ch"], x["gone"]
        full = gone.isNotNull()
        moves = ~full | (gone != ch)
        less, more = F.when(full & moves, got(acc["n"], gone)), F.when(moves, got(acc["n"], ch))
        n = F.when(full & moves, put(acc["n"], gone, less - 1)).otherwise(acc["n"])
        n = F.when(moves, put(n, ch, more + 1)).otherwise(n)
        n = F.when(full & moves & (less <= 1), F.map_filter(n, lambda k, v: v > 0)).otherwise(n)
        s = acc["s"] + F.coalesce(clog(less - 1) - clog(less), F.lit(0.0)) + F.coalesce(clog(more + 1) - clog(more), F.lit(0.0))
        i = acc["i"] + 1
        best = F.when(i >= window, F.least(acc["best"], s)).otherwise(acc["best"])
        return F.struct(n.alias("n"), s.alias("s"), i.alias("i"), best.alias("best")).cast(shape)

    def done(a):
        width = F.least(a["i"], F.lit(window)).cast("double")
        s = F.when(a["best"] < 1e8, a["best"]).otherwise(a["s"])
        return F.when(width > 0, F.log2(width) - s / width).otherwise(F.lit(0.0))

    def slide(chars: Column) -> Column:
        before = F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), window), chars), F.lit(1), F.size(chars))
        return F.aggregate(F.arrays_zip(chars.alias("ch"), before.alias("gone")), start, step, done)

    return _let(F.filter(F.split(text, ""), lambda c: c != ""), slide)


def _suspect(m: Column, allow: tuple[str, ...], window: int) -> Column:
    ok = F.lit(False)
    for pattern in allow:
        ok = ok | m.rlike(pattern)
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(m.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(ok, F.lit(False)).otherwise(max_window_entropy(m, window) >= least)


def _meets(spans: Column, x: Column) -> Column:
    """Whether x overlaps one of spans, which are sorted and apart: a binary search for the first that ends behind x's start."""
    halve = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int") + 1)

    def step(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        left = F.get(spans, middle)["e"] > x["s"]
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & ~left, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & left, middle).otherwise(acc["hi"]).alias("hi"))

    first = F.aggregate(halve, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), step, lambda a: a["lo"])
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, first)["s"] < x["e"], F.lit(False))


def _tagged(spans: str, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value")))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> DataFrame:
    """docs with a column secrets: array of (kind, start, end, value), sorted by start, then kind as listed.

    Places are code points with the end exclusive.  Null and empty texts have
    none; repeated rows are scanned each; overlapping spans of different kinds all stay, and an entropy
    candidate that lies in a base span adds nothing.  Every document
    is settled where it is read: nothing is shuffled, and an empty table gives no rows.  An input
    column named secrets is replaced; all others pass through, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    a, k, h, e = fresh(docs.columns, "assign", "access", "hex", "entropy")
    assign = F.filter(_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = docs.withColumn(a, assign).withColumn(k, _spans(text, ACCESS)).withColumn(h, _spans(text, HEX))
    # keys and hex strings consist of a candidate's characters, so one that meets a candidate lies in it
    free = F.filter(_spans(text, CANDIDATE), lambda x: ~x["m"].rlike(HEX) & ~x["m"].rlike(ACCESS) & ~_meets(F.col(a), x))
    full = base.withColumn(e, F.filter(free, lambda x: _suspect(x["m"], allow, window)))
    shape = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
    tagged = [_tagged(c, i, kind).cast(shape) for i, (c, kind) in enumerate(zip((a, k, h, e), KINDS))]
    out = F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["value"].alias("value")))
    return full.select(*[F.col(c) for c in docs.columns if c != "secrets"], out.alias("secrets"))
