"""Offline evaluation: session metrics, recall, latency, calibration, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

MISS_TURN = 11


def session_metrics() -> list[Column]:
    """Aggregates over outcomes (hit, first_hit_turn, reciprocal_rank): hit rate, MRR, turns to completion, technical score."""
    hr, mrr = F.avg(F.col("hit").cast("double")), F.avg("reciprocal_rank")
    turns = F.avg(F.coalesce(F.col("first_hit_turn"), F.lit(MISS_TURN)).cast("double"))
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (MISS_TURN - turns) / 10))
    score = 0.5 * hr + 0.3 * mrr + 0.2 * efficiency
    return [F.count(F.lit(1)).alias("sessions"), F.round(hr, 6).alias("hit_rate"), F.round(mrr, 6).alias("mrr"), F.round(turns, 6).alias("mean_turns"), F.round(efficiency, 6).alias("efficiency"), F.round(score, 6).alias("technical_score")]


def by_scenario(outcomes: DataFrame) -> DataFrame:
    """Overall (scenario 'all') and per scenario, in one pass."""
    out = outcomes.rollup("scenario_type").agg(F.grouping("scenario_type").alias("g"), *session_metrics())
    return out.withColumn("scenario_type", F.when(F.col("g") == 1, "all").otherwise(F.col("scenario_type"))).drop("g")


def at_places(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]], *, cuts: int = 64) -> DataFrame:
    """(group, n, a value for each name): the values at places (from 0, as functions of the group's size n) of each group's sorted values.

    Approximate quantiles cut a group into ranges, exact counts by range tell where a place lies, and only ranges with a
    place are sorted; so no task sorts a whole group.  Nulls are left out.
    """
    known = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).alias("__v"))
    bounds = known.groupBy("__g").agg(F.array_distinct(F.percentile_approx("__v", F.array(*[F.lit((i + 1) / cuts) for i in range(cuts - 1)]), 10_000)).alias("__cuts"))
    g2 = bounds.select(F.col("__g").alias("__g2"), "__cuts")
    ranged = known.join(g2, F.col("__g").eqNullSafe(F.col("__g2"))).select("__g", "__v", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__r"))
    counts = ranged.groupBy("__g", "__r").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("__g")
    spans = counts.withColumn("n", F.sum("c").over(w)).withColumn("start", F.sum("c").over(w.orderBy("__r")) - F.col("c"))
    wanted = spans.withColumn("at", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("i")) for name, place in places.items()])))
    hit = wanted.filter((F.col("at.i") >= F.col("start")) & (F.col("at.i") < F.col("start") + F.col("c"))).select(F.col("__g").alias("__g2"), F.col("__r").alias("__r2"), "n", F.col("at.name").alias("name"), (F.col("at.i") - F.col("start") + 1).alias("place"))
    few = hit.select("__g2", "__r2").distinct()
    kept = ranged.join(few, F.col("__g").eqNullSafe(F.col("__g2")) & (F.col("__r") == F.col("__r2")), "left_semi")
    sorted_ = kept.withColumn("i", F.row_number().over(Window.partitionBy("__g", "__r").orderBy("__v")))
    found = sorted_.join(hit, F.col("__g").eqNullSafe(F.col("__g2")) & (F.col("__r") == F.col("__r2")) & (F.col("i") == F.col("place")))
    return found.groupBy(F.col("__g").alias(group)).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in places])


def percentile_at(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at place int(share * n) of the sorted rows, not interpolated."""
    return at_places(rows, group, value, {name: (lambda n, share=share: F.least(n - 1, F.floor(n * share))) for name, share in shares.items()})


def recall_at(ranked: DataFrame, truth: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """(n_queries, recall_k ...): share of queries whose wanted document (query_id, doc_id) is in the first k."""
    found = truth.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    one = found.groupBy("query_id").agg(*[F.max(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"r{k}") for k in depths])
    return one.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(f"r{k}"), 9).alias(f"recall_{k}") for k in depths])


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(brier, log_loss, ece) of rows (p, label)."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), (-F.avg(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))).alias("log_loss"))
    each = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("mean_y"))
    ece = each.agg(F.sum(F.col("c") * F.abs(F.col("mean_p") - F.col("mean_y"))).alias("gap"), F.sum("c").alias("all"))
    return total.crossJoin(ece).select(F.round("brier", 9).alias("brier"), F.round("log_loss", 9).alias("log_loss"), F.round(F.col("gap") / F.col("all"), 9).alias("ece"))  # one row each


def macro_f1(rows: DataFrame) -> DataFrame:
    """(class, tp, predicted, actual, precision, recall, f1) of rows (label, pred)."""
    votes = rows.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("label") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("v")).select("v.*")
    g = votes.groupBy(F.col("c").alias("class")).agg(F.sum("t").alias("tp"), F.sum("p").alias("predicted"), F.sum("a").alias("actual"))
    prec, rec = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0))
    return g.select("class", "tp", "predicted", "actual", F.round(prec, 9).alias("precision"), F.round(rec, 9).alias("recall"), F.round(F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)), 9).alias("f1"))


def bootstrap_interval(deltas: DataFrame, *, resamples: int, seed: int, slots: int = 1) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean paired difference by the Poisson bootstrap.

    Every (row, resample) draws its count from a hash of both, so partitions
    never matter, and sums combine map-side: one row a resample is shuffled.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", "id"), F.lit(1_000_003)) + 0.5) / 1_000_003
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    n = sum((u > c).cast("int") for c in cuts)
    draws = deltas.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("n", n)
    means = draws.groupBy("b").agg((F.sum(F.col("delta") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def stage_of(flags: list[tuple[str, str]], final: str) -> Column:
    """The first stage whose flag is false; final when all hold.  flags: (column, stage)."""
    out = F.lit(final)
    for column, stage in reversed(flags):
        out = F.when(~F.coalesce(F.col(column), F.lit(False)), F.lit(stage)).otherwise(out)
    return out


def slot_quality(expected: DataFrame, proposed: DataFrame) -> DataFrame:
    """(arm, tp, fp, fn, precision, recall) of slots (arm, case_id, attribute, value); nothing proposed is precision 1, nothing expected recall 0."""
    keys = ["arm", "case_id", "attribute", "value"]
    e, p = expected.select(*keys).distinct().withColumn("e", F.lit(1)), proposed.select(*keys).distinct().withColumn("p", F.lit(1))
    g = e.join(p, keys, "full").groupBy("arm").agg(F.sum(F.when(F.col("e").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("e").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("fn"))
    return g.select("arm", "tp", "fp", "fn", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"))


def run_differences(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field): turns where two runs differ; a turn of one run only differs in 'presence'."""
    j = a.select(*keys, F.struct(*fields).alias("x")).join(b.select(*keys, F.struct(*fields).alias("y")), keys, "full")
    names = F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in fields])
    one = F.col("x").isNull() | F.col("y").isNull()
    return j.select(*keys, F.explode(F.when(one, F.array(F.lit("presence"))).otherwise(F.filter(names, lambda n: n.isNotNull()))).alias("field"))


def scorer_agreement(a: DataFrame, b: DataFrame, k: int = 30) -> DataFrame:
    """(queries, max_delta, same_order, overlap_k) of two scorings (query_id, doc_id, score)."""
    w = Window.partitionBy("query_id")
    j = a.select("query_id", "doc_id", F.col("score").alias("x")).join(b.select("query_id", "doc_id", F.col("score").alias("y")), ["query_id", "doc_id"])
    r = j.withColumn("rx", F.row_number().over(w.orderBy(F.desc("x"), "doc_id"))).withColumn("ry", F.row_number().over(w.orderBy(F.desc("y"), "doc_id")))
    q = r.groupBy("query_id").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("d"), F.bool_and(F.col("rx") == F.col("ry")).alias("same"), (F.sum(((F.col("rx") <= k) & (F.col("ry") <= k)).cast("int")) / F.least(F.lit(k), F.count(F.lit(1)))).alias("o"))
    return q.agg(F.count(F.lit(1)).alias("queries"), F.max("d").alias("max_delta"), F.sum(F.col("same").cast("int")).alias("same_order"), F.avg("o").alias("overlap_k"))


def exposure_status(receipts: DataFrame) -> DataFrame:
    """(dataset, status) of receipts (dataset, kind): consumed outranks attempt_recorded, which outranks unknown."""
    g = receipts.groupBy("dataset").agg(F.bool_or(F.col("kind") == "consumed").alias("c"), F.bool_or(F.col("kind") == "attempt").alias("a"))
    return g.select("dataset", F.when(F.col("c"), "consumed").when(F.col("a"), "attempt_recorded").otherwise("unknown").alias("status"))


def power(effect: float, deviation: float, n: int, alpha_z: float = 1.959963984540054) -> float:
    """Power of a two-sided paired test by the normal approximation."""
    import math

    z = abs(effect) / (deviation / math.sqrt(n)) if deviation > 0 and n > 0 else 0.0
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    return cdf(z - alpha_z) + cdf(-z - alpha_z)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution by the rational approximation of Abramowitz and Stegun (26.2.17), right to 7.5e-8."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    series = F.lit(1.330274429)
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = F.lit(c) + t * series
    tail = F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * t * series
    return F.when(z < 0, tail).otherwise(1 - tail)


def power_of(effect: str, deviation: str, n: str, alpha_z: float = 1.959963984540054) -> Column:
    """Power of a two-sided paired test by the normal approximation, of columns; null where nothing deviates."""
    z = F.when(F.col(deviation) > 0, F.abs(effect) / (F.col(deviation) / F.sqrt(n)))
    return normal_cdf(z - alpha_z) + normal_cdf(-z - alpha_z)


def variant_overlap(ranks: DataFrame, depth: int = 120, top: int = 10) -> DataFrame:
    """(query_id, jaccard, overlap) of two rankings (query_id, doc_id, ra, rb): of the first depth places, and the share of the first top that both hold."""
    both = lambda k, op: F.sum(op(F.coalesce(F.col("ra") <= k, F.lit(False)), F.coalesce(F.col("rb") <= k, F.lit(False))).cast("int"))
    g = ranks.groupBy("query_id").agg(both(depth, lambda a, b: a & b).alias("i"), both(depth, lambda a, b: a | b).alias("u"), both(top, lambda a, b: a & b).alias("t"))
    return g.select("query_id", (F.col("i") / F.greatest("u", F.lit(1))).alias("jaccard"), (F.col("t") / F.lit(top)).alias("overlap"))


def variant_correlation(scores: DataFrame) -> DataFrame:
    """(query_id, n, pearson) of two scores of the same candidates (query_id, doc_id, a, b): null where a score does not vary or fewer than two candidates have both."""
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return scores.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.when(spread > 0, F.covar_pop("a", "b") / F.nullif(spread, F.lit(0.0))).alias("pearson"))


def rule_search(rows: DataFrame, grid: list[dict[str, float]], *, folds: int = 5) -> DataFrame:
    """(setting, accuracy, worst_fold) of every setting of rule weights on rows (group, label 0/1, features): the share of right decisions, and of the worst fold; a score over 0.5 says 1.

    Folds are dealt by a hash of group, so rows of a group stay together.  The grid is a literal beside the rows: one pass.
    """
    names = sorted(grid[0])
    settings = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), *[F.lit(float(g[n])).alias(n) for n in names]) for i, g in enumerate(grid)]))
    s = rows.withColumn("s", settings)
    score = sum((F.col(f"s.{n}") * F.col(n).cast("double") for n in names), F.lit(0.0))
    right = ((score > 0.5).cast("int") == F.col("label")).cast("double")
    fold = s.select("s.setting", F.pmod(F.xxhash64("group"), F.lit(folds)).alias("fold"), right.alias("r")).groupBy("setting", "fold").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
    return fold.groupBy("setting").agg(F.round(F.sum("r") / F.sum("n"), 9).alias("accuracy"), F.round(F.min(F.col("r") / F.col("n")), 9).alias("worst_fold"))


def f1_of_counts(counts: dict[tuple, int]) -> float:
    """Mean F1 over the labels of counts by (label, said), 0 for a label that is neither given nor said."""
    labels = {label for pair in counts for label in pair}
    scores = []
    for x in labels:
        hit = counts.get((x, x), 0)
        miss = sum(n for (a, b), n in counts.items() if (a == x) != (b == x))
        scores.append(2 * hit / (2 * hit + miss) if hit else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def coordinate_search(rows: DataFrame, decide: Callable[[dict[str, Column]], Column], start: dict[str, float], grid: list[float], *, sweeps: int = 8, label: str = "label", fold: str = "fold") -> tuple[dict[str, float], float]:
    """(settings, cross-validated macro F1): settings improved one after the other over a grid until a sweep changes none, or sweeps are done.

    decide gives the label that settings (columns by name) say of a row.  Each step is one aggregate: all values of the grid at once, counted by
    fold, label and decision, which is all that macro F1 needs, and so few rows that the driver compares them.  Ties go to the better F1 over all rows, then to the
    value nearest to the one held, then to the smaller.
    """
    held, score = dict(start), 0.0
    for _ in range(sweeps):
        before = dict(held)
        for name in start:
            tried = rows.withColumn("__value", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
            said = decide({n: F.col("__value") if n == name else F.lit(float(v)) for n, v in held.items()})
            counts: dict[float, dict] = {}
            for r in tried.groupBy("__value", fold, label, said.alias("__said")).agg(F.count(F.lit(1)).alias("n")).collect():  # grid x folds x labels^2 rows at most
                counts.setdefault(r["__value"], {}).setdefault(r[fold], {})[(r[label], r["__said"])] = r["n"]

            def rank(value):
                folds = counts[value]
                whole: dict[tuple, int] = {}
                for c in folds.values():
                    for k, n in c.items():
                        whole[k] = whole.get(k, 0) + n
                return (round(sum(map(f1_of_counts, folds.values())) / len(folds), 9), round(f1_of_counts(whole), 9), -abs(value - held[name]), -value)

            if counts:
                best = max(counts, key=rank)
                score = rank(best)[0]
                held[name] = best
        if held == before:
            break
    return held, score


def model_comparison(runs: DataFrame, baseline: str) -> DataFrame:
    """(model, score, delta, pairs, assets) of runs (model, score, pairs, assets): each model's mean score against the baseline's, and its largest costs."""
    g = runs.groupBy("model").agg(F.avg("score").alias("score"), F.max("pairs").alias("pairs"), F.max("assets").alias("assets"))
    base = F.max(F.when(F.col("model") == baseline, F.col("score"))).over(Window.partitionBy(F.lit(1)))  # a row a model
    return g.select("model", F.round("score", 9).alias("score"), F.round(F.col("score") - base, 9).alias("delta"), "pairs", "assets")


def check_tallies(checks: DataFrame) -> DataFrame:
    """(group, passed, failed, unknown, all_passed) of authored checks (group, ok); null is unknown and passes nothing."""
    return checks.groupBy("group").agg(F.count(F.when(F.col("ok"), 1)).alias("passed"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.count(F.when(F.col("ok").isNull(), 1)).alias("unknown"), (F.count(F.when(F.coalesce(~F.col("ok"), F.lit(True)), 1)) == 0).alias("all_passed"))


def gates(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """metrics with admitted, and the names of the bounds that a run breaks; an unknown metric breaks its bound."""
    broken = F.array(*[F.when(~F.coalesce(F.col(n) >= v, F.lit(False)), F.lit(n)) for n, v in least.items()], *[F.when(~F.coalesce(F.col(n) <= v, F.lit(False)), F.lit(n)) for n, v in most.items()])
    names = F.filter(broken, lambda x: x.isNotNull())
    return metrics.withColumn("broken", names).withColumn("admitted", F.size(names) == 0)
