"""Training operators: logistic models on MLlib and pairwise ranking by distributed gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F


def admission_model(rows: DataFrame, features: Sequence[str], label: str, *, l2: float = 1.0, rounds: int = 100):
    """Standardised, class-balanced L2 logistic regression; the fitted pipeline scores with transform()."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).first()
    pos = n["pos"] or 0.0
    w = F.when(F.col(label) == 1, n["n"] / max(2 * pos, 1.0)).otherwise(n["n"] / max(2 * (n["n"] - pos), 1.0))
    weighted = rows.withColumn("__w", w).withColumn("__y", F.col(label).cast("double"))
    stages = [VectorAssembler(inputCols=list(features), outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=l2 / max(n["n"], 1), maxIter=rounds, standardization=False)]
    return Pipeline(stages=stages).fit(weighted)


def pairwise_ranker(pairs: DataFrame, features: Sequence[str], *, epochs: int = 25, rate: float = 0.5, l2: float = 0.01, clip: float = 8.0) -> list[float]:
    """Weights of a linear ranker by full-batch gradient steps of the pairwise logistic loss.

    pairs: one row a pair with the differences (better minus worse) of each
    feature.  Every epoch is one aggregate: the driver sees as many numbers as
    there are features.
    """
    weights = [0.0] * len(features)
    for _ in range(epochs):
        margin = sum((F.col(f) * w for f, w in zip(features, weights)), F.lit(0.0))
        push = 1 / (1 + F.exp(F.greatest(F.lit(-clip), F.least(F.lit(clip), margin))))
        slope = pairs.agg(*[F.coalesce(F.avg(push * F.col(f)), F.lit(0.0)).alias(f"g{i}") for i, f in enumerate(features)]).first()
        weights = [w + rate * (slope[i] - l2 * w) for i, w in enumerate(weights)]
    return weights


def product_pairs(rows: DataFrame, group: str, id_col: str, features: Sequence[str], label: str, cap: int = 16) -> DataFrame:
    """Within-group differences of the first cap better and the first cap worse rows by id; the caps define the training set."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group, label).orderBy(id_col))
    some = rows.withColumn("__i", place).filter(F.col("__i") <= cap)
    good, bad = some.filter(F.col(label) > 0), some.filter(F.col(label) <= 0)
    joined = good.alias("a").join(bad.alias("b"), F.col(f"a.{group}") == F.col(f"b.{group}"))
    return joined.select(F.col(f"a.{group}").alias(group), *[(F.col(f"a.{f}") - F.col(f"b.{f}")).alias(f) for f in features])


def pair_accuracy(pairs: DataFrame, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """(pairs, accuracy, loss); a tie is half right."""
    m = sum((F.col(f) * float(w) for f, w in zip(features, weights)), F.lit(0.0))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.when(m > 0, 1.0).when(m == 0, 0.5).otherwise(0.0)).alias("accuracy"), F.avg(F.log1p(F.exp(-F.abs(m))) + F.greatest(F.lit(0.0), -m)).alias("loss"))


def platt(rows: DataFrame, slopes: Sequence[float], offsets: Sequence[float]) -> DataFrame:
    """(slope, offset, loss): the grid point of least log-loss of sigmoid(slope * margin + offset) on rows (margin, label)."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("slope"), F.lit(float(o)).alias("offset")) for s in slopes for o in offsets]))
    z = F.col("g.slope") * F.col("margin") + F.col("g.offset")
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(F.lit(0.0), z) - z * F.col("label")
    fits = rows.select("margin", "label", grid.alias("g")).groupBy("g.slope", "g.offset").agg(F.avg(loss).alias("loss"))
    return fits.orderBy("loss", "slope", "offset").limit(1)


def split_folds(id_col: str, folds: int, seed: str):
    """Fold number of a group id, by hash."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\0", F.lit(seed), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(folds))


def intent_model(rows: DataFrame, features: Sequence[str], label: str, group: str, *, folds: int = 5, abstain: float = 0.4) -> DataFrame:
    """(classes, rows, accuracy, abstained, confidence) on one hash-dealt fold of groups, of a multinomial logistic model fitted on the others.

    Predictions under ``abstain`` confidence abstain and count as wrong.
    """
    from pyspark.ml.feature import StringIndexer

    fold = split_folds(group, folds, "intent")
    stages = [StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=list(features), outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol="__y", regParam=0.01, family="multinomial", maxIter=30)]
    model = Pipeline(stages=stages).fit(rows.filter(fold != 0))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows.filter(fold == 0)).withColumn("p", F.array_max(vector_to_array("probability")))
    sure = F.col("p") >= abstain
    return scored.agg(F.lit(len(model.stages[0].labels)).alias("classes"), F.count(F.lit(1)).alias("rows"), F.round(F.avg((sure & (F.col("prediction") == F.col("__y"))).cast("double")), 6).alias("accuracy"), F.round(F.avg((~sure).cast("double")), 6).alias("abstained"), F.round(F.avg("p"), 6).alias("confidence"))
