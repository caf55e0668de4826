"""Evaluation tables: predictions aligned with golden rows, paired bootstrap of any metric."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.metrics import ratio
from threadloom.sources.checks import expect_none, expect_unique


def aligned(golden: DataFrame, predictions: DataFrame, key: str = "conversation_id") -> DataFrame:
    """golden with its predictions: each golden key once on both sides, none missing and none besides."""
    expect_unique(golden, key)
    expect_unique(predictions, key)
    expect_none(golden.select(key).join(predictions, key, "left_anti"), "golden rows have no prediction")
    expect_none(predictions.select(key).join(golden, key, "left_anti"), "predictions are of no golden row")
    return golden.join(predictions, key)


def checked(pairs: DataFrame) -> DataFrame:
    """pairs (y_true, y_pred, ...); none at all, or a null on one side, raises."""
    if not pairs.limit(1).count():
        raise ValueError("there are no rows to score")
    expect_none(pairs.where(F.col("y_true").isNull() | F.col("y_pred").isNull()), "rows lack a label on one side")
    return pairs


def draws(spark, n: int, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(r, pos): n draws with replacement for each resample, the same for every system that is scored on them."""
    out = spark.range(resamples * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("p"))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), "r", "p").cast("binary"))
    return out.select("r", (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % n).alias("pos"))


Metric = Callable[[DataFrame, list[str]], DataFrame]


def class_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, tp, predicted, support) of pairs with a weight n."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    true = pairs.select(*by, F.col("y_true").alias("label"), hit.alias("tp"), F.lit(0).alias("predicted"), F.col("n").alias("support"))
    pred = pairs.select(*by, F.col("y_pred").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("predicted"), F.lit(0).alias("support"))
    return true.union(pred).groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))


def with_f1(counts: DataFrame) -> DataFrame:
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(n_labels: int) -> Metric:
    """The mean F1 over n_labels declared labels; one that occurs on neither side counts 0."""
    return lambda pairs, by: with_f1(class_counts(pairs, by)).groupBy(*by).agg((F.sum("f1") / n_labels).alias("score"))


def f1_of(label) -> Metric:
    """The F1 of one label, 0 where it doesn't occur."""

    def metric(pairs: DataFrame, by: list[str]) -> DataFrame:
        own = with_f1(class_counts(pairs, by)).groupBy(*by).agg(F.max(F.when(F.col("label") == F.lit(label), F.col("f1"))).alias("f"))
        return own.select(*by, F.coalesce("f", F.lit(0.0)).alias("score"))

    return metric


def accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    return pairs.groupBy(*by).agg(ratio(F.sum(hit), F.sum("n")).alias("score"))


def interval(pairs: DataFrame, metric: Metric, n: int, resamples: int = 1000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(system, value, low, high): a metric and its percentile interval for each system of pairs (system, pos, y_true, y_pred).

    All systems are scored on the same draws of the n positions, so that intervals are paired.
    """
    for q in (low, high):
        if not 0 <= q <= 1:
            raise ValueError("a percentile is from 0 to 1")
    spark = pairs.sparkSession
    drawn = draws(spark, n, resamples, seed).groupBy("r", "pos").agg(F.count("*").alias("n"))
    # Equal pairs of a resample are one row with their number before any metric is computed.
    sampled = drawn.join(pairs.select("system", "pos", "y_true", "y_pred"), "pos").groupBy("system", "r", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    scores = metric(sampled, ["system", "r"])
    whole = metric(pairs.groupBy("system", "y_true", "y_pred").agg(F.count("*").alias("n")), ["system"])
    spread = scores.groupBy("system").agg(F.percentile("score", F.lit(low)).alias("low"), F.percentile("score", F.lit(high)).alias("high"))
    return whole.withColumnRenamed("score", "value").join(spread, "system")


def binary_table(pairs: DataFrame, n: int, positive=True, resamples: int = 1000) -> DataFrame:
    """(system, precision, recall, f1, low, high, n_predicted, support): the positive class of each system."""
    counts = with_f1(class_counts(pairs.groupBy("system", "y_true", "y_pred").agg(F.count("*").alias("n")), ["system"])).where(F.col("label") == F.lit(positive))
    out = interval(pairs, f1_of(positive), n, resamples).join(counts, "system", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("system", zero("precision").cast("double").alias("precision"), zero("recall").cast("double").alias("recall"), F.col("value").alias("f1"), "low", "high", zero("predicted").alias("n_predicted"), zero("support").alias("support"))


def intent_table(pairs: DataFrame, n: int, n_labels: int, resamples: int = 1000) -> DataFrame:
    """(system, accuracy, macro_f1, low, high)."""
    right = accuracy(pairs.groupBy("system", "y_true", "y_pred").agg(F.count("*").alias("n")), ["system"]).withColumnRenamed("score", "accuracy")
    return interval(pairs, macro_f1(n_labels), n, resamples).join(right, "system").select("system", "accuracy", F.col("value").alias("macro_f1"), "low", "high")


def per_class_table(pairs: DataFrame) -> DataFrame:
    """(system, label, precision, recall, f1, support) of labels that occur."""
    counts = class_counts(pairs.groupBy("system", "y_true", "y_pred").agg(F.count("*").alias("n")), ["system"])
    return with_f1(counts).select("system", "label", "precision", "recall", "f1", "support")


def family_pairs(golden: DataFrame, fired: DataFrame, families: dict, key: str = "conversation_id") -> DataFrame:
    """(system = family, pos, y_true, y_pred): each family of signals as a rule of its own. golden has pos and escalate, fired an array."""
    rows = golden.join(fired, key)
    hit = F.array(*[F.struct(F.lit(name).alias("system"), F.arrays_overlap("fired", F.array(*[F.lit(s) for s in own])).alias("y_pred")) for name, own in families.items()])
    return rows.select("pos", F.col("escalate").alias("y_true"), F.explode(hit).alias("h")).select("h.system", "pos", "y_true", "h.y_pred")
