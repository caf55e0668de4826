"""Judge rows (system, conversation_id, repeat, axes, parse_ok): means, self-consistency, agreement with people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.judging import AXES, HIGHEST, LOWEST
from threadloom.operators import metrics
from threadloom.sources.checks import expect_none, expect_unique


def long_scores(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., axis, score): a row for each axis."""
    stacked = ", ".join(f"'{a}', {a}" for a in AXES)
    return rows.selectExpr(*keep, f"stack({len(AXES)}, {stacked}) AS (axis, score)")


def summary(rows: DataFrame) -> DataFrame:
    """(system, n_rows, n_parsed, n_failed, mean of each axis): means over what parsed, null where nothing did."""
    mean = [F.avg(F.when(F.col("parse_ok"), F.col(a))).alias(f"mean_{a}") for a in AXES]
    return rows.groupBy("system").agg(F.count("*").alias("n_rows"), F.count_if("parse_ok").alias("n_parsed"), F.count_if(~F.col("parse_ok")).alias("n_failed"), *mean)


def consistency(rows: DataFrame, repeat: int, order: str = "conversation_id") -> DataFrame:
    """(axis, n_compared, mean_spread, n_agreed, share_agreed, worst_spread, worst_id) over conversations with `repeat` parsed rows.

    Of several conversations with the worst spread the first by order is named.
    """
    if repeat < 2:
        raise ValueError("one repeat has nothing to be compared with")
    spread = [(F.max(a) - F.min(a)).alias(a) for a in AXES]
    by = rows.groupBy("conversation_id").agg(F.count("*").alias("n"), F.every("parse_ok").alias("ok"), F.min(order).alias("_first"), *spread)
    whole = long_scores(by.where((F.col("n") == repeat) & F.col("ok")), "conversation_id", "_first")
    worst = F.min(F.struct((-F.col("score")).alias("s"), F.col("_first").alias("f"), "conversation_id"))
    return whole.groupBy("axis").agg(
        F.count("*").alias("n_compared"), F.avg("score").alias("mean_spread"), F.count_if(F.col("score") == 0).alias("n_agreed"), F.avg((F.col("score") == 0).cast("double")).alias("share_agreed"), F.max("score").alias("worst_spread"), worst["conversation_id"].alias("worst_id"),
    )


def of_system(rows: DataFrame, system: str = "agent", repeat: int = 0) -> DataFrame:
    """One system's rows of one repeat (a null repeat is 0), a conversation once; none at all raises."""
    own = rows.where((F.col("system") == system) & (F.coalesce("repeat", F.lit(0)) == repeat))
    expect_unique(own, "conversation_id")
    if not own.limit(1).count():
        raise ValueError(f"no rows of {system}, repeat {repeat}")
    return own


def latest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Of each key the row written last."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at)))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def agreement(human: DataFrame, judge: DataFrame) -> DataFrame:
    """(axis, n, kappa, qw_kappa, raw_agreement, judge_mean, human_mean) over conversations that both scored."""
    pick = lambda df, side: long_scores(df, "conversation_id").withColumnRenamed("score", side)
    both = pick(human, "h").join(pick(judge, "j"), ["conversation_id", "axis"])
    dim = metrics.labels(human.sparkSession, map(str, range(LOWEST, HIGHEST + 1)))

    def of(axis: str) -> DataFrame:
        own = both.where(F.col("axis") == axis)
        matrix = metrics.confusion(own.select(F.col("h").cast("string").alias("y_true"), F.col("j").cast("string").alias("y_pred")), dim)
        means = own.agg(F.avg("j").alias("judge_mean"), F.avg("h").alias("human_mean"))
        return metrics.kappa(matrix).crossJoin(means).select(F.lit(axis).alias("axis"), "n", "kappa", "qw_kappa", F.col("accuracy").alias("raw_agreement"), "judge_mean", "human_mean")

    return reduce(DataFrame.union, map(of, AXES))


def cases(rows: DataFrame, context: DataFrame, limit: int | None = None) -> DataFrame:
    """(conversation_id, text, reply, retrieved) of rows with a reply, in the order of their ids, the first limit of them.

    A conversation without retrieved context raises.
    """
    expect_none(rows.join(context, "conversation_id", "left_anti"), "conversations without context")
    out = rows.where(F.length("reply") > 0).join(context.select("conversation_id", "retrieved"), "conversation_id")
    out = out.select("conversation_id", "text", "reply", "retrieved").orderBy("conversation_id")
    return out if limit is None else out.limit(limit)
