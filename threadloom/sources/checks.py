"""Checks that raise when rows break a rule. Each is one pass that counts the violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BrokenRule(AssertionError, ValueError):
    """Rows break a rule that later steps rest on."""


def expect_none(violations: DataFrame, what: str) -> None:
    if n := violations.count():
        raise BrokenRule(f"{n} {what}, such as {[tuple(r) for r in violations.limit(3).collect()]}")


def expect_unique(df: DataFrame, *key: str) -> None:
    """No key is null or stands on two rows."""
    null = F.greatest(*[F.col(c).isNull().cast("int") for c in key], F.lit(0)) == 1
    expect_none(df.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null), f"keys ({', '.join(key)}) repeat or are null")


def expect_all(df: DataFrame, rule: Column, what: str) -> None:
    """rule holds for every row; null counts as broken."""
    expect_none(df.where(~F.coalesce(rule, F.lit(False))), f"rows break: {what}")


def expect_within(df: DataFrame, other: DataFrame, key: str) -> None:
    """Every key of df is one of other."""
    expect_none(df.select(key).join(other.select(key), key, "left_anti"), f"values of {key} are unknown")


def expect_disjoint(df: DataFrame, other: DataFrame, key: str) -> None:
    expect_none(df.select(key).join(other.select(key), key, "left_semi"), f"values of {key} are in both")


def expect_same_count(a: DataFrame, b: DataFrame, what: str) -> None:
    if (n := a.count()) != (m := b.count()):
        raise BrokenRule(f"{what}: {n} rows became {m}")


def expect_sum(df: DataFrame, column: str, total: int) -> None:
    if (n := df.agg(F.sum(column)).first()[0] or 0) != total:
        raise BrokenRule(f"{column} sums to {n} instead of {total}")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, complete: bool = False) -> DataFrame:
    """left with the columns of right: the key is unique on both sides; complete: every row finds its other. One pass over the keys of both sides checks it."""
    side = lambda df, l, r: df.select(F.col(key).alias("key"), F.lit(l).alias("left"), F.lit(r).alias("right"))  # noqa: E731, E741
    counts = side(left, 1, 0).union(side(right, 0, 1)).groupBy("key").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    broken = F.col("key").isNull() | (F.col("left") > 1) | (F.col("right") > 1) | (F.lit(complete) & (F.col("left") > 0) & (F.col("right") == 0))
    expect_none(counts.where(broken), f"values of {key} are null, repeat on a side" + " or lack their other row" * complete)
    return left.join(right, key, "left")
