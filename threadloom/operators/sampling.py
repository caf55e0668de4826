"""Exact stratified samples drawn by hash order, so that every engine draws the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.forest import cut

#: Rows that are ranked to find the last one of a draw, and groups whose quotas are sent to all tasks.
BORDER_ROWS, BROADCAST_GROUPS = 10_000, 100_000


def lot(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with name, their place from 0 by a unique key: ranges of the key are numbered apart and shifted by what lies before them."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    part = F.lit(0)
    for c in sorted(set(cuts or [])):
        part = part + (F.col(key) > F.lit(c)).cast("int")
    ranged = rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = ranged.join(F.broadcast(sizes.select("_part", "_before")), "_part")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return out.withColumn(name, (F.col("_before") + own).cast("long")).drop("_part", "_before")


def allocate(counts: DataFrame, total: int) -> DataFrame:
    """(stratum, n, quota) of counts (stratum, n): largest remainders, ties by name; raises where it cannot."""
    every = counts.agg(F.sum("n").alias("all"))
    out = counts.crossJoin(F.broadcast(every)).withColumn("_x", F.lit(total).cast("double") * F.col("n") / F.col("all"))
    out = out.withColumns({"_f": F.floor("_x"), "_rest": F.col("_x") - F.floor("_x")})
    w = Window.orderBy(F.desc("_rest"), "stratum")
    left = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    quota = F.col("_f") + (F.row_number().over(w) <= left).cast("long")
    checked = F.when((F.lit(total) > F.col("all")) | (quota > F.col("n")), F.raise_error(F.lit("more asked than there is")).cast("long")).otherwise(quota)
    return out.select("stratum", "n", checked.alias("quota"))


def first_by_lot(rows: DataFrame, group: list[str], quota: str, key: Column) -> DataFrame:
    """The rows that are among the first of their group by key (a hash as lower hex digits), as many as quota says (one value a group).

    No group is ranked whole: counts by the leading digits say in which of 4,096 buckets the last row
    to keep lies, and counts within it by the next digits where it still has more than BORDER_ROWS.
    Rows of lower buckets are kept by a comparison, those of the last bucket are ranked. Rows of equal
    keys are taken in any order.
    """
    rows = rows.withColumn("_key", key)
    names = [f"_g{i}" for i in range(len(group))]
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names, strict=True)]
    cuts = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)]).agg(F.first(quota).cast("long").alias("_need"), F.count("*").alias("_size"))
    cuts = cut(cuts.where("_need > 0").withColumn("_prefix", F.lit("")))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df
    digits = 0
    while digits < 32 and cuts.where((F.col("_size") > BORDER_ROWS) & (F.col("_need") < F.col("_size"))).limit(1).count():
        digits += 3
        large = cuts.where((F.col("_size") > BORDER_ROWS) & (F.col("_need") < F.col("_size")))
        inside = rows.join(small(large.drop("_size")), reduce(Column.__and__, same)).where(F.startswith("_key", F.col("_prefix")))
        by = inside.groupBy(*names, F.substring("_key", 1, digits).alias("_next")).agg(F.first("_need").alias("_need"), F.count("*").alias("_n"))
        by = by.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*names).orderBy("_next")))
        chosen = by.where((F.col("_upto") - F.col("_n") < F.col("_need")) & (F.col("_need") <= F.col("_upto")))
        chosen = chosen.select(*names, (F.col("_need") - (F.col("_upto") - F.col("_n"))).alias("_need"), F.col("_n").alias("_size"), F.col("_next").alias("_prefix"))
        rest = cuts.where((F.col("_size") <= BORDER_ROWS) | (F.col("_need") >= F.col("_size")))
        cuts = cut(rest.unionByName(chosen))
    known = rows.join(small(cuts), reduce(Column.__and__, same))
    head = F.substring("_key", F.lit(1), F.length("_prefix"))
    ranked = (head == F.col("_prefix")) & (F.col("_need") < F.col("_size"))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("_key"))
    border = known.where(ranked).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need")).drop("_rank")
    kept = known.where((head <= F.col("_prefix")) & ~ranked).unionByName(border)
    return kept.drop("_key", "_need", "_size", "_prefix", *names)


def stratified(rows: DataFrame, id_col: str, stratum_col: str, total: int, seed: int = 42) -> DataFrame:
    """total rows of rows, each stratum by its share; a null stratum is one."""
    quotas = allocate(rows.groupBy(F.col(stratum_col).alias("stratum")).agg(F.count("*").alias("n")), total)
    known = rows.join(F.broadcast(quotas.select(F.col("stratum").alias("_s"), F.col("quota").alias("_quota"))), F.col(stratum_col).eqNullSafe(F.col("_s"))).drop("_s")
    return first_by_lot(known, [stratum_col], "_quota", lot(seed, F.col(id_col))).drop("_quota")


def equal_shares(counts: dict, total: int) -> dict:
    """Equal quotas, capped by what a stratum has, the rest dealt again until it is gone or all are full."""
    quota = dict.fromkeys(counts, 0)
    while (left := total - sum(quota.values())) > 0:
        open_ = sorted(k for k in counts if quota[k] < counts[k])
        if not open_:
            break
        share = max(1, left // len(open_))
        for k in open_:
            give = min(share, counts[k] - quota[k], total - sum(quota.values()))
            quota[k] += give
    return quota


def short_oversample(rows: DataFrame, id_col: str, stratum_col: str, words_col: str, quota: int | DataFrame, short: int = 5, part: float = 0.10, seed: int = 42) -> DataFrame:
    """quota rows of each stratum, bround(quota * part) of them short where there are so many, the rest long, then what is left.

    quota may be a frame (stratum, quota), as allocate gives; a stratum it lacks has none. Rows of
    unknown length count as long. Where one kind is short of its part, the other gives what is missing:
    so each kind has a quota that follows from counts.
    """
    if isinstance(quota, DataFrame):
        rows = rows.join(quota.select(F.col("stratum").alias("_s"), F.col("quota").alias("_quota")), F.col(stratum_col).eqNullSafe(F.col("_s"))).drop("_s")
    else:
        rows = rows.withColumn("_quota", F.lit(quota))
    rows = rows.withColumn("_short", F.coalesce(F.col(words_col) < short, F.lit(False)))
    counts = rows.groupBy(F.col(stratum_col).alias("_s")).agg(F.count_if("_short").alias("_few"), F.count_if(~F.col("_short")).alias("_many"))
    known = rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_GROUPS else counts, F.col(stratum_col).eqNullSafe(F.col("_s"))).drop("_s")
    want = F.bround(F.col("_quota") * part).cast("int")
    mine = F.when(F.col("_short"), F.greatest(want, F.col("_quota") - F.col("_many"))).otherwise(F.greatest(F.col("_quota") - want, F.col("_quota") - F.col("_few")))
    known = known.withColumn("_own", mine)
    return first_by_lot(known, [stratum_col, "_short"], "_own", lot(seed, F.col(id_col))).drop("_quota", "_short", "_few", "_many", "_own")
