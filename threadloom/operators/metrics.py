"""Classification metrics as aggregates over (y_true, y_pred) and a label dimension (label, pos)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def labels(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, pos int")


def confusion(pairs: DataFrame, dim: DataFrame) -> DataFrame:
    """(true_label, pred_label, true_pos, pred_pos, n): dense; a label that is not declared raises."""
    counts = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    d = F.broadcast(dim)
    known = counts.join(d.select(F.col("label").alias("y_true"), F.lit(1).alias("kt")), "y_true", "left").join(d.select(F.col("label").alias("y_pred"), F.lit(1).alias("kp")), "y_pred", "left")
    checked = known.select("y_true", "y_pred", F.when(F.col("kt").isNull() | F.col("kp").isNull(), F.raise_error(F.lit("label is not declared")).cast("long")).otherwise(F.col("n")).alias("n"))
    grid = dim.select(F.col("label").alias("true_label"), F.col("pos").alias("true_pos")).crossJoin(d.select(F.col("label").alias("pred_label"), F.col("pos").alias("pred_pos")))
    cells = grid.join(checked, (F.col("true_label") == F.col("y_true")) & (F.col("pred_label") == F.col("y_pred")), "full")
    return cells.select("true_label", "pred_label", "true_pos", "pred_pos", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, pos, tp, fp, fn, precision, recall, f1, support) of a dense confusion matrix; 0/0 is 0."""
    hit = F.col("true_pos") == F.col("pred_pos")
    side = lambda c: matrix.groupBy(F.col(f"{c}_label").alias("label"), F.col(f"{c}_pos").alias("pos")).agg(F.sum("n").alias(c), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    both = side("true").join(side("pred").select("label", "pred"), "label")
    precision, recall = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("true"))
    both = both.select("label", "pos", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"), F.col("true").alias("support"))
    return both.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(report: DataFrame) -> DataFrame:
    undefined = lambda a, b, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(a) + F.col(b) == 0, F.struct("pos", "label")))), lambda s: s["label"]), ",").alias(name)
    return report.agg(F.avg("f1").alias("macro_f1"), undefined("tp", "fp", "undefined_precision"), undefined("tp", "fn", "undefined_recall"))


def kappa(matrix: DataFrame) -> DataFrame:
    """(n, accuracy, kappa, qw_kappa): kappa 0 where chance agreement is 1; weights are squared distances of positions."""
    if matrix.select("true_pos").distinct().limit(2).count() < 2:
        raise ValueError("weighted agreement needs two labels at least")
    rows = matrix.groupBy(F.col("true_pos").alias("i")).agg(F.sum("n").alias("r"))
    cols = matrix.groupBy(F.col("pred_pos").alias("j")).agg(F.sum("n").alias("c"))
    cells = matrix.join(F.broadcast(rows), F.col("true_pos") == F.col("i")).join(F.broadcast(cols), F.col("pred_pos") == F.col("j"))
    w = ((F.col("i") - F.col("j")) ** 2).cast("double")
    hit = F.col("i") == F.col("j")
    rc = (F.col("r") * F.col("c")).cast("double")
    one = cells.agg(F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("h"), F.sum(F.when(hit, rc).otherwise(0.0)).alias("e"), F.sum(w * F.col("n")).alias("ow"), F.sum(w * rc).alias("ew"))
    n = F.col("n").cast("double")
    po, pe = F.col("h") / n, F.col("e") / (n * n)
    return one.select("n", po.alias("accuracy"), F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe)).alias("kappa"), F.when(F.col("ew") == 0, 0.0).otherwise(1 - F.col("ow") * n / F.col("ew")).alias("qw_kappa"))


def bootstrap(pairs: DataFrame, resamples: int = 1000, seed: int = 42, low: float = 0.025, high: float = 0.975, metric: Column | None = None, name: str = "accuracy") -> DataFrame:
    """(n, name, low, high) of a metric over hashed draws with replacement, shared by all that use the seed.

    pairs: (pos, ...) with pos from 0 without gaps. metric is an aggregate of the other columns, the
    mean of hit by default. Draw p of resample r is the number in the first
    eight hex digits of md5('seed:r:p'), modulo n.
    """
    if not 0 <= low <= high <= 1:
        raise ValueError("percentiles are from 0 to 1")
    spark = pairs.sparkSession
    metric = F.avg("hit") if metric is None else metric
    n = pairs.count()
    draws = spark.range(resamples * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("p"))
    draws = draws.select("r", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "r", "p").cast("binary")), 1, 8), 16, 10).cast("long") % n).alias("pos"))
    scores = draws.join(pairs, "pos").groupBy("r").agg(metric.alias("score"))
    return scores.agg(F.percentile("score", F.lit(low)).alias("low"), F.percentile("score", F.lit(high)).alias("high")).crossJoin(pairs.agg(F.count("*").alias("n"), metric.alias(name)))


#: Values that are sorted to read a quantile off; the sketch's accuracy, and the part of the rows kept on either side of a rank.
SORTED_VALUES, ACCURACY, ASIDE = 10_000, 10_000, 1 / 2_000


def quantiles(rows: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """The exact quantiles of a column of any length, between two values in proportion; nulls and NaN are left out, no values give None.

    Each rank is bracketed by a sketch's values a little below and above it, the brackets are checked
    by counts and narrowed until few values or a single one is left. What is held are sketches and
    counts, never the values; a round reads the rows twice. A bracket that the counts don't confirm
    stays where it was on that side.
    """
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles are from 0 to 1")
    x = F.col(column).cast("double")
    rows = rows.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    n, least, most = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(at)
    ranks = sorted({r for q in at for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    open_ = {r: (least, most, 0, n) for r in ranks}  # rank -> the bracket, how many values lie below it, how many in it
    value = {}
    while True:
        for r, (low, high, _, _) in list(open_.items()):
            if low == high:
                value[r] = low
                del open_[r]
        wide = {r: b for r, b in open_.items() if b[3] > SORTED_VALUES}
        if not wide:
            break
        inside = lambda low, high: F.when(F.col("x").between(F.lit(low), F.lit(high)), F.col("x"))
        part = {r: (r - below) / max(1, size - 1) for r, (_, _, below, size) in wide.items()}
        asked = [F.percentile_approx(inside(low, high), [max(0.0, part[r] - ASIDE), min(1.0, part[r] + ASIDE)], ACCURACY) for r, (low, high, _, _) in wide.items()]
        edges = dict(zip(wide, rows.agg(*asked).first(), strict=True))
        counts = rows.agg(*[c for a, b in edges.values() for c in (F.count_if(F.col("x") < F.lit(a)), F.count_if(F.col("x") <= F.lit(b)))]).first()
        for i, (r, (a, b)) in enumerate(edges.items()):
            low, high, below, size = open_[r]
            under, upto = counts[2 * i], counts[2 * i + 1]
            low, start = (a, under) if under <= r else (low, below)
            high, end = (b, upto) if r < upto else (high, below + size)
            if (low, high) == open_[r][:2]:  # the sketch can't split it further: halve it between its ends
                middle = low + (high - low) / 2 if low + (high - low) / 2 < high else low
                upto = rows.agg(F.count_if(F.col("x") <= F.lit(middle))).first()[0]
                if r < upto:
                    high, end = middle, upto
                else:
                    low, start = rows.where(F.col("x") > F.lit(middle)).agg(F.min("x")).first()[0], upto
            open_[r] = (low, high, start, end - start)
    if open_:
        kept = [F.sort_array(F.collect_list(F.when(F.col("x").between(F.lit(low), F.lit(high)), F.col("x")))) for low, high, _, _ in open_.values()]  # SORTED_VALUES at most each
        for (r, (_, _, below, _)), held in zip(open_.items(), rows.agg(*kept).first(), strict=True):
            value[r] = held[r - below]
    out = []
    for q in at:
        p = q * (n - 1)
        a, b = value[math.floor(p)], value[math.ceil(p)]
        out.append(a + (b - a) * (p - math.floor(p)))
    return out
