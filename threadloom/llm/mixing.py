"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.shared import written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that one flight handles; what it leaves undecided goes on to the next round.
FLIGHT_ROWS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target) of each source of sizes (source, size).

    A target is min(most * source_size, level * weight) at the level where the targets sum to
    share * all sizes: what is above a cap is reshared by weight until none is above.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size"))
    # Sources reach their caps in the order of cap / weight.
    w = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    by = by.withColumn("total", share * F.sum("source_size").over(every))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    by = by.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    by = by.withColumn("rank", F.row_number().over(w))
    level = F.coalesce(F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(every)["level"], F.lit(float("inf")))
    return by.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def flight(p: np.ndarray, size: np.ndarray, luck: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities until at most two are fractional, keeping sum(p) and sum(p * size).

    Three open documents at a time move along the one direction in which neither total changes, to
    the nearer or farther bound by a draw that keeps each one's expectation; who meets 0 or 1 leaves.
    """
    p = p.copy()
    held: list[int] = []
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u, strict=True) if v)
        step = up if luck.random() * (up + down) < down else -down
        for k, v in zip(held, u, strict=True):
            p[k] += step * v
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        held = [k for k in held if 0 < p[k] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray, owed: float) -> np.ndarray:
    """Decide the few that are left: of all ways, the one whose words come nearest to owed."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min(range(1 << len(left)), key=lambda way: (abs(owed - sum(size[left[j]] for j in range(len(left)) if way >> j & 1)), way))
    p = p.copy()
    for j, k in enumerate(left):
        p[k] = float(best >> j & 1)
    return p


def repaired(taken: np.ndarray, size: np.ndarray, owed: float) -> np.ndarray:
    """taken with one document more or less, or one in another's place, if that brings its words nearer to owed.

    The exchange that comes nearest is made, again and again until none helps.
    """
    taken = taken.copy()
    for _ in range(len(taken)):
        lack = owed - float((taken * size).sum())
        out, within = np.flatnonzero(taken == 0), np.flatnonzero(taken == 1)
        out, within = out[np.argsort(size[out], kind="stable")], within[np.argsort(size[within], kind="stable")]
        # In for nothing, or for one that goes; out for nothing.
        give = np.r_[0.0, size[within]]
        give_at = np.r_[-1, within]
        near = np.searchsorted(size[out], give + lack)
        best = (abs(lack), -1, -1)
        for step in (-1, 0):
            at = near + step
            ok = (at >= 0) & (at < len(out))
            if ok.any():
                apart = np.abs(lack + give[ok] - size[out[at[ok]]])
                k = int(apart.argmin())
                if apart[k] < best[0] - 1e-9:
                    best = (float(apart[k]), int(out[at[ok][k]]), int(give_at[ok][k]))
        if len(within):
            apart = np.abs(lack + size[within])
            k = int(apart.argmin())
            if apart[k] < best[0] - 1e-9:
                best = (float(apart[k]), -1, int(within[k]))
        if best[1:] == (-1, -1):
            break
        if best[1] >= 0:
            taken[best[1]] = 1.0
        if best[2] >= 0:
            taken[best[2]] = 0.0
    return taken


_FLOWN = "row long, again long, source string, size long, p double"


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: those that stay open to the end, and land, are small.
        pdf = pdf.sort_values(["size", "h", "row"], ascending=[False, True, True], kind="stable")
        p, size = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)
        flown = flight(p, size, np.random.default_rng(abs(int(pdf["h"].iloc[0])) if len(pdf) else 0))
        if last:
            open_ = (flown > 0) & (flown < 1)
            owed = float((flown * size).sum())
            flown = repaired(land(flown, size, float((flown[open_] * size[open_]).sum())), size, owed)
        return pd.DataFrame({"row": pdf["row"], "again": pdf["again"], "source": pdf["source"], "size": pdf["size"], "p": flown})

    return run


def balanced(sized: DataFrame, seed: int, flight_rows: int = FLIGHT_ROWS) -> DataFrame:
    """(row, again, p) of sized (row, again, source, size, p): p is 0 or 1 for every row, balanced on words and documents of each source.

    Rounds: flights over blocks of about flight_rows documents of a source, then over what those
    left open, until a source is one block; that one lands, and what it then lacks of its words is
    mended by exchanges.
    """
    spark = sized.sparkSession
    done: list[DataFrame] = []
    now = sized.withColumn("h", F.xxhash64(F.lit(seed), "row"))
    while True:
        counts = now.groupBy("source").agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        last = largest <= flight_rows
        if last:
            blocks = now.withColumn("block", F.lit(0))
        else:
            counts = counts.select(F.col("source").alias("_s"), F.ceil(F.col("n") / flight_rows).alias("_b"))
            blocks = now.join(counts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", F.pmod(F.shiftrightunsigned("h", 7), F.col("_b"))).drop("_s", "_b")
        flown = blocks.groupBy("source", "block").applyInPandas(_fly(last), _FLOWN)
        if last:
            done.append(flown.select("row", "again", "p"))
            break
        flown = written(flown, "flown")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~fractional).select("row", "again", "p"))
        now = flown.where(fractional).withColumn("h", F.xxhash64(F.lit(seed), "row"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out if done else spark.createDataFrame([], "row long, again long, p double")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each document.

    A source's documents are each taken floor(target / source_size) times, and once more by a draw
    that keeps the source's words and documents near their expected totals. taken = copies * size;
    copies is at most ceil(most). Reruns agree. Null texts have size 0; a null source is a source,
    after the others; null ids and repeated rows stay rows of their own (repeated rows are taken
    alike but for the draw); an empty table gives an empty table; a source of size 0 has target 0
    and takes nothing.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    base = base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("same"))
    # Equal rows differ by their ordinal alone, so reruns agree whatever the order of the input.
    base = base.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("same"))).alias("ordinal"))
    base = written(base.withColumns({"row": F.xxhash64("doc_id", "source", "size", "ordinal"), "again": F.xxhash64("ordinal", "size", "source", "doc_id", F.lit("again"))}), "sizes")
    goal = written(targets(base, share, most, weights), "targets")
    goal = goal.withColumn("ratio", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    joined = base.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, base["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    joined = joined.withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    drawn = balanced(joined.where("size > 0").select("row", "again", "source", "size", "p"), seed)
    out = joined.join(drawn.select("row", "again", F.col("p").cast("long").alias("once")), ["row", "again"], "left")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("once", F.lit(0))).otherwise(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
