"""k-means for many k and starts in one scan a step, exact silhouettes by stripes, and exemplars as text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T
from threadloom.operators.forest import cut
from threadloom.operators.sampling import lot

#: Rows that a silhouette compares with as many others in one task.
STRIPE_ROWS = 8_192
CENTRES_EACH = 64
#: Centres start among this many rows, drawn by lot; all rows move them from then on.
START_ROWS = 16_384


@dataclass
class Run:
    """One start of one k: where its centres are, the sum of squared distances to them, and whether they still move."""

    k: int
    start: int
    centres: np.ndarray
    cost: float = np.inf
    moving: bool = True


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less each row's own square."""
    return (centres**2).sum(1) - 2 * x @ centres.T


def _spread_out(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k rows of x: each with a chance by its squared distance to those before it (k-means++)."""
    chosen = [x[draw.integers(len(x))]]
    left = np.full(len(x), np.inf)
    for _ in range(k - 1):
        left = np.minimum(left, ((x - chosen[-1]) ** 2).sum(1))
        chosen.append(x[draw.choice(len(x), p=left / left.sum())] if left.sum() > 0 else x[draw.integers(len(x))])
    return np.array(chosen)


def _step(vectors: DataFrame, runs: list[Run]) -> np.ndarray:
    """A row (n, cost, total...) for each centre of each run, of the rows nearest to it. One scan, whatever the number of runs; each task adds up its own rows."""
    centres, shape = np.concatenate([r.centres for r in runs]), [r.k for r in runs]
    ends = np.cumsum(shape)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centres), 2 + centres.shape[1]))
        for batch in batches:
            x = _matrix(batch.column(0))
            apart, square = _apart(x, centres), (x**2).sum(1)
            for e, k in zip(ends, shape, strict=True):
                part = apart[:, e - k : e]
                own = part.argmin(1)
                onto = (own[:, None] == np.arange(k)).astype(float)
                sums[e - k : e, 0] += onto.sum(0)
                sums[e - k : e, 1] += np.maximum(part[np.arange(len(x)), own] + square, 0) @ onto
                sums[e - k : e, 2:] += onto.T @ x
        cuts = range(0, len(sums), CENTRES_EACH)
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([sums[c : c + CENTRES_EACH].tobytes() for c in cuts], pa.binary())], ["at", "sums"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(v.as_py()) for batch in batches for v in batch.column(batch.schema.names.index("sums")))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "sums"])

    rows = vectors.select("cv").mapInArrow(add, "at int, sums binary").groupBy("at").applyInArrow(join, "at int, sums binary").collect()
    return np.concatenate([np.frombuffer(r["sums"]).reshape(-1, 2 + centres.shape[1]) for r in sorted(rows)])


def fit(vectors: DataFrame, ks: list[int], starts: int = 10, seed: int = 42, steps: int = 300, tol: float = 1e-4) -> dict[int, Run]:
    """For each k the run of least cost, the first of those that agree in 10 digits, over vectors (id, cv) of one length.

    All runs of all k take their steps together: a step reads the vectors once, and what reaches the
    driver are sums for each centre. Centres start by k-means++ among START_ROWS rows drawn by lot. A
    run ends when its centres move by less than tol times the mean variance of a component (squared
    and summed), or after so many steps. A centre that no row is nearest to stays where it is.
    """
    rows = vectors.select("id", "cv")
    sample = rows.orderBy(lot(seed, F.col("id"))).limit(START_ROWS).select("cv").toArrow()
    if not sample.num_rows:
        raise ValueError("there are no vectors to cluster")
    x = _matrix(sample.column("cv").combine_chunks())
    runs = [Run(k, s, _spread_out(x, k, np.random.default_rng([seed, k, s]))) for k in ks for s in range(starts)]
    least = tol * x.var(0).mean()
    for step in range(steps + 1):
        open_ = [r for r in runs if r.moving]
        if not open_:
            break
        sums = iter(np.split(_step(rows, open_), np.cumsum([r.k for r in open_])[:-1]))
        for r in open_:
            n, cost, total = (got := next(sums))[:, :1], got[:, 1].sum(), got[:, 2:]
            moved = np.where(n > 0, total / np.maximum(n, 1), r.centres)
            r.cost, r.moving = float(cost), bool(step < steps and ((moved - r.centres) ** 2).sum() > least)
            r.centres = moved if r.moving else r.centres
    return {k: min((r for r in runs if r.k == k), key=lambda r: (float(f"{r.cost:.9e}"), r.start)) for k in ks}


def assign(vectors: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """vectors with clusters: the nearest centre (the lower of equally near ones) in each of the given sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.names.index("cv")))
            own = np.stack([_apart(x, c).argmin(1) for c in centres], 1).astype(np.int32) if len(x) else np.zeros((0, len(centres)), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(own), pa.list_(pa.int32()))], [*batch.schema.names, "clusters"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, clusters array<int>")


def cluster(vectors: DataFrame, k: int, starts: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """((id, cv, cluster), inertia) of vectors (id, cv): the start of least inertia, the first of equal ones."""
    rows = vectors.select("id", "cv").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = fit(rows, [k], starts, seed)[k]
    finally:
        rows.unpersist()
    return assign(vectors.select("id", "cv"), [best.centres]).select("id", "cv", F.col("clusters")[0].alias("cluster")), best.cost


def silhouettes(rows: DataFrame, ks: list[int]) -> DataFrame:
    """(id, at, cluster, s) of rows (id, cv, clusters): clusters[at] is below ks[at]; Euclidean distances.

    s = (other - own) / max(other, own): own is the mean distance to the other rows of its cluster,
    other the least mean distance to the rows of another; 0 where a cluster has one row or is alone.
    Exact for any number of rows: rows are dealt to stripes of about STRIPE_ROWS, each two stripes meet
    in one task, as shuffled tables, and leave for each row its sums of distances by cluster. The
    distances serve all assignments. Cost is all pairs by nature: rows move once for each stripe.
    """
    ends = np.cumsum(ks)
    rows = cut(rows.select("id", "cv", "clusters").withColumn("uid", F.monotonically_increasing_id()))
    sizes = {(r["at"], r["c"]): r["n"] for r in rows.select(F.posexplode("clusters").alias("at", "c")).groupBy("at", "c").agg(F.count("*").alias("n")).collect()}
    size = np.array([sizes.get((at, c), 0) for at, k in enumerate(ks) for c in range(k)], float)
    stripes = max(1, -(-rows.count() // STRIPE_ROWS))
    own = F.pmod("uid", F.lit(stripes)).cast("int")
    sent = rows.select("id", "uid", "cv", "clusters", own.alias("stripe"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("with"))
    sent = sent.withColumns({"p": F.least("stripe", "with"), "q": F.greatest("stripe", "with")})

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p, q = (k.as_py() for k in key)
        table = table.sort_by("uid")
        stripe = table.column("stripe").to_numpy()
        x = _matrix(table.column("cv").combine_chunks())
        places = _matrix(table.column("clusters").combine_chunks()).astype(int) + np.r_[0, ends[:-1]]
        onto = np.zeros((len(x), len(size)))
        np.put_along_axis(onto, places, 1.0, 1)
        square = (x**2).sum(1)
        a, b = np.flatnonzero(stripe == p), np.flatnonzero(stripe == q)
        to_a, to_b = np.zeros((len(a), len(size))), np.zeros((len(b), len(size)))
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 1024):
                u, v = a[i : i + 1024], b[j : j + 1024]
                apart = np.sqrt(np.maximum(square[u][:, None] + square[v] - 2 * x[u] @ x[v].T, 0))
                apart[u[:, None] == v] = 0
                to_a[i : i + 1024] += apart @ onto[v]
                to_b[j : j + 1024] += apart.T @ onto[u]
        out = [{"stripe": p, "sums": to_a.tobytes()}]
        if p == q:
            out[0] |= {"ids": table.column("id").to_pylist(), "clusters": table.column("clusters").to_pylist()}
        else:
            out.append({"stripe": q, "sums": to_b.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("stripe", pa.int32()), ("sums", pa.binary()), ("ids", pa.list_(pa.int64())), ("clusters", pa.list_(pa.list_(pa.int32())))]))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids, clusters = 0.0, [], []
        for batch in batches:
            for row in batch.select(["sums", "ids", "clusters"]).to_pylist():
                total = total + np.frombuffer(row["sums"]).reshape(-1, len(size))
                if row["ids"] is not None:
                    ids, clusters = row["ids"], row["clusters"]
        of = np.array(clusters, int)
        for at, (e, k) in enumerate(zip(ends, ks, strict=True)):
            own, n, sums = of[:, at], size[e - k : e], total[:, e - k : e]
            every = np.arange(len(own))
            within = sums[every, own] / np.maximum(n[own] - 1, 1)
            means = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
            means[every, own] = np.inf
            other = means.min(1)
            s = np.where((n[own] > 1) & np.isfinite(other), (np.where(np.isfinite(other), other, 0) - within) / np.maximum(np.maximum(np.where(np.isfinite(other), other, 0), within), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(own), at, np.int32)), pa.array(own, pa.int32()), pa.array(s)], ["id", "at", "cluster", "s"])

    sums = sent.groupBy("p", "q").applyInArrow(meet, "stripe int, sums binary, ids array<long>, clusters array<array<int>>")
    return sums.groupBy("stripe").applyInArrow(close, "id long, at int, cluster int, s double")


def silhouette_values(clustered: DataFrame) -> DataFrame:
    """(id, cluster, s) of clustered (id, cv, cluster) with any labels, null being one: see silhouettes. The labels, not the rows, come to the driver."""
    names = [r[0] for r in clustered.select("cluster").distinct().orderBy("cluster").collect()]
    spark = clustered.sparkSession
    numbers = spark.createDataFrame(list(enumerate(names)), f"c int, name {clustered.schema['cluster'].dataType.simpleString()}")
    rows = clustered.join(F.broadcast(numbers), F.col("cluster").eqNullSafe(F.col("name"))).select("id", "cv", F.array("c").alias("clusters"))
    out = silhouettes(rows, [len(names)]).select("id", F.col("cluster").alias("c"), "s")
    return out.join(F.broadcast(numbers), "c").select("id", F.col("name").alias("cluster"), "s")


def silhouette(clustered: DataFrame) -> float:
    """The mean silhouette by Euclidean distance of clustered (id, cv, cluster); a cluster of one row counts 0."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.max("n").alias("most")).first()
    if sizes["k"] < 2 or sizes["most"] < 2:
        raise ValueError("a silhouette needs at least two clusters and one that has two rows")
    return float(silhouette_values(clustered).agg(F.avg("s")).first()[0])


def sweep(vectors: DataFrame, k_min: int = 5, k_max: int = 12, starts: int = 10, seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette, smallest, median, largest) for each k: sizes stand beside the score, as a good score may rest on a tiny cluster."""
    ks = list(range(k_min, k_max + 1))
    rows = vectors.select("id", "cv").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = fit(rows, ks, starts, seed)
    finally:
        rows.unpersist()
    own = silhouettes(assign(vectors.select("id", "cv"), [best[k].centres for k in ks]), ks)
    by = own.groupBy("at", "cluster").agg(F.count("*").alias("n"), F.sum("s").alias("s")).groupBy("at")
    by = by.agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.min("n").alias("smallest"), F.percentile("n", F.lit(0.5)).cast("long").alias("median"), F.max("n").alias("largest"))
    costs = vectors.sparkSession.createDataFrame([(at, k, best[k].cost) for at, k in enumerate(ks)], "at int, k int, inertia double")
    return by.join(F.broadcast(costs), "at").select("k", "inertia", "silhouette", "smallest", "median", "largest").orderBy("k")


def exemplars(rows: DataFrame, per_cluster: int = 10, seed: int = 42) -> DataFrame:
    """(rank, cluster, n, share, shown, id, source, text): of each cluster, the largest first, per_cluster rows by lot in the order of their ids."""
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    sizes = sizes.crossJoin(total).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")))
    drawn = rows.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(lot(seed, F.col("id"))))).where(F.col("_r") <= per_cluster)
    out = drawn.join(F.broadcast(sizes), "cluster").select("rank", "cluster", "n", (F.col("n") / F.col("total") * 100).alias("share"), F.least("n", F.lit(per_cluster)).alias("shown"), "id", "source", T.collapse(F.col("text")).alias("text"))
    return out.orderBy("rank", "id")


def exemplar_text(chosen: DataFrame, k: int) -> str:
    """The exemplars as a markdown page; a page holds per_cluster rows for each of k clusters."""
    lines = [f"# Clusters at k={k}", ""]
    for rank, part in chosen.toPandas().groupby("rank", sort=True):
        one = part.iloc[0]
        lines += [f"## Cluster {rank} (id {one['cluster']}, n={one['n']:,}, {one['share']:.1f}%)", "", f"{one['shown']} of {one['n']:,} shown." if one["shown"] < one["n"] else f"All {one['n']} shown.", ""]
        lines += [f"- `{r['id']}` [{r['source']}] {r['text']}" for _, r in part.iterrows()] + [""]
    return "\n".join(lines)
