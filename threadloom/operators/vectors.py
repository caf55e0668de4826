"""Exact nearest neighbours of a stated query set, and votes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.forest import cut, release

#: Vectors are dealt to at most so many cells, the square root of their number; cells are cut into blocks of so many rows, and queries near one another into larger ones, as an item moves once for each of these.
CELLS, BLOCK, ASK_BLOCK = 1024, 1024, 4096
#: Cells are fitted on so many rows at most, and on fewer long ones; each query's k-th best of them is its floor.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 1 << 22
#: More than double precision loses in a product, relative to the lengths.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, max(1, len(x)), 4096)])


def centres(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """About k centres of x: evenly spaced rows, moved a few times to the mean of what is nearest."""
    out = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, out)
        n, total = np.bincount(own, minlength=len(out)), np.zeros_like(out)
        np.add.at(total, own, x)
        out[n > 0] = total[n > 0] / n[n > 0, None]
    return out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest score; -inf where there are fewer."""
    return np.full(len(scores), -np.inf) if scores.shape[1] < k else np.partition(scores, -k, 1)[:, -k]


def _ask(rows: DataFrame, sample: np.ndarray, keys: np.ndarray, middle: np.ndarray, group: np.ndarray, k: int) -> DataFrame:
    """rows (row, key, v) with cell, the group of its own, and reach: what the k-th best neighbour reaches at least, by a sample of the corpus."""
    sizes = np.sqrt((sample**2).sum(1)).max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column(2)), batch.column(1).to_numpy()
            floor = np.full(len(x), -np.inf)
            for i in range(0, len(x), 512):
                at = slice(i, i + 512)
                scores = np.where(own[at, None] == keys, -np.inf, x[at] @ sample.T) if len(keys) else x[at] @ sample.T
                floor[at] = _best(scores, k) - SLACK * (1 + sizes * np.sqrt((x[at] ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group[_nearest(x, middle)], pa.int32()), pa.array(floor)], ["row", "key", "v", "cell", "reach"])

    return rows.mapInArrow(run, "row long, key long, v array<double>, cell int, reach double")


def _deal(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """rows (row, key, v, item_id) with cell and reach, the distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            own = _nearest(x, middle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(np.sqrt(((x - middle[own]) ** 2).sum(1)))], [*batch.schema.names, "cell", "reach"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cell int, reach double")


def _blocks(rows: DataFrame, sizes: dict[int, int], order: str, most: int, probes=None) -> DataFrame:
    """(block, cell, rows, keys, vs, reaches, probes, asking, ids): cells cut into blocks by lot, rows of a block by order."""
    cuts = F.element_at(F.array(*[F.lit(-(-sizes.get(c, 0) // most) or 1) for c in range(max(sizes, default=0) + 1)]), F.col("cell") + 1)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x, reach = _matrix(table.column("v").combine_chunks()), table.column("reach").to_numpy()
        flat = [pa.array([v.tobytes()], pa.binary()) for v in (table.column("row").to_numpy(), table.column("key").to_numpy(), x, reach)]
        asking = probes(x, reach).sum(0) if probes else np.zeros(0, int)
        to, ids = np.flatnonzero(asking), table.column(order).combine_chunks()
        return pa.table([table.column("cell").slice(0, 1), *flat, pa.array([to.tolist()], pa.list_(pa.int32())), pa.array([asking[to].tolist()], pa.list_(pa.int64())), pa.array([ids.to_pylist()], pa.list_(ids.type))], names=["cell", "rows", "keys", "vs", "reaches", "probes", "asking", "ids"])

    kind = rows.schema[order].dataType.simpleString()
    packed = rows.withColumn("cut", F.pmod(F.xxhash64("row"), cuts)).groupBy("cell", "cut").applyInArrow(pack, f"cell int, rows binary, keys binary, vs binary, reaches binary, probes array<int>, asking array<long>, ids array<{kind}>")
    return cut(packed.withColumn("block", F.monotonically_increasing_id()))


def _compare(asks: DataFrame, items: DataFrame, size: int, k: int, keyed: bool, probes) -> DataFrame:
    """(q, c, similarity, item_id) of the pairs of blocks that asks' probes name: of each block the k best of each query that reach its floor."""
    named = items.select(F.col("cell").alias("probe"), F.col("rows").alias("cs"), F.col("keys").alias("cks"), F.col("vs").alias("xs"), "ids")
    pairs = asks.select("block", F.explode("probes").alias("probe")).join(named, "probe")
    pairs = pairs.join(asks.select("block", "rows", "keys", "vs", "reaches").hint("merge"), "block").select("probe", "rows", "keys", "vs", "reaches", "cs", "cks", "xs", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], []
            for r in batch.to_pylist():
                q, x = (np.frombuffer(r[n]).reshape(-1, size) for n in ("vs", "xs"))
                rows, cs, keys, cks = (np.frombuffer(r[n], np.int64) for n in ("rows", "cs", "keys", "cks"))
                reach = np.frombuffer(r["reaches"])
                asking = np.flatnonzero(probes(q, reach, r["probe"])[:, 0])
                q, rows, keys, reach = q[asking], rows[asking], keys[asking], reach[asking]
                scores = q @ x.T
                if keyed:
                    scores[keys[:, None] == cks] = -np.inf
                slack = SLACK * (1 + np.sqrt((q**2).sum(1) * (x**2).sum(1).max(initial=0)))
                floor = np.maximum(reach, _best(scores, k) - slack)
                a, b = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
                exact = np.cumsum(q[a] * x[b], axis=1)[:, -1] if len(a) else np.zeros(0)  # added in order, as dot does, so that equal vectors tie
                order = np.lexsort((b, -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
                place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                keep = place < k
                out.append((rows[a[keep]], cs[b[keep]], exact[keep]))
                ids += [r["ids"][i] for i in b[keep].tolist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([o[i] for o in out])) for i in range(3)), pa.array(ids, batch.schema.field("ids").type.value_type)], ["q", "c", "similarity", "item_id"])

    return pairs.mapInArrow(run, f"q long, c long, similarity double, item_id {items.schema['ids'].dataType.elementType.simpleString()}")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, exclude: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank) of the k most similar by dot product; ties by item_id; all where the corpus is smaller.

    queries (query_id, qv, ...) against all of corpus (item_id, cv, ...), vectors of one length; the
    columns of both stay, but for the vectors. exclude: a query column and a corpus column; pairs
    that are equal in these (by 64-bit hashes), or both null, don't count. Rows without a vector are
    left out.

    Exact without comparing all pairs: items lie in cells, a cell's product with a query is at most
    the centre's plus the query's length times the cell's radius, and a cell is compared only where
    this reaches the query's k-th best in a sample. Cells and queries are shuffled blocks; a block
    sends k rows for each query at most.
    """
    return neighbours(queries, corpus, k, exclude)[0]


def neighbours(queries: DataFrame, corpus: DataFrame, k: int, exclude: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(top_k's rows, (pairs, compared): how many pairs there are and how many were compared)."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    key = lambda at: F.xxhash64(F.col(exclude[at]).cast("string")) if exclude else F.lit(0).cast("long")
    asked = cut(queries.where("qv is not null").select("*", key(0).alias("_qk"), F.monotonically_increasing_id().alias("_q")))
    held = cut(corpus.where("cv is not null").select("*", key(1).alias("_ck"), F.monotonically_increasing_id().alias("_c")))
    n, of = held.agg(F.count("*"), F.max(F.size("cv"))).first()
    asked_n = asked.count()
    if not n or not asked_n:
        none = asked.drop("_q", "_qk", "qv").crossJoin(held.drop("_c", "_ck", "cv")).limit(0)
        return none.select("*", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")), spark.createDataFrame([(0, 0)], "pairs long, compared long")
    limit = min(SAMPLE_ROWS, max(256, SAMPLE_NUMBERS // of))
    drawn = held.orderBy(F.xxhash64("_c")).limit(limit).select("cv", "_ck").toArrow()
    sample = _matrix(drawn.column("cv").combine_chunks())
    middle = centres(sample, min(CELLS, max(1, int(np.sqrt(n)))))
    items = cut(_deal(held.select(F.col("_c").alias("row"), F.col("_ck").alias("key"), F.col("cv").cast("array<double>").alias("v"), "item_id"), middle))
    cells = {r["cell"]: r for r in items.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()}  # a row for each cell
    radius = np.array([cells[c]["reach"] if c in cells else -np.inf for c in range(len(middle))])
    sizes = np.sqrt((middle**2).sum(1)).max()

    def probes(x: np.ndarray, floor: np.ndarray, cell: int | None = None) -> np.ndarray:
        """(queries, cells): whether the cell, or each, can hold a neighbour that reaches the query's floor."""
        of = slice(None) if cell is None else slice(cell, cell + 1)
        length = np.sqrt((x**2).sum(1))
        there = np.isfinite(radius[of])
        most = x @ middle[of].T + length[:, None] * np.where(there, radius[of], 0) + SLACK * (1 + length * sizes)[:, None]
        return there & (most >= floor[:, None])

    group = _nearest(middle, centres(middle, -(-asked_n // ASK_BLOCK)))
    rows = cut(_ask(asked.select(F.col("_q").alias("row"), F.col("_qk").alias("key"), F.col("qv").cast("array<double>").alias("v")), sample, drawn.column("_ck").to_numpy() if exclude else np.zeros(0), middle, group, k))
    per = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    asks = _blocks(rows, per, "row", ASK_BLOCK, probes)
    blocks = _blocks(items, {c: r["n"] for c, r in cells.items()}, "item_id", BLOCK)
    release(items, rows)
    each = asks.select(F.explode(F.arrays_zip(F.col("probes").alias("cell"), F.col("asking").alias("m"))).alias("e")).select("e.cell", "e.m").join(F.broadcast(spark.createDataFrame([(c, r["n"]) for c, r in cells.items()], "cell int, n long")), "cell")
    share = each.agg(F.lit(asked_n * n).cast("long").alias("pairs"), F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).cast("long").alias("compared"))
    best = _compare(asks, blocks, of, k, exclude is not None, probes)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "item_id"))
    out = best.withColumn("rank", rank).where(F.col("rank") <= k)
    if more := [c for c in corpus.columns if c not in ("item_id", "cv")]:
        out = out.join(held.select(F.col("_c").alias("c"), *more), "c")
    out = out.join(asked.drop("qv", "_qk"), F.col("q") == F.col("_q"))
    return out.select(*[c for c in queries.columns if c != "qv"], "item_id", *more, "similarity", "rank"), share


def vote(neighbours: DataFrame) -> DataFrame:
    """(query_id, label, votes, best): most votes; ties by the highest single similarity, then by label."""
    by = neighbours.groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.max("similarity").alias("best"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), F.desc("best"), "label"))
    return by.withColumn("r", rank).where("r = 1").drop("r")


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(low, high, n, share): bins closed on the left, the last one on both sides; empty bins too."""
    spark = values.sparkSession
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    x = F.col(column)
    which = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        which = F.when((x >= a) & ((x <= b) if i == len(edges) - 2 else (x < b)), i).otherwise(which)
    counts = values.select(which.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = values.agg(F.count("*").alias("total"))
    out = F.broadcast(bins).join(counts, "bin", "left").crossJoin(total)
    return out.select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), "total"), F.lit(0.0)).alias("share"))
