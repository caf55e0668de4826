"""Near-duplicate embeddings: product quantisation in coarse lists, table-lookup distances, exact cosines.

A vector is coded as its list's centroid and a codeword for each part of what the centroid leaves,
with the error of that code. A pair of unit vectors with a cosine of `least` or more is at most
r = sqrt(2 - 2 least) apart, which bounds both steps of the search:

* lists: if y is in list b and no further than r from x, then x lies no further than r beyond the
  plane between the centroids of its own list a and of b; x probes the lists where that holds;
* codes: the looked-up distance from x to y's code is at most r plus the error of the code.

So no pair is lost, whatever the centroids and codewords are; they decide only how many pairs are
looked up and how many cosines are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import components, discard, written

#: Rows of a block of a list, on average; two blocks are compared at a time.
BLOCK = 1024
#: Rows of a list aimed at, and the most lists that each label's vectors are dealt to.
LIST_ROWS, MOST_LISTS = 256, 4096
#: The index is fitted on about this many vectors, 16 for each list, within these bounds; and on fewer long ones.
SAMPLE, SAMPLE_NUMBERS = (8_192, 65_536), 1 << 22
BROADCAST_LISTS = 100_000
#: Added to bounds, far more than double precision loses in them.
SLACK = 1e-4


@dataclass
class Index:
    """Centroids (lists, size) and codewords (parts, words, size of a part)."""

    centroids: np.ndarray
    words: np.ndarray

    @property
    def width(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, squared length of what the code stands for, distance of the code)."""
        rest = (x - self.centroids[lists]).reshape(len(x), *self.words.shape[::2])
        codes = np.stack([nearest(rest[:, p], w) for p, w in enumerate(self.words)], 1)
        coded = self.centroids[lists] + np.stack([w[codes[:, p]] for p, w in enumerate(self.words)], 1).reshape(len(x), -1)
        return codes.astype(np.uint8), (coded**2).sum(1), np.sqrt(((x - coded) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: int, r: float) -> np.ndarray:
        """(rows, lists): whether a vector of the list can be within r of x, all of whose rows are in list own."""
        c = self.centroids
        lead = x @ (c - c[own]).T + r * np.sqrt(((c - c[own]) ** 2).sum(1))
        return lead >= ((c**2).sum(1) - (c[own] ** 2).sum()) / 2 - SLACK

    def tables(self, x: np.ndarray) -> np.ndarray:
        """(parts, rows, words): products of x's parts with the codewords."""
        return np.einsum("npd,pwd->pnw", x.reshape(len(x), *self.words.shape[::2]), self.words).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, max(1, len(x)), 4096)])


def lloyd(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres of x by Lloyd's steps from evenly spaced rows; an unused centre stays."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def fit(x: np.ndarray, lists: int, parts: int = 16, words: int = 256) -> Index:
    """The index of unit vectors x, a bounded sample; rows are filled with zeros to a multiple of parts."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    centroids = lloyd(x, lists)
    blank = Index(centroids, np.zeros((parts, 1, x.shape[1] // parts)))
    rest = (x - centroids[blank.lists(x)]).reshape(len(x), parts, -1)
    return Index(centroids, np.stack([lloyd(rest[:, p], words) for p in range(parts)]))


def valid(vector: Column) -> Column:
    """Not null, empty or zero, and without nulls and components that aren't finite."""
    finite = lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")) & ~F.isnan(v), F.lit(False))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda v: v != 0), F.lit(False))


def unit(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1 in double precision, filled to width with zeros, their sizes)."""
    sizes = vectors.value_lengths().to_numpy().astype(np.int32)
    x = np.zeros((len(sizes), width))
    x[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    x /= np.abs(x).max(1, initial=0)[:, None]  # squares of huge or tiny components stay finite
    return x / np.sqrt((x**2).sum(1))[:, None], sizes


def _rows(column: pa.Array) -> np.ndarray:
    """Equally long binary values as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _encode(classes: DataFrame, index: Index) -> DataFrame:
    """classes (uid, label, w, v) with dim, list, code, square, error; x as bytes, filled to the index's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dims = unit(batch.column(3), index.width)
            lists = index.lists(x)
            codes, square, error = index.codes(x, lists)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(dims, pa.int32()), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(square), pa.array(error)],
                ["uid", "label", "w", "x", "dim", "list", "code", "square", "error"],
            )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("uid", "label", "w", "v").mapInArrow(run, f"uid long, label {label}, w long, x binary, dim int, list int, code binary, square double, error double")


def _blocks(coded: DataFrame, index: Index, r: float) -> DataFrame:
    """(block, label, dim, list, uids, codes, squares, errors, xs, probes): lists cut by lot into blocks of about BLOCK rows.

    probes: the higher lists that any row of the block probes, and its own.
    """
    large = coded.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / BLOCK).alias("cuts")).where("cuts > 1")
    large = large.withColumnsRenamed({"label": "_l", "dim": "_d", "list": "_i"})
    large = F.broadcast(large) if large.count() <= BROADCAST_LISTS else large
    cut = coded.join(large, F.col("label").eqNullSafe(F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("list") == F.col("_i")), "left")
    cut = cut.select("uid", "label", "dim", "list", F.pmod(F.xxhash64("uid"), F.coalesce("cuts", F.lit(1))).alias("cut"), "code", "square", "error", "x")

    def pack(table: pa.Table) -> pa.Table:
        own = table.column("list")[0].as_py()
        x = _rows(table.column("x").combine_chunks())
        to = np.flatnonzero(index.probes(x, own, r).any(0))
        whole = lambda name, kind: pa.array([table.column(name).to_numpy().astype(kind).tobytes()], pa.binary())
        flat = lambda name: pa.array([b"".join(table.column(name).to_pylist())], pa.binary())
        return pa.table(
            [table.column("label").slice(0, 1), table.column("dim").slice(0, 1), table.column("list").slice(0, 1), whole("uid", np.int64), flat("code"), whole("square", np.float64), whole("error", np.float64), flat("x"), pa.array([np.union1d(to[to > own], own).tolist()], pa.list_(pa.int32()))],
            names=["label", "dim", "list", "uids", "codes", "squares", "errors", "xs", "probes"],
        )

    label = coded.schema["label"].dataType.simpleString()
    packed = cut.groupBy("label", "dim", "list", "cut").applyInArrow(pack, f"label {label}, dim int, list int, uids binary, codes binary, squares binary, errors binary, xs binary, probes array<int>")
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _candidates(blocks: DataFrame, index: Index, r: float) -> DataFrame:
    """(block, other, a, b): of two blocks, the rows (uids) with a looked-up distance that a near pair can have. Neither block of a pair moves with its vectors more than once."""
    lists = blocks.select("label", "dim", F.col("list").alias("probe"), F.col("block").alias("other"), "uids", "codes", "squares", "errors")
    asks = blocks.select("block", "label", "dim", F.col("list").alias("own"), F.explode("probes").alias("probe"))
    pairs = asks.join(lists, ["label", "dim", "probe"]).where("probe > own or other >= block")
    pairs = pairs.join(blocks.select("block", "xs", F.col("uids").alias("own_uids")).hint("merge"), "block").select("block", "other", "own", "probe", "xs", "own_uids", "uids", "codes", "squares", "errors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] != last:
                    x = np.frombuffer(row["xs"], np.float64).reshape(-1, index.width)
                    last, held = row["block"], (x, index.tables(x), index.probes(x, row["own"], r), np.frombuffer(row["own_uids"], np.int64))
                x, tables, probes, own = held
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(tables))
                rows = np.flatnonzero(probes[:, row["probe"]])
                product = np.repeat((x[rows] @ index.centroids[row["probe"]])[:, None], len(codes), 1)
                for p, t in enumerate(tables):
                    product += np.take(t[rows], codes[:, p], axis=1)
                reach = (r + np.frombuffer(row["errors"], np.float64) + SLACK) ** 2
                near = 1 + np.frombuffer(row["squares"], np.float64) - 2 * product <= reach + SLACK
                if row["block"] == row["other"]:
                    near[np.arange(len(rows)), rows] = False
                a, b = near.any(1), near.any(0)
                if a.any():
                    out.append((row["block"], row["other"], own[rows[a]].tolist(), np.frombuffer(row["uids"], np.int64)[b].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["block", "other", "a", "b"])

    return pairs.mapInArrow(run, "block long, other long, a array<long>, b array<long>")


def reached(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of near: the least place (columns come after rows) that links lead to."""
    n, m = near.shape
    rows, columns = np.arange(n), np.arange(n, n + m)
    while True:
        new_columns = np.minimum(columns, np.where(near, rows[:, None], n + m).min(0, initial=n + m))
        new_rows = np.minimum(rows, np.where(near, new_columns, n + m).min(1, initial=n + m))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _verify(found: DataFrame, coded: DataFrame, least: float) -> DataFrame:
    """(uid, links, to): exact cosines of the rows of candidates of two blocks; links: weights of a row's own, to: a uid that they lead to."""
    one = lambda c, side: found.select("block", "other", F.lit(side).alias("side"), F.explode(c).alias("uid"))
    rows = one("a", 0).union(one("b", 1)).join(coded.select("uid", "w", "x"), "uid")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side, uid, w = (table.column(c).to_numpy() for c in ("side", "uid", "w"))
        x = _rows(table.column("x").combine_chunks())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = (x[a] @ x[b].T >= least) & (uid[a][:, None] != uid[b][None, :])
        rows, columns = reached(near)
        links = np.r_[near @ w[b], w[a] @ near]
        if key[0].as_py() == key[1].as_py():  # both sides hold a row of this block's own pairs; the first side counts
            links[len(a) :] = 0
        at = np.r_[a, b]
        to, own = uid[at][np.r_[rows, columns]], uid[at]
        keep = (links > 0) | (to != own)
        return pa.table([pa.array(own[keep]), pa.array(links[keep].astype(np.int64)), pa.array(to[keep])], names=["uid", "links", "to"])

    return rows.groupBy("block", "other").applyInArrow(run, "uid long, links long, to long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors: links are cosines of at least `least` between rows of one label.

    Exact: see the module's text. A null label, and a vector that is null, empty or zero, or holds a
    null or a component that isn't finite, link with nothing; vectors of different lengths don't link
    with each other. Equal vectors of one label are one class, counted and not compared. Rows of one
    id count singly; a null id comes after all others, so that component_id is null only where all of
    a component's are. An empty table gives an empty table; other columns of vectors are not read.

    The index is fitted on a bounded sample (SAMPLE), and each vector is indexed. No pairs are
    written: two blocks yield rows, and links are counted where they are found. Vectors in blocks that
    hold a candidate move again, so near copies (not equal ones) that number m cost m * m / BLOCK rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    keys = (F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "v", "label"))  # 128 bits stand for a class
    rows = rows.withColumns({"valid": F.col("label").isNotNull() & valid(F.col("v")), "k1": keys[0], "k2": keys[1]})
    classes = rows.where("valid").groupBy("k1", "k2").agg(F.any_value("label").alias("label"), F.any_value("v").cast("array<double>").alias("v"), F.count("*").alias("w"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    of = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    bare = rows.select("vec_id", "k1", "k2", "valid")
    if not of["n"]:
        return bare.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists = min(max(1, of["most"] // LIST_ROWS), MOST_LISTS)
    size = classes.agg(F.max(F.size("v"))).first()[0]
    wanted = min(max(SAMPLE[0], 16 * lists), SAMPLE[1], max(1024, SAMPLE_NUMBERS // size))
    lot = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30))
    drawn = classes.where(lot <= (wanted << 30) // of["n"]).select("k1", "v").limit(2 * wanted).toArrow().sort_by("k1")
    drawn = drawn if drawn.num_rows else classes.select("k1", "v").limit(1).toArrow()
    sample, _ = unit(drawn.column("v").combine_chunks(), size)
    index, r = fit(sample, lists), float(np.sqrt(max(0.0, 2 - 2 * least)))
    coded = written(_encode(classes, index), "coded")
    blocks = _blocks(coded, index, r)
    found = written(_candidates(blocks, index, r), "candidates")
    links = written(_verify(found, coded, least), "links")
    discard(blocks, found, coded)
    joined = components(links.where("uid <> `to`"), "uid", "to").select(F.col("node").alias("uid"), "component")
    counted = links.groupBy("uid").agg(F.sum("links").alias("links"))
    out = classes.select("uid", "k1", "k2", "w", "first").join(counted, "uid", "left").join(joined, "uid", "left")
    out = out.select(F.coalesce("component", "uid").alias("component"), "k1", "k2", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "first")
    lead = out.groupBy("component").agg(F.min("first").alias("lead"))
    out = out.join(lead, "component").select("k1", "k2", "links", "lead", F.lit(True).alias("valid"))
    out = bare.join(out, ["k1", "k2", "valid"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("valid"), F.col("lead")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near duplicates of all embeddings: cosine 0.98 or more within a label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)"""
