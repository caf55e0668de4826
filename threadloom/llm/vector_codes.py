"""Vector codes: integer product quantisation, each part coded by a vantage-point tree over its codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import written

#: Entries that a leaf compares one by one.
LEAF = 6
#: Whole numbers end here, so that squared distances and their sums stay exact in 64 bits.
LARGEST = 1 << 24
#: Labels whose sums are sent to all tasks at most; more are joined by shuffle.
BROADCAST_LABELS = 100_000
_UP, _DOWN = 1 + 2.0**-48, 1 - 2.0**-48


@dataclass
class Node:
    """A vantage entry, and the distances from it (rounded outwards) of the entries near it and far from it."""

    entry: int
    near: Node | None
    far: Node | None
    near_to: float
    far_from: float
    far_to: float
    leaf: np.ndarray


def tree(entries: np.ndarray, which: np.ndarray | None = None) -> Node:
    """The vantage-point tree over entries (whole numbers, one a row)."""
    which = np.arange(len(entries)) if which is None else which
    if len(which) <= LEAF:
        return Node(-1, None, None, 0.0, 0.0, 0.0, which)
    first, rest = which[0], which[1:]
    apart = np.sqrt(((entries[rest] - entries[first]) ** 2).sum(1).astype(float))
    order = np.argsort(apart, kind="stable")
    half = len(rest) // 2
    near, far = order[:half], order[half:]
    return Node(int(first), tree(entries, rest[near]), tree(entries, rest[far]), float(apart[near].max()) * _UP, float(apart[far].min()) * _DOWN, float(apart[far].max()) * _UP, which[:0])


def nearest(node: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point's nearest entry, the lower entry of equally near ones.

    Branch and bound: a subtree is left out only where its nearest possible distance, rounded down,
    exceeds the best one, rounded up; an equal bound is visited. Distances that decide are whole numbers.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.full(len(points), len(entries), np.int64)

    def compare(at: np.ndarray, e: int) -> np.ndarray:
        apart = ((points[at] - entries[e]) ** 2).sum(1)
        better = (apart < best[at]) | ((apart == best[at]) & (e < entry[at]))
        best[at[better]], entry[at[better]] = apart[better], e
        return apart

    def visit(n: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if n.near is None:
            for e in n.leaf.tolist():
                compare(at, e)
            return
        away = np.sqrt(compare(at, n.entry).astype(float))
        low, high = away * _DOWN, away * _UP
        to_near = np.maximum(low - n.near_to, 0) * _DOWN
        to_far = np.maximum(np.maximum(n.far_from - high, low - n.far_to), 0) * _DOWN
        inside = away <= n.near_to
        for side in (inside, ~inside):
            for child, bound in ((n.near, to_near), (n.far, to_far))[:: 1 if side is inside else -1]:
                visit(child, at[side][bound[side] <= np.sqrt(best[at[side]].astype(float)) * _UP])

    visit(node, np.arange(len(points)))
    return entry, best


def whole(vector: Column, scale: int) -> Column:
    """Each component times scale, rounded down, at most LARGEST in size; null where one is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")) & ~F.isnan(v), F.lit(False)))
    bound = lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return F.when(finite, F.transform(x, bound))


def _points(batch: pa.RecordBatch, name: str, parts: int) -> np.ndarray:
    """(rows, parts, components of a part) of a batch of whole-number vectors."""
    values = batch.column(batch.schema.names.index(name))
    return values.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, parts, -1)


def _sums(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, total): of the parts that each entry is nearest to; a task adds its own up before they move."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _points(batch, "_x", parts)
            for p in range(parts):
                at, _ = nearest(trees[p], books[p], x[:, p])
                n[p] += np.bincount(at, minlength=entries)
                for j in range(width):
                    np.add.at(total[p, :, j], at, x[:, p, j])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    made = vectors.select("_x").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return made.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("total"))


def _size(vectors: DataFrame, parts: int) -> int | None:
    """The most frequent length that parts divides, the larger of equally frequent ones."""
    sizes = vectors.groupBy(F.size("_x").alias("size")).agg(F.count("*").alias("n")).where((F.col("size") > 0) & (F.col("size") % parts == 0))
    found = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return found["size"] if found else None


def train(vectors: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part from vectors (_id, _x): entries begin as the parts of the rows of least _id and move to the mean, rounded down, of what they are nearest to."""
    start = vectors.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(entries).select("_x").collect()
    first = np.array([r[0] for r in start], np.int64).reshape(len(start), parts, -1)
    books = [first[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        for r in _sums(vectors, books).collect():  # at most parts x entries x components of a part
            books[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error, codebooks_sha256) of each kept row of vectors, the codebooks).

    A row whose vector is null, or holds a null or a component that isn't finite, is dropped. So is
    one whose length isn't the most frequent of the lengths that parts divides: it has no parts to
    compare. Components beyond LARGEST / scale count as that. Repeated rows and ids each count;
    rows of one id are in the order of their vectors and null ids come last. Fewer rows than entries
    make as many entries; no rows give an empty table. label_error is null beyond 64 bits; null
    labels are one label. Other columns of vectors are not read. Each round and the coding read the
    vectors once; codes are written to the shared folder before labels are summed.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), whole(F.col(vector_col), scale).alias("_x")).where("_x is not null")
    size = _size(rows, parts)
    rows = rows.where(F.size("_x") == (size or 0))
    books = train(rows, parts, entries, rounds) if size else []
    name = digest(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [tree(b) for b in books]
        for batch in batches:
            x = _points(batch, "_x", parts)
            found = [nearest(t, b, x[:, p]) for p, (t, b) in enumerate(zip(trees, books, strict=True))]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            error = np.sum([f[1] for f in found], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"vec_id {kinds['_id']}, label {kinds['_label']}, code string, error long"
    coded = written(rows.select("_id", "_label", "_x").mapInArrow(run, schema), "codes") if size else spark.createDataFrame([], schema)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    return out.withColumn("codebooks_sha256", F.lit(name)), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, 2 rounds, components times 256."""
    out, _ = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_ROUND = """
d{r} AS (SELECT x.vec_id, x.p, e.e, sum((x.v - e.v) * (x.v - e.v)) AS d FROM x JOIN e{r} e ON e.p = x.p AND e.j = x.j GROUP BY ALL),
a{r} AS (SELECT vec_id, p, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
_MOVE = """,
e{n} AS (SELECT e.p, e.e, e.j, coalesce(m.v, e.v) AS v FROM e{r} e LEFT JOIN (SELECT p, e, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS v FROM (SELECT a.p, a.e, x.j, sum(x.v)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL)) m USING (p, e, j)),"""
OP11_SQL = (
    """WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, (i - 1) // (len(embedding) // 16) AS p, (i - 1) % (len(embedding) // 16) AS j, floor(256 * embedding[i]::DOUBLE)::BIGINT AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64),
e0 AS (SELECT p, s.e, j, v FROM x JOIN s USING (vec_id)),"""
    + "".join(_ROUND.format(r=r) + (_MOVE.format(r=r, n=r + 1) if r < 2 else "") for r in range(3))
    + """,
c AS (SELECT vec_id, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM e2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""
)
