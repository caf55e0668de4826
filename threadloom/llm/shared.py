"""What the corpus operators share: the cluster's shared folder, materialised steps, packed text
blocks, vectorised word hashing and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands for a null id inside packed blocks; it sorts after every real id.
NULL_ID = 2**63 - 1
BLOCK_BYTES = 4 << 20
#: Bits of a block's number in its partition, and of a row's place in its block.
BLOCK_BITS, PLACE_BITS = 20, 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and Spark runs locally, a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


#: Paths (with a table's name, if one is there) that written and its like have made in the open scope.
_scope: ContextVar[list | None] = ContextVar("scope", default=None)


@contextmanager
def scope():
    """Collects what is written inside, for delete()."""
    made: list[tuple[str, str | None]] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)


def delete(spark: SparkSession, made: list[tuple[str, str | None]]) -> None:
    """Delete files and tables that nothing reads any more."""
    for path, table in made:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of ended steps: it does once a plan is garbage, which a driver with free memory seldom collects."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete what written, bucketed or pack made for these frames."""
    delete(frames[0].sparkSession, [f.made for f in frames])


def _kept(frame: DataFrame, path: str, table: str | None = None) -> DataFrame:
    frame.made = (path, table)
    if (made := _scope.get()) is not None:
        made.append(frame.made)
    return frame


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return _kept(spark.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written, in buckets of key: a join by key moves the other side only."""
    spark = df.sparkSession
    path, table = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", f"{name}_{uuid.uuid4().hex}"
    n = min(max(1, partitions(spark)), 100_000)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return _kept(spark.table(table), path, table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def places(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """df with name, each row's place from 0 in its group by order. A large group is cut into ranges, so that no task holds it whole."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), F.col(group).asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0").drop("_n")
    out = ranged.join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    return out.withColumn(name, own + F.coalesce("_before", F.lit(0))).drop("_g", "_r", "_range", "_before")


# --- packed blocks -----------------------------------------------------------------------------

def pack(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts as UTF-8, joined into blocks of about block_bytes, in a table bucketed by block_id.

    A later join with rows keyed by block_id moves those rows only, never the text. In a block,
    documents are in the order of their ids, nulls last. One long document makes one long block.
    The columns in carry go along, as an array of structs.
    """
    spark = docs.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, size = first_block(TaskContext.get().partitionId()), 0, [], 0

        def emit(parts: list[pa.RecordBatch]):
            nonlocal made
            table = pa.Table.from_batches(parts).combine_chunks()
            more = pa.concat_arrays(table.column(2).chunks) if carry else None
            ids = pc.fill_null(table.column(0).combine_chunks(), NULL_ID)
            order = pc.sort_indices(ids)
            ids = ids.take(order).to_numpy()
            texts = pc.fill_null(table.column(1).combine_chunks().cast(pa.large_binary()), b"").take(order)
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.combine_chunks()
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            buffer = texts.buffers()[2]
            data = memoryview(buffer) if buffer is not None else memoryview(b"")
            start = 0
            while start < len(ids):
                end = int(np.searchsorted(offsets, offsets[start] + block_bytes, "right")) - 1
                end = min(max(end, start + 1), len(ids), start + (1 << PLACE_BITS))
                if made == 1 << BLOCK_BITS:
                    raise ValueError("a partition has more blocks than ids for them: split the input finer")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + made], pa.int64()),
                        pa.array([ids[start:end]], pa.list_(pa.int64())),
                        pa.array([(offsets[start : end + 1] - offsets[start]).tobytes()], pa.binary()),
                        pa.array([bytes(data[offsets[start] : offsets[end]])], pa.binary()),
                        *([pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), pc.take(more, order[start:end]))] if carry else []),
                    ],
                    ["block_id", "ids", "offsets", "data", *["carry"] * bool(carry)],
                )
                made += 1
                start = end

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 4 * block_bytes:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    path, table = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}", f"blocks_{uuid.uuid4().hex}"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*carry).alias("carry")] if carry else []))
    fields = [("block_id", "long"), ("ids", "array<long>"), ("offsets", "binary"), ("data", "binary")]
    if carry:
        fields.append(("carry", f"array<{source.schema['carry'].dataType.simpleString()}>"))
    (
        source.mapInArrow(blocks, ", ".join(f"{n} {t}" for n, t in fields))
        .write.bucketBy(min(max(1, partitions(spark)), 100_000), "block_id")
        .option("path", path)
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(table)
    )
    return _kept(spark.table(table), path, table)


def first_block(partition: int) -> int:
    """Id of a partition's first block; ids of blocks and rows are 63-bit numbers up to partition 2^23."""
    if partition >> (63 - BLOCK_BITS - PLACE_BITS):
        raise ValueError("the input has more partitions than ids for them")
    return partition << BLOCK_BITS


def row_ids(block_id: int, rows: int) -> np.ndarray:
    """A number for each row of a block that no other row has."""
    return (block_id << PLACE_BITS) + np.arange(rows)


class Block:
    """One packed block inside a Python worker."""

    def __init__(self, block_id: int, ids, offsets: bytes, data: bytes):
        self.block_id, self.data = block_id, data
        self.ids = np.asarray(ids, np.int64)
        self.offsets = np.frombuffer(offsets, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)


def each_block(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(Block, further columns' values...) of each row."""
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)) for c in ("block_id", "ids", "offsets", "data", *more)]
        for i in range(batch.num_rows):
            ids = columns[1][i].values.to_numpy()
            yield (Block(columns[0][i].as_py(), ids, columns[2][i].as_py(), columns[3][i].as_py()), *(c[i].as_py() for c in columns[4:]))


def bucket_count(blocks: DataFrame, bytes_each: int = 4 << 20) -> int:
    """How many key buckets keep a bucket's share of the input near bytes_each."""
    total = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    return int(max(8, -(-total // bytes_each)))


def split_by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its keys) of each bucket that has keys."""
    which = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    there, first = np.unique(which[order], return_index=True)
    bounds = [*first.tolist(), len(order)]
    return [(b, order[x:y]) for b, x, y in zip(there.tolist(), bounds, bounds[1:], strict=False)]


# --- hashing -----------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """The first n powers of the rolling hash's base, or of its inverse."""
    if len(_powers[sign]) < n:
        steps = np.full(max(n, 1 << 16), _ODD if sign == 1 else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[sign] = np.cumprod(steps, dtype=np.uint64)
    return _powers[sign][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Rolling-hash sums: spans(sums, a, b) hashes values[a:b]."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    top = int(starts.max()) + 1 if len(starts) else 1
    return mix((sums[ends] - sums[starts]) * powers(top, -1)[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(block: Block, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, with its document's place in the block, and each document's first word."""
    data = _LOWER[block.bytes]
    blank = space[data]
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(block.ids) + 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[block.offsets] = True
    starts = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
    hashes = spans(prefix_sums(data), starts, ends)
    first = np.searchsorted(starts, block.offsets)
    return hashes, np.repeat(np.arange(len(block.ids)), np.diff(first)), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted by (document, hash), and each document's first.

    A document of fewer than k words has its whole sequence as one shingle, an empty one has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.repeat(first[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    sums = prefix_sums(hashes)
    out = spans(sums, at, at + np.minimum(counts[doc], k)) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((out, doc))
    out = out[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.searchsorted(doc[keep], np.arange(len(counts) + 1))


# --- connected components ----------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of edges (long, not null) reaches.

    Large-star and small-star rounds until no link changes. Minima are partially aggregated before
    they move and the joins can be split, so a hub's links never meet in one task; each round is
    written to the shared folder.
    """
    links = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u <> v").distinct()
    links = written(links, "links")
    count = links.count()
    while count:
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).union(links.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u")))
        new = written(small.where("u <> v").distinct(), "links")
        was, count = count, new.count()
        same = count == was and not new.join(links, ["u", "v"], "left_anti").limit(1).count()
        discard(links)
        links = new
        if same:
            break
    labels = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return labels.union(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
