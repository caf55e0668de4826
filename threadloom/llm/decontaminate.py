"""Benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from threadloom.llm.license_scan import inner_words, word_array, word_parts
from threadloom.llm.shared import Block, mix, written
from threadloom.llm.shared import words as hashed_words

SHINGLE = 5
#: Fingerprints within this Hamming distance are candidates: at a similarity of 0.8 windows differ
#: in 10 of 64 bits on average (standard deviation 3), so 21 is beyond what a window comes to.
RADIUS = 21
SIMILAR = 0.8
#: Blocks of 16 bits that the multi-index cuts fingerprints into, and items that one of its tables holds.
BLOCKS, GROUP = 4, 8
#: Places of which the windows are fingerprinted at once (their sums fit a core's cache), and bytes of documents laid end to end.
STEP, ROW_BYTES = 16384, 3 << 20
#: Places of a text in a row of running sums, if no window is longer than a fourth of that.
STRETCH = 1024
#: Bytes of texts whose shingles one task adds up.
TASK_BYTES = 2 << 20
#: Items, and characters of items, that a pass over the documents compares them with.
BLOCK_ITEMS, BLOCK_CHARS = 256, 1_000_000
#: Bytes of UTF-8 between words: ASCII beyond digits and (lower-cased) letters.
_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def shingle_rows(words: str, k: int = SHINGLE) -> Column:
    """array(struct) of k consecutive words each; nothing for fewer than k words."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)])


def once(value: Column) -> Column:
    """value as a generated column, which the optimizer doesn't copy into each place that uses it."""
    return F.explode(F.array(value))


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array of hashes, each counted as often as it occurs."""
    ones = lambda bit: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, bit).cast("int"))
    bit = lambda b: F.when(2 * ones(b) > F.size(hashes), 1).otherwise(0).cast("long")
    # The highest bit comes first; each step moves what is there up by one.
    return F.aggregate(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(bit(b)))


def index_blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """radius + 1 (number, value) blocks of the 64 bits: fingerprints within radius agree in one at least."""
    n, at, out = radius + 1, 0, []
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        value = F.shiftrightunsigned(F.col(fingerprint), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of the lesser over the sum of the greater counts of each hash."""
    count = lambda xs, y: F.size(F.filter(xs, lambda x: x == y))
    both = F.array_intersect(a, b)
    # Where one side repeats nothing, each common hash counts once.
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda s, y: s + F.least(count(F.col(a), y), count(F.col(b), y))))
    return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item_id, n, item_grams) of the items of at least SHINGLE words."""
    items = benchmark.select(F.col(item_col).alias("item_id"), word_array(F.col(item_text).cast("string")).alias("words")).where(F.size("words") >= SHINGLE)
    return items.select("item_id", F.size("words").alias("n"), _all_hashed("words").alias("item_grams"))


def _all_hashed(words: str) -> Column:
    return F.transform(shingle_rows(words), lambda g: F.xxhash64(*[g[f"w{i}"] for i in range(SHINGLE)]))


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts end to end, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    words, _, first = hashed_words(Block(0, np.zeros(len(texts), np.int64), (offsets - offsets[0]).tobytes(), data), _SEPARATORS)
    n = max(len(words) - SHINGLE + 1, 0)
    out, inside = np.zeros(n, np.uint64), np.ones(len(words), bool)
    for i in range(SHINGLE):
        out = mix(out + words[i : i + n])
    for i in range(1, SHINGLE):
        inside[np.maximum(first[1:] - i, first[:-1])[first[1:] > first[:-1]]] = False
    return out[inside[:n]].view(np.int64), np.maximum(np.diff(first) - SHINGLE + 1, 0)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Of each hash its 64 bits, lowest first, as 1 and -1."""
    return (np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).view(np.int8) << 1) - np.int8(1)


def _packed(ones: np.ndarray) -> np.ndarray:
    return np.packbits(ones.reshape(-1), bitorder="little").view(np.uint64)


class _Index:
    """Multi-index of some items' fingerprints, by item size.

    A fingerprint within radius of another is within radius // BLOCKS of it in one 16-bit block at
    least. A table for each block says of each value which items (one bit each, GROUP in a table) it
    is that near to.
    """

    def __init__(self, grams: list[np.ndarray], radius: int):
        self.counts = [np.unique(g, return_counts=True) for g in grams]
        self.known = np.unique(np.concatenate(grams))
        self.longest = max(map(len, grams))
        near = np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= radius // BLOCKS).astype(np.uint16)
        sizes: dict[int, list[int]] = {}
        for j, g in enumerate(grams):
            sizes.setdefault(len(g), []).append(j)
        self.sizes = []
        for m, items in sorted(sizes.items()):
            groups = []
            for first in range(0, len(items), GROUP):
                table, prints = np.zeros((BLOCKS, 1 << 16), np.uint8), []
                for bit, j in enumerate(items[first : first + GROUP]):
                    prints.append((j, np.uint8(1 << bit), _packed(_signs(grams[j]).sum(0, dtype=np.int64) > 0)))
                    for b, value in enumerate(prints[-1][2].view(np.uint16)):
                        table[b, near ^ value] |= prints[-1][1]
                groups.append((table, prints))
            self.sizes.append((m, groups))


def _similar_windows(index: _Index, hashes: np.ndarray, lengths: np.ndarray, radius: int, similar: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(document, item, similarity, start, n, hamming) of the similar windows; hashes are those of documents of these lengths, end to end."""
    gap = index.longest
    base = gap + np.cumsum(lengths + gap) - lengths - gap
    total = int(lengths.sum() + gap * (len(lengths) + 1))
    spot = np.arange(len(hashes)) + np.repeat(base - (np.cumsum(lengths) - lengths), lengths)
    row, real, found = np.zeros(total, np.int64), np.zeros(total, bool), np.zeros(total, bool)
    row[spot], real[spot] = hashes, True
    found[spot] = index.known[np.minimum(np.searchsorted(index.known, hashes), len(index.known) - 1)] == hashes
    n_real, n_found = (np.r_[0, np.cumsum(x, dtype=np.int32)] for x in (real, found))
    step = max(STEP, 4 * gap)
    kind = np.int8 if gap < 128 else np.int16 if gap < 1 << 15 else np.int32
    moved, ones = np.empty((step, 64), kind), np.empty((step, 64), bool)
    for first in range(0, total - gap, step):
        size = min(step, total - gap - first)
        signs = _signs(row[first : first + size + gap])
        signs[~real[first : first + size + gap]] = 0
        # Sums up to each place; they may wrap around, their differences over a window do not.
        sums = np.zeros((len(signs) + 1, 64), kind)
        np.cumsum(signs, axis=0, dtype=kind, out=sums[1:])
        for m, groups in index.sizes:
            np.subtract(sums[m : m + size], sums[:size], out=moved[:size])
            np.greater(moved[:size], 0, out=ones[:size])
            prints = _packed(ones[:size])
            parts = prints.view(np.uint16).reshape(-1, BLOCKS)
            for table, items in groups:
                mask = table[0][parts[:, 0]]
                for b in range(1, BLOCKS):
                    mask |= table[b][parts[:, b]]
                for j, bit, own in items:
                    near = ((mask & bit) != 0) & (np.bitwise_count(prints ^ own) <= radius)
                    at = np.flatnonzero(near)
                    if not len(at):
                        continue
                    # Verified on shingles: what is common is at most what is any item's, which is counted first.
                    start = first + at
                    held, most = n_real[start + m] - n_real[start], n_found[start + m] - n_found[start]
                    likely = most * (1 + similar) >= similar * (held + m) - 1e-9
                    if not likely.any():
                        continue
                    for i, s, h in zip(at[likely], start[likely], held[likely], strict=True):
                        value, often = np.unique(row[s : s + m][real[s : s + m]], return_counts=True)
                        _, x, y = np.intersect1d(value, index.counts[j][0], assume_unique=True, return_indices=True)
                        common = int(np.minimum(often[x], index.counts[j][1][y]).sum())
                        if common / (int(h) + m - common) >= similar:
                            doc = int(np.searchsorted(base + lengths, s, "right"))
                            yield doc, j, common / (int(h) + m - common), max(int(s - base[doc]), 0), m + SHINGLE - 1, int(np.bitwise_count(prints[i] ^ own[0]))


def _best_windows(ids: list, grams: list[np.ndarray], item_type: pa.DataType, radius: int, similar: float):
    """An Arrow function (doc_id, text) -> (doc_id, item_id, start_word, n_words, hamming, similarity): each row's best window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(grams, radius)
        for batch in batches:
            texts, first = batch.column(1), 0
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            while first < len(ends):
                # Rows of about ROW_BYTES at once, one at least.
                before = ends[first - 1] if first else 0
                last = max(int(np.searchsorted(ends, before + ROW_BYTES, "right")), first + 1)
                some = texts.slice(first, last - first)
                best: dict = {}
                for doc, j, s, *rest in _similar_windows(index, *_shingles(some), radius, similar):
                    best[doc, j] = min(best.get((doc, j), (0.0,)), (-s, *rest))
                docs, items = [first + d for d, _ in best], [ids[j] for _, j in best]
                values = list(zip(*best.values(), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(docs, pa.int64())), pa.array(items, item_type), *(pa.array(values[c], pa.int32()) for c in (1, 2, 3)), pa.array([-v for v in values[0]], pa.float64())],
                    ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"],
                )
                first = last

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity) of each document and item that it holds.

    Words are lower-cased runs of letters and digits. A window has as many words as an item and may
    start at any word, or before the text or end after it, with those of its words that are there.
    All windows of all texts are fingerprinted for each item size by rolling sums of their shingles'
    bits and looked up in the multi-index of the items' SimHashes; those within radius are verified
    on their weighted shingles. The best window of each pair is returned, the first of equal ones.
    Null and empty texts, and texts and items of fewer than five words, match nothing; repeated rows
    and rows with null ids match as one row of that id. Other columns are not read.

    Items go to the workers in blocks of about BLOCK_ITEMS items or BLOCK_CHARS characters, each block
    compared with all documents in a pass of its own. Windows are made in Arrow batches; native does
    the same in DataFrame operations alone.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    items = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    doc_type, item_type = rows.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type), *[T.StructField(c, T.IntegerType()) for c in ("start_word", "n_words", "hamming")], T.StructField("similarity", T.DoubleType())])
    out = None
    for part in range(blocks):
        own = items.where(F.col("part") == part).select("item_id", "text").collect()
        own = [(i, g) for i, text in own if len(g := _shingles(pa.array([text]))[0])]
        if not own:
            continue
        found = rows.mapInArrow(_best_windows([i for i, _ in own], [g for _, g in own], to_arrow_type(item_type), radius, similar), schema)
        found = written(found, "windows") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return _best(out.select("doc_id", "item_id", F.struct(-F.col("similarity"), "start_word", "n_words", "hamming").alias("b")))


def _best(found: DataFrame) -> DataFrame:
    best = found.groupBy("doc_id", "item_id").agg(F.min("b").alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start_word"), F.col("b.n_words"), F.col("b.hamming"), (-F.col("b")["col1"]).alias("similarity"))


class _Lanes:
    """Where the sums of 64 bits, 1 or -1 each, stand in whole numbers: one lane of `wide` bits for each bit.

    The first `strided` numbers take bits that are `wide` apart, so that a shift and a mask lay them
    out; the others take what is left, one bit after another. Sums of a whole stretch may run over
    into the next lane, as the difference of two such sums is again that of the window alone, and
    with `half` in each lane it has no negative lane; a lane's highest bit then says that its sum is
    above 0. The highest lane has room for a stretch, so that no sum overflows.
    """

    def __init__(self, longest: int, stretch: int):
        self.wide = longest.bit_length() + 1
        self.each = (62 - max(stretch.bit_length(), self.wide)) // self.wide + 1
        self.strided = 64 // (self.wide * self.each) * self.wide
        rest = range(self.strided * self.each, 64)
        self.bits = [[i // self.wide * self.wide * self.each + i % self.wide + k * self.wide for k in range(self.each)] for i in range(self.strided)]
        self.bits += [list(rest[i : i + self.each]) for i in range(0, len(rest), self.each)]
        self.numbers = len(self.bits)
        self.words = -(-self.numbers // self.wide)

    def mask(self, number: int) -> int:
        return sum(1 << k * self.wide for k in range(len(self.bits[number])))

    def ones(self, h: str, number: int) -> Column:
        """The bits of h that number counts, each in its lane."""
        if number < self.strided:
            return F.shiftrightunsigned(h, self.bits[number][0]).bitwiseAND(F.lit(self.mask(number)))
        return reduce(Column.bitwiseOR, [F.shiftleft(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")), k * self.wide) for k, b in enumerate(self.bits[number])])

    def signs(self, h: str, number: int) -> Column:
        return F.shiftleft(self.ones(h, number), 1) - F.lit(self.mask(number))

    def half(self, number: int) -> int:
        return self.mask(number) * ((1 << self.wide - 1) - 1)

    def word(self, sums: list[Column], word: int) -> Column:
        """One word of a fingerprint, of the sums (with half) of its numbers."""
        first = word * self.wide
        parts = [F.shiftrightunsigned(s.bitwiseAND(F.lit(self.mask(first + r) << self.wide - 1)), self.wide - 1 - r) for r, s in enumerate(sums[first : first + self.wide])]
        return reduce(Column.bitwiseOR, parts)

    def placed(self, fingerprint: str) -> list[Column]:
        """The words of a fingerprint whose bits are in their own order."""
        parts = [F.shiftleft(self.ones(fingerprint, i), i % self.wide) for i in range(self.numbers)]
        return [reduce(Column.bitwiseOR, parts[i : i + self.wide]) for i in range(0, len(parts), self.wide)]


def _kept(value: Column) -> Column:
    """A long that is computed where it stands: the optimizer copies no column that isn't deterministic into those that use it."""
    return value.bitwiseOR(_nothing().cast("long"))


def _nothing() -> Column:
    return F.shiftrightunsigned(F.spark_partition_id(), 31)


def _apart_by(words: list[Column], others: list[Column]) -> Column:
    return reduce(Column.__add__, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(words, others, strict=True)])


def native(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, similar: float = SIMILAR) -> DataFrame:
    """The same rows as matches, but for hamming, as words have other hashes, in DataFrame operations only, by running sums; the documents are read once, and once for their size, whatever the number of items.

    Shingles are rows, whose bits are added up over stretches of a text by window functions and become
    arrays again, one row a stretch. A window's fingerprint is made of differences of two such sums,
    in lanes of whole numbers, and compared with the items of its size, GROUP at a time; those within
    radius are verified on their weighted shingles. All items are one table of prints by size, sent
    to each executor.
    """
    items = _items(benchmark.where(F.col(item_text).isNotNull()), item_col, item_text).withColumn("m", F.size("item_grams"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    longest = items.agg(F.max("m")).first()[0]
    if longest is None:
        kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, start_word int, n_words int, hamming int, similarity double")
    places = max(STRETCH, 4 * longest)
    lanes = _Lanes(longest, places + longest)
    numbers, words = range(lanes.numbers), range(lanes.words)
    items = items.withColumn("item_grams", once(F.col("item_grams"))).withColumn("print", once(simhash("item_grams")))
    items = items.select("item_id", "n", "m", "item_grams", *[w.alias(f"own{i}") for i, w in enumerate(lanes.placed("print"))])
    # A similar window has at least `least` shingles in common. A group with fewer items repeats its last one.
    some = items.withColumn("g", F.floor((F.row_number().over(Window.partitionBy("m").orderBy("item_id")) - 1) / GROUP)).groupBy("m", "g").agg(F.collect_list("own0").alias("prints"))
    some = some.select("m", F.ceil(similar * F.col("m") - 1e-9).alias("least"), *[F.coalesce(F.element_at("prints", F.least(F.lit(j + 1), F.size("prints"))), F.lit(0).cast("long")).alias(f"item{j}") for j in range(GROUP)])

    # Windows start at longest - 1 places before a text or later. A stretch's shingles are those of the windows that start in it.
    # A task sorts its shingles, several times the bytes of its texts.
    tasks = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK_BYTES)
    texts = rows.withColumn("uid", F.monotonically_increasing_id()).repartition(max(tasks, 1), "uid").select("doc_id", "uid", once(word_parts(F.col("text"))).alias("parts"))
    texts = texts.select("doc_id", "uid", once(inner_words("parts")).alias("words")).where(F.size("words") >= SHINGLE)
    texts = texts.select("doc_id", "uid", once(_all_hashed("words")).alias("all")).withColumn("total", F.size("all"))
    texts = texts.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") + (longest - 2)) / places).cast("int"))).alias("stretch"))
    texts = texts.withColumn("begin", F.col("stretch") * places - (longest - 1)).withColumn("first", F.greatest("begin", F.lit(0)))
    texts = texts.withColumn("own", once(F.slice("all", F.col("first") + 1, F.greatest(F.least(F.col("begin") + places + longest - 1, F.col("total")) - F.col("first"), F.lit(0)))))
    grams = texts.select("doc_id", "uid", "stretch", "begin", "total", F.posexplode("own").alias("at", "h"))
    known = items.select(F.explode("item_grams").alias("h")).distinct().withColumn("found", F.lit(1).cast("long"))
    grams = grams.join(F.broadcast(known), "h", "left")
    # The signs are made after the sort, which moves less so.
    zero = F.lit(0).cast("long")
    summands = {"found": F.coalesce("found", zero), **{f"x{i}": lanes.signs("h", i) for i in numbers}}
    sums = list(summands)
    upto = Window.partitionBy("uid", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = grams.select("doc_id", "uid", "stretch", "begin", "total", "at", "h", *[F.coalesce(F.sum(v).over(upto), zero).alias(c) for c, v in summands.items()])
    one = one.groupBy("uid", "stretch").agg(F.first("doc_id").alias("doc_id"), F.first("begin").alias("begin"), F.first("total").alias("total"), *[F.collect_list(c).alias(c) for c in ("at", "h", *sums)])
    # Rows come to collect_list in their order, unless the aggregation has to sort them by key.
    straight = F.col("at") == F.sequence(F.lit(0), F.size("at") - 1)
    ordered = lambda c: F.when(straight, F.col(c)).otherwise(F.transform(F.array_sort(F.arrays_zip(F.col("at"), F.col(c).alias("v"))), lambda s: F.coalesce(s["v"], zero)))
    one = one.select("doc_id", "begin", "total", *[ordered(c).alias(c) for c in ("h", *sums)])
    # Sums stay as they are beyond a text's ends, so that each window has its place in them.
    one = one.withColumn("before", F.greatest(-F.col("begin"), F.lit(0))).withColumn("starts", F.least(F.lit(places), F.col("total") - F.col("begin")))
    after = lambda c: F.col("starts") + (longest - 1) - F.col("before") - F.size(c)
    spread = lambda c: F.concat(F.array_repeat(zero, F.col("before") + 1), F.col(c), F.array_repeat(F.coalesce(F.element_at(c, -1), zero), after(c)))
    nothing = F.lit(None).cast("long")
    one = one.select("doc_id", "begin", "starts", F.concat(F.array_repeat(nothing, F.col("before")), F.col("h"), F.array_repeat(nothing, after("h"))).alias("h"), *[spread(c).alias(c) for c in sums])
    one = one.select("*", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("start"))
    one = one.select("doc_id", "begin", "start", "h", *sums, *[_kept(F.lit(lanes.half(i)) - F.col(f"x{i}")[F.col("start")]).alias(f"b{i}") for i in numbers])
    one = one.crossJoin(F.broadcast(some)).withColumn("to", (F.col("start") + F.col("m")).bitwiseOR(_nothing()))
    summed = [F.col(f"x{i}")[F.col("to")] + F.col(f"b{i}") for i in numbers]
    one = one.withColumn("w0", _kept(lanes.word(summed, 0)))
    # Windows whose first word alone is too far from all items of the group go first. What is common is at most what is any item's.
    near = reduce(Column.__or__, [_apart_by([F.col("w0")], [F.col(f"item{j}")]) <= radius for j in range(GROUP)])
    near = one.where(near).where(F.col("found")[F.col("to")] - F.col("found")[F.col("start")] >= F.col("least"))
    print_ = [F.col(f"w{i}") for i in words]
    near = near.select("doc_id", "m", "begin", "start", F.slice("h", F.col("start") + 1, F.col("m")).alias("grams"), "w0", *[lanes.word(summed, i).alias(f"w{i}") for i in words[1:]]).distinct()
    near = near.select("doc_id", "m", F.greatest(F.col("begin") + F.col("start"), F.lit(0)).alias("start_word"), F.array_compact("grams").alias("grams"), *print_)
    near = near.join(F.broadcast(items), "m").withColumn("hamming", _apart_by(print_, [F.col(f"own{i}") for i in words])).where(F.col("hamming") <= radius)
    near = near.withColumn("similarity", once(weighted_jaccard("grams", "item_grams"))).where(F.col("similarity") >= similar)
    return _best(near.select("doc_id", "item_id", F.struct(-F.col("similarity"), "start_word", F.col("n").alias("n_words"), "hamming").alias("b")))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return native(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
