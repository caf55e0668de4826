"""N-gram Jaccard join by token-combination prefixes.

Two documents link when their sets of k-word shingles have a Jaccard similarity of num / den at
least. Such sets may miss at most t = n - ceil(n * num / den) of their n tokens in one another, so

* tokens that occur in one set only are missing for sure: a set with more than t of them has no
  link, and any other set has that many fewer to spare;
* the rest are ordered by class, rare tokens before frequent ones, then by hash. Of rare tokens the
  first (spare + 1) are indexed alone;
* where they do not suffice, all rare tokens are indexed alone, and the prefix is extended over the
  frequent class: hash sub-classes divide every token that is in more than one set. Two sets that
  link differ in d tokens at most, both ways counted, so with more than d / 2 sub-classes one of
  them differs in one token at most. A sub-class has four parts; each three of them, with all
  their tokens, are one indexed combination, and the differing token spares one of the four.
  The number of sub-classes follows the size of the set by steps; a set that can link over a step is
  indexed for both. A combination holds a number of tokens that does not depend on the size of the
  set, so long texts that merely share frequent tokens meet at hardly any key.

Equal sets are one class with one representative. Keys are looked up in rounds. In a round each key
names one of its members, and every other one that isn't connected with it yet is a candidate: first
the member that shares most keys with others, as it is most like the rest of its group, then one by
lot. Of the candidates that share most keys with a set and whose bitmaps allow a link, some are
verified, and labels of components unite. So candidates grow with the index, not with the square of
a group. Rounds go on as long as more pairs of labels share a key than there are entries, and clearly fewer
than before.

What is then unconnected is compared in pairs that share a key, but for members of the key's most
frequent label among themselves, by bitmaps: a set's tokens flip bits, so two bitmaps differ in no
more places than the sets do, and pairs whose bitmaps differ in too many are no links. All others
are verified on the sets, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.shared import NULL_ID, Block, bucket_count, bucketed, components, discard, each_block, mix, pack, row_ids, shingles, split_by_bucket, sweep, words, written

#: Part of all tokens, by hash, whose frequencies are counted; the others pass for frequent.
COUNTED = 0.3
#: A token in more sets than this is frequent.
FREQUENT = 16
#: In a round, candidates of a set whose bitmaps are compared, and of those the ones that are verified.
LOOKS, VERIFIED = 8, 2
#: Rounds go on while they leave at most this part of the pairs of labels that share a key.
PROGRESS = 0.8
#: 64-bit words of a bitmap.
BITMAP = 16
#: Parts that the pairs of one frequent candidate are split into.
SALTS = 256
#: Parts of a sub-class, of which a combination leaves out one.
PARTS = 4


def bitmap(tokens: np.ndarray) -> list[int]:
    """Parity of the tokens that fall to each bit."""
    odd = np.bincount((mix(tokens ^ np.uint64(3)) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _bitmaps_fit(x: str, y: str, nx: str, ny: str, num: int, den: int) -> Column:
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, BITMAP)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    return (den + num) * apart <= (den - num) * (F.col(nx) + F.col(ny))


def _counted(block: Block, k: int):
    hashes, _, first = words(block)
    tokens, at = shingles(hashes, first, k)
    low = np.flatnonzero(tokens < np.uint64(int(COUNTED * 2**64)))
    keys, inverse, counts = np.unique(tokens[low], return_inverse=True, return_counts=True)
    return tokens, at, low, keys, inverse, counts


def _count_pass(buckets: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,) in each_block(batches):
            _, _, _, keys, _, counts = _counted(block, k)
            counts = np.minimum(counts, 255).astype(np.uint8)
            rows = [(b, block.block_id, keys[at].tobytes(), counts[at].tobytes()) for b, at in split_by_bucket(keys, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block_id", "keys", "counts"])

    return run


def _classes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Class of each block's keys in a bucket: 0 in one set only, 1 rare, 2 frequent."""
    keys = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["counts"]]))
    kind = ((counts > 1).astype(np.uint8) + (counts > FREQUENT))[inverse].astype(np.uint8)
    bounds = np.cumsum([0, *map(len, keys)])
    return pd.DataFrame({"block_id": pdf["block_id"], "bucket": pdf["bucket"], "kinds": [kind[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]})


def size_steps(num: int, den: int, most: int) -> list[int]:
    """Set sizes at which the number of sub-classes changes, two beyond most; sets that link are at most one step apart."""
    steps = [1]
    while len(steps) < 3 or steps[-3] <= most:
        steps.append(max(steps[-1] + 1, -(-steps[-1] * den // num)))
    return steps


def combinations_of(tokens: np.ndarray, step: int, apart: int) -> np.ndarray:
    """Keys of which two token sets share one, if at most apart tokens are in one of them only."""
    classes = apart // 2 + 1
    part = mix(tokens ^ np.uint64(step << 8)) % np.uint64(PARTS * classes)
    sums = np.zeros(PARTS * classes, np.uint64)
    np.add.at(sums, part.astype(np.int64), mix(tokens + np.uint64(step)))
    left = np.repeat(sums.reshape(classes, PARTS).sum(1, dtype=np.uint64), PARTS) - sums
    return mix(mix(left) ^ (np.arange(PARTS * classes, dtype=np.uint64) + np.uint64(step << 32)))


def keys_of(tokens: np.ndarray, kind: np.ndarray, num: int, den: int) -> np.ndarray:
    """The index keys of one set, its tokens rising."""
    n = len(tokens)
    spare = n - -(-n * num // den) - int((kind == 0).sum())
    rare = tokens[kind == 1]
    if len(rare) > spare:
        return mix(rare[: spare + 1])
    out = [mix(rare)]
    shared = tokens[kind > 0]
    steps = size_steps(num, den, n)
    own = len(steps) - 4  # steps[own] <= n < steps[own + 1]
    for step in [own, own + 1] if n * den // num >= steps[own + 1] else [own]:
        apart = 2 * (den - num) * (steps[step + 1] - 1) // (den + num)
        if apart:  # else only equal sets link
            out.append(combinations_of(shared, step, apart))
    return np.concatenate(out)


def _index_pass(buckets: int, k: int, num: int, den: int):
    types = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in each_block(batches, "found"):
            tokens, at, low, keys, inverse, _ = _counted(block, k)
            of_key = np.zeros(len(keys), np.uint8)
            kinds = {r["bucket"]: r["kinds"] for r in found or []}
            for b, places in split_by_bucket(keys, buckets):
                of_key[places] = np.frombuffer(kinds[b], np.uint8)
            kind = np.full(len(tokens), 2, np.uint8)
            kind[low] = of_key[inverse]
            n = np.diff(at)
            alone = np.r_[0, np.cumsum(kind == 0)]
            alone = alone[at[1:]] - alone[at[:-1]]
            open_ = (n > 0) & (alone <= n - -(-n * num // den))
            rows = []
            for i in np.flatnonzero(open_):
                own = tokens[at[i] : at[i + 1]]
                rows.append((keys_of(own, kind[at[i] : at[i + 1]], num, den).view(np.int64), own.tobytes(), *(int(np.bitwise_xor.reduce(mix(own + np.uint64(salt))).view(np.int64)) for salt in (1, 2)), bitmap(own)))
            slot = np.full(len(n), -1)
            slot[open_] = np.arange(len(rows))
            pick = lambda j: [rows[s][j] if s >= 0 else None for s in slot]  # noqa: E731, B023
            columns = [row_ids(block.block_id, len(n)), np.where(block.ids == NULL_ID, 0, block.ids), n, pick(2), pick(3), pick(0), pick(1), pick(4)]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            arrays[1] = pa.array(columns[1], pa.int64(), mask=block.ids == NULL_ID)
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "n", "h1", "h2", "keys", "tokens", "bits"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, **columns: str) -> DataFrame:
    """pairs (a, b, ...) with columns of both sets, named as given with a and b behind.

    sets are in buckets of uid and stay where they are for a; for b only those that are asked for
    move, once for each salt that asks, as many pairs may have one b.
    """
    pick = lambda side: [F.col("uid").alias(side), *[F.col(c).alias(n + side) for n, c in columns.items()]]
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    asked = sets.join(pairs.select(F.col("b").alias("uid"), "salt").distinct(), "uid")
    return pairs.join(sets.select(*pick("a")), "a").join(asked.select(*pick("b"), "salt"), ["b", "salt"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ...) that link."""

    def common(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype="int64")

    both = _with_sets(pairs, sets, t="tokens", n="n").withColumn("common", F.pandas_udf(common, "long")("ta", "tb"))
    return both.where(den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common"))).select(*pairs.columns)


def _sizes_fit(x: Column, y: Column, num: int, den: int) -> Column:
    return den * F.least(x, y) >= num * F.greatest(x, y)


def _open_keys(labelled: DataFrame) -> tuple[DataFrame, int]:
    """Of labelled (uid, n, key, pop, label), the rows of keys with several labels; how many pairs of labels share a key."""
    several = labelled.groupBy("key").agg(F.count_distinct("label").alias("k")).where("k > 1")
    several = written(several, "keys")
    pairs = several.agg(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2)).first()[0] or 0
    out = written(labelled.join(several.select("key"), "key"), "open")
    discard(several)
    return out, pairs


def _looked(labelled: DataFrame, sets: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """(a, b, la, lb): links that a round finds, with the labels that they unite."""
    rank = F.col("pop") if turn == 0 else F.xxhash64("uid", "key", F.lit(turn))
    named = labelled.groupBy("key").agg(F.max(F.struct(rank.alias("r"), "uid", "n", "label")).alias("p"))
    named = named.select("key", F.col("p.uid").alias("b"), F.col("p.n").alias("nb"), F.col("p.label").alias("lb"))
    looks = labelled.join(named, "key").where(F.col("label") != F.col("lb")).where(_sizes_fit(F.col("n"), F.col("nb"), num, den))
    looks = looks.groupBy(F.col("uid").alias("a"), "b").agg(F.count("*").alias("c"), F.first("label").alias("la"), F.first("lb").alias("lb"))
    order = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    looks = looks.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LOOKS).drop("r")
    looks = _with_sets(looks, sets, bits="bits", n="n").where(_bitmaps_fit("bitsa", "bitsb", "na", "nb", num, den)).select("a", "b", "c", "la", "lb")
    looks = written(looks.withColumn("r", F.row_number().over(order)).where(F.col("r") <= VERIFIED).select("a", "b", "la", "lb"), "looks")
    links = written(_verified(looks, sets, num, den).select("la", "lb").distinct(), "found")
    discard(looks)
    return links


def _relabelled(frame: DataFrame, new: DataFrame) -> DataFrame:
    """frame with the labels that are one component of new (node, component) as one."""
    out = frame.join(new, F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("component", "label")).drop("node", "component")
    return out.select(*frame.columns)


def _rest(labelled: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(la, lb): the labels that links between still unconnected sets unite."""
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("most"))
    rest = labelled.join(counts, "key").groupBy("uid").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list(F.struct("key", (F.col("label") != F.col("most")).alias("few"))).alias("keys"))
    rest = written(rest.join(sets.select("uid", "bits"), "uid"), "rest")
    x, y = (rest.select(F.explode("keys").alias("k"), F.col("uid").alias(i), F.col("n").alias(f"n{i}"), F.col("label").alias(f"l{i}"), F.col("bits").alias(f"b{i}")).select("*", F.col("k.key").alias("key"), F.col("k.few").alias(f"few{i}")).drop("k") for i in "ab")
    once = (F.col("la") != F.col("lb")) & (~F.col("fewb") | (F.col("la") < F.col("lb")))
    pairs = x.where("fewa").join(y, "key").where(once).where(_sizes_fit(F.col("na"), F.col("nb"), num, den) & _bitmaps_fit("ba", "bb", "na", "nb", num, den))
    pairs = written(pairs.select("a", "b", "la", "lb").distinct(), "pairs")
    links = written(_verified(pairs, sets, num, den).select("la", "lb").distinct(), "found")
    discard(rest, pairs)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, uid, component) of each row of docs.

    component_id is the least id that links reach, the document's own included. Null and empty
    texts have no shingles and no links; texts of fewer than k words have one. Repeated rows are
    rows of their own (uid tells them apart) in one component, if they have words. A null id has
    the least other id of its component, else null. Other columns of docs are not read; an empty
    table gives an empty table. Sets are compared by 64-bit hashes of their shingles.
    """
    blocks = pack(docs, id_col, text_col, block_bytes=2 << 20)
    buckets = bucket_count(blocks)
    sent = blocks.mapInArrow(_count_pass(buckets, k), "bucket long, block_id long, keys binary, counts binary")
    kinds = sent.groupBy("bucket").applyInPandas(_classes, "block_id long, bucket long, kinds binary")
    kinds = kinds.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "kinds")).alias("found"))
    indexed = blocks.join(kinds, "block_id", "left").mapInArrow(_index_pass(buckets, k, num, den), "uid long, doc_id long, n long, h1 long, h2 long, keys array<long>, tokens binary, bits array<long>")
    indexed = written(indexed, "indexed")
    discard(blocks)
    rows = written(indexed.select("uid", "doc_id", "n", "h1", "h2"), "rows")
    open_ = rows.where(F.col("h1").isNotNull())
    classes = open_.groupBy("n", "h1", "h2").agg(F.min("uid").alias("rep"))
    members = written(open_.select("uid", "n", "h1", "h2").join(classes, ["n", "h1", "h2"]).select("uid", "rep"), "members")
    reps = members.where("uid = rep").select("uid")
    entries = written(indexed.join(reps, "uid", "left_semi").select("uid", "n", F.explode("keys").alias("key")), "entries")
    counts = written(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    shared = written(entries.join(counts, "key"), "shared")
    held, before = counts.agg(F.sum("c"), F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).first()
    discard(entries, counts)
    known = shared.groupBy("uid").agg(F.sum(F.log2("c")).alias("pop"))
    labels = written(known.select("uid", F.col("uid").alias("label")), "labels")
    sets = bucketed(indexed.join(known.select("uid"), "uid", "left_semi").select("uid", "n", "tokens", "bits"), "sets", "uid")
    labelled = written(shared.join(known, "uid").select("uid", "n", "key", "pop", F.col("uid").alias("label")), "open")
    discard(indexed, shared)
    sweep(docs.sparkSession)
    turn = 0
    while before:
        links = _looked(labelled, sets, turn, num, den)
        new = components(links, "la", "lb")
        now, moved = written(_relabelled(labelled, new), "labelled"), written(_relabelled(labels, new), "labels")
        discard(labels, labelled, links)
        labels, (labelled, pairs) = moved, _open_keys(now)
        discard(now)
        sweep(docs.sparkSession)
        if pairs <= held or pairs > PROGRESS * before:
            break
        turn, before = turn + 1, pairs
    links = _rest(labelled, sets, num, den)
    labels = _relabelled(labels, components(links, "la", "lb"))
    groups = members.join(labels.withColumnRenamed("uid", "rep"), "rep", "left").select("uid", F.coalesce("label", "rep").alias("component"))
    groups = written(groups, "groups")
    discard(labelled, sets, members, links)
    sweep(docs.sparkSession)
    least = groups.join(rows.select("uid", "doc_id"), "uid").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = rows.select("uid", "doc_id", "n").join(groups, "uid", "left").join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "uid", F.coalesce("component", "uid").alias("component"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: Exact join for DuckDB: pairs that share a shingle, then reachability.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
k AS (SELECT t FROM u GROUP BY t HAVING count(*) > 1),
r AS (SELECT doc_id, n, t FROM u SEMI JOIN k USING (t)),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT node, min(reach) AS component_id FROM c GROUP BY node) m ON s.doc_id = m.node
"""
