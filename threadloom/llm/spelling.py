"""Spelling variants: words one code point apart meet in rolling-hash keys of what is left without one.

The key of a word without its code point i joins the polynomial hash of the prefix before i with
that of the suffix after it, so that all keys of many words are a few NumPy operations on running
sums. Keys are dealt out by their leading bits, sorted in each bucket, and what meets there is
compared as strings before it counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, mix, powers, prefix_sums, written

#: Code points of a text that are searched at once, words whose counts a task holds, keys made at once, keys of a bucket.
PIECE, HELD, KEYS, BUCKET_KEYS = 1 << 20, 400_000, 1 << 20, 250_000
LETTERS = "[A-Za-zÀ-ÿ]"
_REST = re.compile(f"{LETTERS}*")
_LENGTH = np.uint64(0x9FB21C651E98DF25)
#: What a row of a meeting stands for: the whole shorter word, one that is longer, one of the same length.
WHOLE, LONGER, SAME = 0, 1, 2


def pieces(text: str, run: re.Pattern) -> Iterator[list[str]]:
    """The runs of a text, some at a time; none is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        end = _REST.match(text, end).end()
        yield run.findall(text, at, end)
        at = end


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, slip: int = 31) -> DataFrame:
    """(word, n): runs of letters in the whole texts, A-Z lower-cased, and how often each comes.

    Where slip divides the crc32 h of `<id>:<run>`, the run loses its code point h % length; slip 0:
    none does. Results of fewer than least_chars code points are left out. Null texts hold none, a
    null id is written as nothing. A task counts before words move.
    """
    run = re.compile(f"{LETTERS}{{{max(1, least_chars)},}}")

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                name, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for found in pieces(text or "", run):
                    for raw, n in Counter(found).items():
                        low = raw.encode().lower()  # bytes: A-Z alone
                        word = low.decode()
                        if slip and (h := zlib.crc32(low, start)) % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_chars:
                            counts[word] += n
                    if len(counts) >= HELD:
                        yield emit(counts)
                        counts.clear()
        yield emit(counts)

    made = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(texts: list[str], most: int = KEYS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, places of their words in texts, marks), at most `most` at a time.

    A mark is -1 for the whole word, else 2 * position of the code point left out, and 1 more unless
    it equals the one before it: of equal neighbours, leaving out any leaves the same word.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts, first = ends - lengths, np.r_[0, np.cumsum(lengths + 1)]
    sums, back = prefix_sums(points), powers(len(points) + 2, -1)
    fresh = np.r_[True, points[1:] != points[:-1]]
    fresh[starts[lengths > 0]] = True
    for low in range(0, int(first[-1]), most):
        at = np.arange(low, min(low + most, int(first[-1])))
        word = np.searchsorted(first, at, "right") - 1
        s, e, out = starts[word], ends[word], at - first[word] - 1
        gone = out >= 0
        cut = np.where(gone, s + out, e)  # the whole word: all before its end, nothing after it
        after = np.where(gone, cut + 1, e)
        poly = (sums[cut] - sums[s]) * back[s] + (sums[e] - sums[after]) * back[s + 1]
        marks = np.full(len(at), -1, np.int32)
        marks[gone] = 2 * out[gone] + fresh[cut[gone]]
        yield mix(poly + (lengths[word] - gone).astype(np.uint64) * _LENGTH), word, marks


def _keyed(vocabulary: DataFrame, bits: int) -> DataFrame:
    """(bucket, keys, uids, marks) of the words of vocabulary, packed by the leading bits of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, uids, size = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            known = np.array(uids, np.int64)
            for keys, word, marks in deletion_keys(held):
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                there, start = np.unique(bucket[order], return_index=True)
                cuts = [order[a:b] for a, b in zip(start, [*start[1:], len(order)], strict=True)]
                packed = [pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (keys, known[word], marks)]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), *packed], ["bucket", "keys", "uids", "marks"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            held += texts
            uids += batch.column(0).to_pylist()
            size += sum(map(len, texts)) + len(texts)
            if size >= KEYS:
                yield from emit()
                held, uids, size = [], [], 0
        if held:
            yield from emit()

    return vocabulary.select("uid", "word").mapInArrow(run, "bucket long, keys binary, uids binary, marks binary")


def _meetings(keyed: DataFrame) -> DataFrame:
    """(uid, out, kind) of words whose keys meet in a way that near words' do; out: the position left out, -1 for none."""

    def run(table: pa.Table) -> pa.Table:
        keys, uids, marks = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("uids", np.int64), ("marks", np.int32)))
        order = np.lexsort((marks, keys))
        keys, uids, marks = keys[order], uids[order], marks[order]
        head = np.r_[True, keys[1:] != keys[:-1]]
        group = np.cumsum(head) - 1
        whole = (marks[head] == -1)[group] & (np.bincount(group) > 1)[group]
        same = np.cumsum(head | np.r_[True, marks[1:] >> 1 != marks[:-1] >> 1]) - 1
        alike = (np.bincount(same) > 1)[same] & (marks >= 0)
        found = [(whole & (marks == -1), WHOLE), (whole & (marks >= 0) & (marks & 1 == 1), LONGER), (alike, SAME)]
        out = np.concatenate([np.flatnonzero(m) for m, _ in found])
        kind = np.concatenate([np.full(int(m.sum()), k, np.int32) for m, k in found])
        return pa.table([pa.array(uids[out]), pa.array(marks[out] >> 1), pa.array(kind)], names=["uid", "out", "kind"])

    return keyed.groupBy("bucket").applyInArrow(run, "uid long, out int, kind int")


def _other() -> Column:
    """A near word, so that the least is the one of largest n, the first in code-point order of equally frequent ones."""
    return F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"), F.col("uid").alias("uid"))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(uid, n_near, best) of vocabulary (uid, word, n; words distinct) that has near words; best: struct(less = -n, word, uid).

    Words that agree but for one code point at one position are as many as the alphabet has letters
    at most; they are gathered by the strings that are left, which settles collisions of keys.
    """
    keys = vocabulary.agg(F.sum(F.length("word") + 1).alias("k")).first()["k"] or 0
    bits = max(3, int(keys // BUCKET_KEYS).bit_length())
    met = _meetings(_keyed(vocabulary, bits)).join(vocabulary, "uid")
    left = F.when(F.col("out") < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("out")), F.substring("word", F.col("out") + 2, F.length("word"))))
    met = written(met.select("uid", "word", "n", "out", "kind", left.alias("rest")), "meetings")
    same = met.where(F.col("kind") == SAME).groupBy("out", "rest").agg(F.array_sort(F.collect_list(_other())).alias("g")).where(F.size("g") > 1)
    same = same.select((F.size("g") - 1).cast("long").alias("near"), "g", F.posexplode("g").alias("at", "own")).select(F.col("own.uid").alias("uid"), "near", F.when(F.col("at") == 0, F.col("g")[1]).otherwise(F.col("g")[0]).alias("best"))
    short = met.where(F.col("kind") == WHOLE).select("rest", F.col("uid").alias("s"), _other().alias("short"))
    pairs = met.where(F.col("kind") == LONGER).select("rest", F.col("uid").alias("l"), _other().alias("long")).join(short, "rest")
    both = pairs.select(F.explode(F.array(F.struct(F.col("s").alias("uid"), F.col("long").alias("best")), F.struct(F.col("l").alias("uid"), F.col("short").alias("best")))).alias("p"))
    every = same.unionByName(both.select("p.uid", F.lit(1).cast("long").alias("near"), "p.best"))
    return every.groupBy("uid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(uid, root) of forms (uid, root: the form): following forms to the last. Each form is many times as frequent, so ways are short; each round doubles what is followed."""
    while True:
        above = forms.select(F.col("uid").alias("a"), F.col("root").alias("a_root"))
        step = forms.join(above, F.col("root") == F.col("a"), "left")
        new = written(step.select("uid", F.coalesce("a_root", "root").alias("root"), F.col("a").isNotNull().alias("moved")), "roots")
        more = new.where("moved").limit(1).count()
        discard(forms)
        if not more:
            return new.select("uid", "root")
        forms = new


def variants(counted: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of counted (word, n), words distinct and not null.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest n (the first in code-point order of equally frequent ones), if that is factor
    (2 or more) times its own n at least, else null; its root is where following forms ends, itself
    if it has none. An empty table gives an empty table.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent, so that following them ends")
    vocabulary = written(counted.select("word", "n").withColumn("uid", F.monotonically_increasing_id()), "words")
    near = neighbours(vocabulary).select("uid", "n_near", F.col("best.word").alias("form"), F.col("best.uid").alias("form_uid"), (-F.col("best.less")).alias("form_n"))
    out = vocabulary.join(near, "uid", "left")
    has = F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))
    out = written(out.select("uid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(has, F.col(c)).alias(c) for c in ("form", "form_uid", "form_n")]), "forms")
    roots = _roots(written(out.where("form_uid is not null").select("uid", F.col("form_uid").alias("root")), "roots"))
    named = roots.join(vocabulary.select(F.col("uid").alias("root"), F.col("word").alias("root_word")), "root").select("uid", "root_word")
    return out.join(named, "uid", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents that have 7 letters and come twice at least."""
    return variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n >= 2"))
