"""Document fingerprints from Lempel-Ziv phrases: minimum hashes of each text's phrase set."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import mix, partitions, prefix_sums, spans

#: Slots of a signature; each holds 16 bits of the least phrase hash that falls to it.
SLOTS = 64


def parse(text: str, seen: set[str], phrases: list[str], held: str = "") -> str:
    """Add a text's phrases: each is the shortest string from its place on that is no phrase yet. Returns what is begun."""
    add, append = seen.add, phrases.append
    for c in text:
        held += c
        if held not in seen:
            add(held)
            append(held)
            held = ""
    return held


def hashed(phrases: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    return spans(prefix_sums(data), np.r_[0, ends[:-1]], ends) if len(ends) else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16-bit values of SLOTS minimum hashes; an empty slot takes the next filled one's. Nothing for no phrases."""
    if not len(hashes):
        return np.zeros(0, np.uint16)
    hashes = np.sort(hashes)
    slot = (hashes >> np.uint64(58)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    filled = slot[head]
    take = np.searchsorted(filled, np.arange(SLOTS)) % len(filled)
    away = (filled[take] - np.arange(SLOTS)) % SLOTS
    return (mix(hashes[head[take]] + away.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Part of the slots that agree; two empty signatures are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def _text_of(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Document:
    """A text whose first two thirds are parsed once, for itself and for its edited text."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.cut = len(self.text) - len(self.text) // 3
        self.seen: set[str] = set()
        self.head: list[str] = []
        self.held = parse(self.text[: self.cut], self.seen, self.head)
        tail: list[str] = []
        held = parse(self.text[self.cut :], set(self.seen), tail, self.held)
        # What is begun at the end is a phrase already, or nothing.
        del held
        both = hashed(self.head + tail)
        self.head_hashes = both[: len(self.head)]
        self.print = signature(both)

    def row(self, after: _Document) -> tuple:
        third = after.text[: len(self.text) // 3]
        tail: list[str] = []
        parse(third, self.seen, tail, self.held)
        edited = signature(np.concatenate([self.head_hashes, hashed(tail)]))
        sha = hashlib.sha256((self.text[: self.cut] + third).encode("utf-8", "surrogatepass")).hexdigest()
        return (self.doc_id, len(self.text), sha, _text_of(self.print), _text_of(edited), likeness(self.print, edited), likeness(self.print, after.print))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, guest, order); each waits for the next one of its part."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting, part, guest = None, None, False
    for batch in batches:
        out = []
        ids, texts, parts, guests = (batch.column(batch.schema.names.index(c)) for c in ("doc_id", "text", "part", "guest"))
        for i in range(batch.num_rows):
            p, g = parts[i].as_py(), guests[i].as_py()
            if guest and g and p == part:
                continue  # a part needs its first guest only
            this = _Document(ids[i].as_py(), texts[i].as_py())
            if waiting is not None and p == part:
                out.append(waiting.row(this))
            waiting, part, guest = (None if g else this), p, g
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The next document is the one with the next lower id, after the last the first; rows of one id
    are in the order of their texts, null texts first, and null ids come last. Null and empty texts
    have an empty fingerprint, like another empty one (1), unlike all others (0). One document is
    its own next. An empty table gives an empty table; other columns of docs are not read.

    Ids are cut into ranges, each handled in order by one task; the highest document of a range goes
    to the next higher one too, as that one's last needs it. Texts move once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = min(parts or partitions(docs.sparkSession), 2000)
    bounds = sorted({int(b) for b in rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    low = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(low).cast("int"))
    heads = {r["part"]: r["m"] for r in rows.groupBy("part").agg(F.max("doc_id").alias("m")).collect()}
    order = sorted(heads)
    to = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    dest, head = F.lit(None).cast("int"), F.lit(None).cast("long")
    if order:
        dest = F.element_at(F.create_map(*[F.lit(v) for kv in to.items() for v in kv]), F.col("part"))
        head = F.element_at(F.create_map(*[x for k, v in heads.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.col("part"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    also = F.struct(dest.alias("part"), F.lit(True).alias("guest"))
    sent = rows.withColumn("w", F.explode(F.when(F.col("doc_id").eqNullSafe(head), F.array(own, also)).otherwise(F.array(own))))
    sent = sent.select("doc_id", "text", "w.part", "w.guest").repartition(parts, "part")
    sent = sent.sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return sent.mapInArrow(_run, _OUT)


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
