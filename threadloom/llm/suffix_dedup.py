"""Suffix-array deduplication: remove what a string of WIDTH bytes that also starts earlier covers.

Four passes over the packed text, which itself never moves again:

1. Each window of WIDTH bytes has an anchor, the 16-byte string in it that hashes lowest (the first
   of equal ones). Equal windows have equal anchors at equal places in them, and equal bytes beside
   them, so a window whose anchor, with the bytes on the side where it holds more, occurs once in
   the corpus has no equal. Blocks send their anchors' hashes, counted
   once more than once, to hash buckets; the buckets answer which occur again.
2. Around each such anchor the stretch of text whose windows it anchors goes to the anchor's bucket.
   Of equal stretches a block sends the first only: all windows of the others also start earlier.
   Those it sends along as they are.
3. A bucket sorts its windows' starts as a suffix array by two-stage sorting and computes common
   prefixes of neighbours; in each run of windows that share WIDTH bytes all but the earliest are
   repeats.
4. Blocks mark what the repeats cover.

A very frequent passage costs a bucket one stretch for each block, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import NULL_ID, Block, bucket_count, each_block, mix, pack, prefix_sums, spans, split_by_bucket, written

WIDTH = 100
GRAM = 16
_PIECE = 1 << 15


# --- anchors -----------------------------------------------------------------------------------


def anchors(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of each anchor and side, see keyed; windows are named by their starts."""
    data = block.bytes
    n = len(data)
    if n < width:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h = np.empty(n - GRAM + 1, np.uint64)
    owner = np.empty(n - width + 1, np.int64)
    reach = width - GRAM + 1  # anchors in a window
    for begin in range(0, n - width + 1, _PIECE):  # pieces that stay in a processor's cache
        end = min(begin + _PIECE, n - width + 1)
        word = np.ndarray((end - begin + width - 8,), "<u8", block.data, begin, (1,)).astype(np.uint64)
        x = word[: end - begin + reach - 1] * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x += word[GRAM - 8 : GRAM - 8 + len(x)]
        h[begin : begin + len(x)] = x = mix(x)
        least = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
        step = 1
        while step * 2 <= reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: end - begin], least[reach - step : reach - step + end - begin])
        owner[begin:end] = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + begin
    starts, ends = block.offsets[:-1], block.offsets[1:] - width + 1
    full = ends > starts
    edge = np.bincount(starts[full], minlength=n - width + 2) - np.bincount(ends[full], minlength=n - width + 2)
    inside = np.cumsum(edge[:-1]) > 0
    windows = np.flatnonzero(inside)
    if not len(windows):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    place = owner[windows]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(windows)] - 1
    return keyed(block, place[new], windows[new], windows[last], width)


def keyed(block: Block, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) with an anchor's windows parted by the side on which they hold more.

    The later ones hold half of what a window has beyond an anchor behind it, the earlier ones at
    least as much before it. The hash is that of the anchor with those bytes, so a frequent anchor
    is as many keys as it has surroundings. Equal windows hold their anchor at equal places, so they
    are of one side and one key.
    """
    half = (width - GRAM) // 2
    turn = at - (width - GRAM - half)
    later, sooner = high >= turn, low < turn
    sums = prefix_sums(block.bytes)
    behind = spans(sums, at[later], at[later] + GRAM + half)
    before = mix(spans(sums, turn[sooner] - 1, at[sooner] + GRAM) + np.uint64(1))
    place, key = np.r_[at[sooner], at[later]], np.r_[before, behind]
    first, last = np.r_[low[sooner], np.maximum(low, turn)[later]], np.r_[np.minimum(high, turn - 1)[sooner], high[later]]
    order = np.argsort(first, kind="stable")
    return place[order], key[order], first[order], last[order]


def _count_pass(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,) in each_block(batches):
            keys, counts = np.unique(anchors(block, width)[1], return_counts=True)
            rows = [(b, block.block_id, keys[at].tobytes(), (counts[at] > 1).tobytes()) for b, at in split_by_bucket(keys, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block_id", "keys", "many"])

    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each block's keys in a bucket, those that occur more than once."""
    keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
    many = [np.frombuffer(m, bool) for m in pdf["many"]]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(inverse, 1 + np.concatenate(many))
    again = counts[inverse] > 1
    bounds = np.cumsum([0, *map(len, keys)])
    return pd.DataFrame({"block_id": pdf["block_id"], "again": [k[again[a:b]].tobytes() for k, a, b in zip(keys, bounds, bounds[1:], strict=False)]})


# --- two-stage suffix sorting ------------------------------------------------------------------


def all_words(text: bytes) -> np.ndarray:
    """The eight bytes from each place on, as numbers that compare as the strings do."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,)).astype(np.uint64)


def sort_directly(word: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """at in the order of the width bytes there: by the first eight, then ties by the next, and so on."""
    lead = word[at]
    order = np.argsort(lead, kind="stable")
    at, lead = at[order], lead[order]
    new = np.r_[True, lead[1:] != lead[:-1]] if len(at) else np.zeros(0, bool)
    where = None
    for step in range(8, width, 8):
        # Only places in groups of two or more are looked at again.
        alone = new & np.r_[new[1:], True]
        where = np.flatnonzero(~alone) if where is None else where[~alone]
        if not len(where):
            break
        new = new[~alone]
        more = word[at[where] + step]
        group = np.cumsum(new) - 1
        apart = ~new & np.r_[False, more[1:] != more[:-1]]
        if apart.any():
            # Groups whose next words are all equal stay as they are.
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[apart]] = True
            some = np.flatnonzero(mixed[group])
            order = np.lexsort((more[some], group[some]))
            at[where[some]] = at[where[some]][order]
            more[some] = more[some][order]
            new = new | np.r_[False, more[1:] != more[:-1]]
    return at


def suffix_array(text: bytes, word: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The starts in the order of the suffixes there, true to width bytes.

    Behind its last start text has width zero bytes, then 255. Two stages: suffixes smaller than
    their successors are sorted directly; then one scan over the buckets of first bytes, in rising
    order, places every other suffix. It is larger than its successor, so that has its place
    already, and a bucket's induced suffixes come before its directly sorted ones. A stretch of
    starts is carried on to the next directly sorted suffix, from which its end is induced.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data) - 1
    # A suffix that begins with a run of one byte compares as that byte with the one behind the run.
    differ = np.flatnonzero(data[1:] != data[:-1])
    smaller = np.zeros(n, bool)
    smaller[: differ[-1] + 1] = np.repeat(data[differ] < data[differ + 1], np.diff(np.r_[-1, differ]))
    direct = np.flatnonzero(smaller)
    wanted = np.zeros(n + 1, np.int32)
    heads = starts[np.r_[True, np.diff(starts) != 1]]
    tails = starts[np.r_[np.diff(starts) != 1, True]]
    wanted += np.bincount(heads, minlength=n + 1).astype(np.int32)
    wanted -= np.bincount(direct[np.searchsorted(direct, tails)] + 1, minlength=n + 1).astype(np.int32)
    wanted = np.cumsum(wanted)[:n] > 0
    sorted_at = sort_directly(word, np.flatnonzero(wanted & smaller), width)
    induced = wanted & ~smaller
    own = np.searchsorted(data[sorted_at], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def before(order: np.ndarray) -> np.ndarray:
        prior = order[order > 0] - 1
        return prior[induced[prior]]

    for c in range(256):
        rounds = waiting[c] or [sorted_at[:0]]
        rounds = [np.concatenate(rounds)]
        while len(rounds[-1]):  # what a bucket's own suffixes induce into it: one round for each byte of a run
            prior = before(rounds[-1])
            rounds.append(prior[data[prior] == c])
        full = np.concatenate([*rounds, sorted_at[own[c] : own[c + 1]]])
        if not len(full):
            continue
        out.append(full)
        prior = before(full)
        lead = data[prior]
        prior, lead = prior[lead > c], lead[lead > c]
        order = np.argsort(lead, kind="stable")
        lead = lead[order]
        for k in np.flatnonzero(np.bincount(lead, minlength=256)) if len(lead) else ():
            low, high = np.searchsorted(lead, [k, k + 1])
            waiting[k].append(prior[order[low:high]])
    order = np.concatenate(out) if out else sorted_at
    asked = np.zeros(n, bool)
    asked[starts] = True
    return order[asked[order]]


def shared_prefix(word: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to width; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for step in range(0, width, 8):
        x = word[order[left] + step] ^ word[order[left - 1] + step]
        same = x == 0
        apart = x[~same]
        if len(apart):
            # frexp gives the highest bit that differs; bytes before it agree.
            high = np.frexp((apart >> np.uint64(11)).astype(np.float64))[1]
            high = np.where(apart >> np.uint64(11) > 0, high + 11, np.frexp(apart.astype(np.float64))[1])
            out[left[~same]] = step + (64 - high) // 8
        left = left[same]
        if not len(left):
            break
    out[left] = width
    return np.minimum(out, width)


def repeats(text: bytes, starts: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """Which starts have width bytes that also start at a start of lower rank."""
    word = all_words(text)
    order = suffix_array(text, word, starts, width)
    number = np.zeros(len(text), np.int64)
    number[starts] = np.arange(len(starts))
    at = number[order]
    bounds = np.flatnonzero(shared_prefix(word, order, width) < width)
    ranks = rank[at]
    least = np.repeat(np.minimum.reduceat(ranks, bounds), np.diff(np.r_[bounds, len(at)])) if len(at) else ranks
    out = np.zeros(len(starts), bool)
    out[at] = ranks != least
    return out


# --- stretches ---------------------------------------------------------------------------------


def _find_again(block: Block, again: list[bytes], width: int):
    """Anchors that occur again: (hash, first window, last window, whether an equal stretch is earlier in the block)."""
    known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in again])) if again else np.zeros(0, np.uint64)
    at, h, low, high = anchors(block, width)
    if not len(known) or not len(at):
        return np.zeros(0, np.uint64), low[:0], high[:0], np.zeros(0, bool)
    found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    at, h, low, high = at[found], h[found], low[found], high[found]
    text_hash = spans(prefix_sums(block.bytes), low, high + width) ^ mix(h + (at - low).astype(np.uint64)) if len(at) else h
    order = np.argsort(text_hash, kind="stable")
    same = np.zeros(len(at), bool)
    same[order[1:]] = text_hash[order[1:]] == text_hash[order[:-1]]
    return h, low, high, same


def _stretch_pass(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, again in each_block(batches, "again"):
            h, low, high, same = _find_again(block, again or [], width)
            doc = np.searchsorted(block.offsets, low, "right") - 1
            rows: list[tuple] = []
            own = (low[same].astype(np.int64).tobytes(), (high[same] + 1).astype(np.int64).tobytes())
            h, low, high, doc = h[~same], low[~same], high[~same], doc[~same]
            for b, at in split_by_bucket(h, buckets):
                length = high[at] - low[at] + width
                total = np.r_[0, np.cumsum(length)]
                take = np.repeat(low[at] - total[:-1], length) + np.arange(total[-1])
                rows.append((b, block.block_id, block.bytes[take].tobytes(), length.astype(np.int64).tobytes(), low[at].astype(np.int64).tobytes(), block.ids[doc[at]].tobytes(), *own))
                own = (b"", b"")  # with the first row only
            types = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["bucket", "block_id", "text", "lengths", "places", "docs", "low", "high"])

    return run


_STRETCH = "bucket long, block_id long, text binary, lengths binary, places binary, docs binary, low binary, high binary"


def _sort_pass(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = [[np.frombuffer(x, np.int64) for x in pdf[c]] for c in ("lengths", "places", "docs")]
        length, place, doc = (np.concatenate(x) for x in blobs)
        of = np.repeat(pdf["block_id"].to_numpy(), [len(x) for x in blobs[0]])
        text = b"".join(pdf["text"]) + bytes(width + 8) + b"\xff" * 8
        windows = length - width + 1
        begin = np.r_[0, np.cumsum(length)[:-1]]
        total = np.r_[0, np.cumsum(windows)]
        starts = np.repeat(begin - total[:-1], windows) + np.arange(total[-1])
        # Earlier: lower document, then block, then place; windows of a stretch rise with their starts.
        order = np.lexsort((place, of, doc))
        base = np.empty(len(order), np.int64)
        base[order] = np.r_[0, np.cumsum(windows[order])[:-1]]
        rank = np.repeat(base - total[:-1], windows) + np.arange(total[-1])
        hit = repeats(text, starts, rank, width)
        edge = np.diff(np.r_[False, hit, False].astype(np.int8))
        cut = np.zeros(len(hit) + 1, bool)
        cut[total] = True
        inner = np.flatnonzero(cut[:-1] & hit & np.r_[False, hit[:-1]])  # runs end where stretches do
        low = np.sort(np.r_[np.flatnonzero(edge == 1), inner])
        high = np.sort(np.r_[np.flatnonzero(edge == -1), inner])
        which = np.searchsorted(total, low, "right") - 1
        first = place[which] + low - total[which]
        frame = pd.DataFrame({"block_id": of[which], "low": first, "high": first + high - low})
        rows = [(int(b), g["low"].to_numpy().tobytes(), g["high"].to_numpy().tobytes()) for b, g in frame.groupby("block_id", sort=False)]
        rows += [x for x in zip(pdf["block_id"], pdf["low"], pdf["high"], strict=True) if x[1]]
        return pd.DataFrame(rows, columns=["block_id", "low", "high"])

    return run


def _mark_pass(width: int, with_text: bool, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield marked(batch.slice(i, 1))

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        for block, low, high in each_block(iter([batch]), "low", "high"):
            starts = np.frombuffer(b"".join(low or []), np.int64)
            ends = np.frombuffer(b"".join(high or []), np.int64)
            n = len(block.bytes) + 1
            edge = np.bincount(starts, minlength=n) - np.bincount(ends + width - 1, minlength=n)
            gone = np.cumsum(edge[:-1]) > 0
            left = block.bytes[~gone].tobytes()
            sums = np.r_[0, np.cumsum(gone)]
            n = np.diff(block.offsets)
            removed = sums[block.offsets[1:]] - sums[block.offsets[:-1]]
            rise = gone & ~np.r_[False, gone[:-1]]
            heads = block.offsets[:-1][n > 0]
            rise[heads] |= gone[heads]
            rises = np.r_[0, np.cumsum(rise)]
            kept = block.offsets - sums[block.offsets]
            texts = [left[a:b] for a, b in zip(kept, kept[1:], strict=False)]
            columns = [
                pa.array(np.where(block.ids == NULL_ID, 0, block.ids), pa.int64(), mask=block.ids == NULL_ID),
                pa.array(n, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(rises[block.offsets[1:]] - rises[block.offsets[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([t.decode("utf-8", "ignore") if with_text else None for t in texts], pa.string()),
            ]
            if carry:
                columns.append(batch.column(batch.schema.names.index("carry")).flatten())
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *["carry"] * carry])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of each row of docs.

    Bytes are judged on the input and never across documents. Null and empty texts, and texts
    shorter than width, lose nothing. Of rows with one id, the one packed first counts as earlier;
    null ids come after all others. kept_text drops bytes of a cut character (null unless
    with_text); the columns named in carry come along in a struct of that name. An empty table gives an empty table; other columns of docs are not read.
    width is at least GRAM.
    """
    blocks = pack(docs, id_col, text_col, carry)
    buckets = bucket_count(blocks)
    sent = blocks.mapInArrow(_count_pass(buckets, width), "bucket long, block_id long, keys binary, many binary")
    again = sent.groupBy("bucket").applyInPandas(_repeated, "block_id long, again binary")
    again = written(again.where(F.length("again") > 0), "again").groupBy("block_id").agg(F.collect_list("again").alias("again"))
    stretches = blocks.join(again, "block_id", "left").mapInArrow(_stretch_pass(buckets, width), _STRETCH)
    found = stretches.groupBy("bucket").applyInPandas(_sort_pass(width), "block_id long, low binary, high binary")
    found = written(found, "repeats").groupBy("block_id").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    marked = blocks.join(found, "block_id", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    if carry:
        schema += f", carry {blocks.schema['carry'].dataType.elementType.simpleString()}"
    return marked.mapInArrow(_mark_pass(width, with_text, bool(carry)), schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept_text")
