"""Calls to external models: a keyed cache, a ledger of what was sent and answered, pacing, budgets, and embeddings.

A ledger is a folder that all executors share, with four parts: `claims` (what a run is about to
ask, written before any of it goes out), `sent` (a file for each call, written before it goes out),
`answers` (a file for each call or batch, which appears whole once it is answered) and `cache`
(answers of ended runs, by settle). Results are read from it, so a second action on a result, a
task that is tried again and a run that begins after a lost one read answers instead of asking again.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T
from threadloom.operators.forest import shared_folder

# Which provider serves a model, by the start of its name, and the schedule of calls.
PROVIDERS = {"gemini": "gemini", "openai/gpt-oss": "groq", "llama": "groq"}
GAP_S, BACKOFF_S, LONGEST_S, TRIES = 4.0, 4.0, 64.0, 5
CACHE = "key string, model string, system string, prompt string, response string, variant int, created_at timestamp"
VECTORS = "key string, vector array<float>"
_ANSWER = pa.schema([("key", pa.string()), ("model", pa.string()), ("system", pa.string()), ("prompt", pa.string()), ("response", pa.string()), ("variant", pa.int32()), ("created_at", pa.timestamp("us", "UTC"))])
_VECTOR = pa.schema([("key", pa.string()), ("vector", pa.list_(pa.float32()))])


class CacheMiss(RuntimeError):
    """Only the cache may answer, and it doesn't."""


class OverBudget(RuntimeError):
    """More calls would be needed than are allowed; nothing was sent."""


class Denied(RuntimeError):
    """The provider refuses the key; another try would not help."""


class Busy(RuntimeError):
    """The provider asks to come back, after so many seconds if it says."""

    def __init__(self, after: float | None = None):
        super().__init__("busy")
        self.after = after


def key(model: Column, system: Column, prompt: Column, variant: Column) -> Column:
    """The cache's key; variant 0 has the key of a call without one."""
    plain = T.cache_key(model, system, prompt)
    return F.when(F.coalesce(variant, F.lit(0)) == 0, plain).otherwise(T.cache_key(model, system, prompt, variant.cast("string")))


def provider(model: Column) -> Column:
    """The provider of a model; an unknown one raises."""
    known = F.lit(None).cast("string")
    for start, name in PROVIDERS.items():
        known = F.when(F.startswith(model, F.lit(start)), name).otherwise(known)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(model, F.lit("null")))).cast("string"))


def waits(attempt: int, after: float | None = None) -> float:
    """Seconds before the next try: what the provider says, else doubling up to LONGEST_S."""
    return after if after is not None else min(BACKOFF_S * 2**attempt, LONGEST_S)


def paced(call: Callable[[str, str | None, str], str], sleep=time.sleep, clock=time.monotonic, gap: float = GAP_S) -> Callable[[str, str | None, str], str]:
    """call with at least gap seconds between two calls, tried again while the provider is Busy."""
    last = -math.inf

    def run(model: str, system: str | None, prompt: str) -> str:
        nonlocal last
        for attempt in range(TRIES):
            if (rest := gap - (clock() - last)) > 0:
                sleep(rest)
            last = clock()
            try:
                return call(model, system, prompt)
            except Busy as e:
                if attempt < TRIES - 1:
                    sleep(waits(attempt, e.after))
        raise RuntimeError(f"the provider is still busy after {TRIES} tries")

    return run


def asked(requests: DataFrame) -> DataFrame:
    """requests (model, system, prompt, variant, ...) with key and provider."""
    return requests.withColumns({"key": key(F.col("model"), F.col("system"), F.col("prompt"), F.col("variant")), "provider": provider(F.col("model"))})


def first_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    """One row for each value of by: the one that comes first by order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct keys of requests that the cache lacks, with their model, system, prompt, variant and provider."""
    new = asked(requests).select("key", "model", "system", "prompt", "variant", "provider").dropDuplicates(["key"])
    return new.join(cache.select("key"), "key", "left_anti")


# --- the ledger --------------------------------------------------------------------------------


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, for a worker."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _part(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def _put(store: fs.FileSystem, path: str, rows: pa.Table) -> None:
    """A file that appears whole: written beside its place under a name that readers skip, then moved."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        pq.write_table(rows, out)
    store.move(part, path)


def answered(spark: SparkSession, ledger: str, schema: str = CACHE) -> DataFrame:
    """All answers that a ledger holds, each key once: none where there is no ledger yet."""
    return _part(spark, f"{ledger}/cache", schema).union(_part(spark, f"{ledger}/answers", schema)).dropDuplicates(["key"])


def in_doubt(spark: SparkSession, ledger: str, schema: str = CACHE) -> DataFrame:
    """(key): calls that were about to go out when a run ended, without an answer. The next run sends them again."""
    return _part(spark, f"{ledger}/sent", "key string").distinct().join(answered(spark, ledger, schema).select("key"), "key", "left_anti")


def settle(spark: SparkSession, ledger: str, schema: str = CACHE) -> int:
    """Move answers of ended runs to the ledger's cache, as few files; how many were new there. No run may use the ledger meanwhile.

    A settling that ends halfway leaves keys in both parts, which answered reads once.
    """
    if not _there(spark, f"{ledger}/answers"):
        return 0
    new = _part(spark, f"{ledger}/answers", schema).dropDuplicates(["key"]).join(_part(spark, f"{ledger}/cache", schema).select("key"), "key", "left_anti")
    before = _part(spark, f"{ledger}/cache", schema).count()
    new.write.mode("append").parquet(f"{ledger}/cache")
    for part in ("answers", "sent", "claims"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return _part(spark, f"{ledger}/cache", schema).count() - before


def _claim(new: DataFrame, ledger: str) -> tuple[DataFrame, str]:
    """(new as written to the ledger, the run's name). From here on the rows to ask are fixed, in fixed files."""
    name = uuid.uuid4().hex
    new.write.parquet(f"{ledger}/claims/{name}")
    return new.sparkSession.read.schema(new.schema).parquet(f"{ledger}/claims/{name}"), name


def _once(ledger: str, run: str, first: str, keys: list[str], ask: Callable[[], pa.Table]) -> int:
    """Ask for keys, unless the run holds the answers that begin with key first: 1 if asked, else 0."""
    (store, answers), (_, sent) = _at(f"{ledger}/answers/{run}"), _at(f"{ledger}/sent/{run}")
    file = f"{answers}/{first}.parquet"
    if store.get_file_info(file).type != fs.FileType.NotFound:
        return 0
    for folder in (answers, sent):
        store.create_dir(folder, recursive=True)
    _put(store, f"{sent}/{first}.parquet", pa.table({"key": keys}))
    _put(store, file, ask())
    return 1


def complete(requests: DataFrame, cache: DataFrame, call: Callable[[str, str | None, str], str] | None = None, ledger: str | None = None, gap: float = GAP_S) -> tuple[DataFrame, DataFrame]:
    """(requests with key and response, answers that are new).

    The cache answers first, then the ledger. Without call a miss raises CacheMiss. Misses go out
    while this runs, one at a time for each provider, in one task each, as providers count calls and
    not machines; each answer is in the ledger before the next call goes out. A run with the ledger of
    a lost one sends what has no answer: of the calls that were out when it was lost (one for each
    provider) nobody knows, and they go out again (see in_doubt). Without a ledger this call gets one
    of its own in the folder that spark.checkpoint.dir names. A second executor that still runs a task
    that Spark believes lost may ask again what it hasn't yet seen answered.
    """
    spark = requests.sparkSession
    keyed = asked(requests)
    known = cache.select("key", "response")
    if ledger:
        known = known.union(answered(spark, ledger).join(cache.select("key"), "key", "left_anti").select("key", "response"))
    new = misses(requests, known)
    if call is None:
        if n := new.count():
            raise CacheMiss(f"{n} prompts are not in the cache, such as {[r[0] for r in new.select('key').limit(3).collect()]}")
        return keyed.join(known, "key", "left"), cache.limit(0)
    ledger = ledger or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    claims, run = _claim(new, ledger)

    def send(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, n = paced(call, gap=gap), 0
        for batch in batches:
            for r in batch.to_pylist():
                ask = lambda r=r: pa.Table.from_pylist([{**{c: r[c] for c in ("key", "model", "system", "prompt")}, "response": one(r["model"], r["system"], r["prompt"]), "variant": r["variant"] or 0, "created_at": datetime.now(UTC)}], _ANSWER)
                n += _once(ledger, run, r["key"], [r["key"]], ask)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    claims.groupBy("provider").applyInArrow(send, "n long").collect()  # a number for each provider
    fresh = _part(spark, f"{ledger}/answers/{run}", CACHE)
    return keyed.join(known.union(fresh.select("key", "response")), "key", "left"), fresh


def budget(requests: DataFrame, cache: DataFrame, most: int | None = None) -> DataFrame:
    """(n, cached, calls, tokens) of distinct prompts; more calls than most raises before anything is sent."""
    every = asked(requests).dropDuplicates(["key"]).join(cache.select("key", F.lit(1).alias("hit")), "key", "left")
    missing = F.col("hit").isNull()
    size = T.tokens(F.concat(F.coalesce("system", F.lit("")), "prompt"))
    out = every.agg(F.count("*").alias("n"), F.count("hit").alias("cached"), F.count_if(missing).alias("calls"), F.coalesce(F.sum(F.when(missing, size)), F.lit(0)).cast("long").alias("tokens"))
    if most is not None and (calls := out.first()["calls"]) > most:
        raise OverBudget(f"{calls} calls are needed and {most} allowed; nothing has been sent")
    return out


def agent_budget(classified: DataFrame, replied: DataFrame, force_reply: bool = False) -> DataFrame:
    """(n, classify_misses, reply_misses, reply_unknown, skipped, total, exact) of a run.

    classified (query_id, cached, decision): whether the classifier's answer is cached, and what it
    leads to (null if not cached); replied (query_id, cached). A message whose intent isn't known
    may need a reply: it is counted, and the total is an upper bound.
    """
    rows = classified.join(replied.select("query_id", F.col("cached").alias("has_reply")), "query_id", "left")
    skips = F.col("cached") & (F.lit(not force_reply)) & (F.col("decision") == "escalate")
    needs = F.col("cached") & ~F.coalesce(skips, F.lit(False)) & ~F.coalesce("has_reply", F.lit(False))
    out = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("cached")).alias("classify_misses"), F.count_if(needs).alias("reply_misses"), F.count_if(~F.col("cached")).alias("reply_unknown"), F.count_if(skips).alias("skipped"))
    total = F.col("classify_misses") + F.col("reply_misses") + F.col("reply_unknown")
    return out.withColumns({"total": total, "exact": F.col("reply_unknown") == 0})


def embed(texts: DataFrame, cache: DataFrame, model: str, encode: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts (id, text) with vector, cache rows (key, vector) that are new).

    Each distinct text that neither the cache nor the ledger has is encoded once, while this runs, in
    batches, to a vector of `size` numbers of length 1; another size raises. A batch is in the ledger
    before its task encodes the next, so a task or a run that begins again encodes what is left.
    Without a ledger this call gets one of its own. A null text has a null vector.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("key", F.when(F.col("text").isNotNull(), T.cache_key(F.lit(model), F.col("text"))))
    known = cache.select("key", "vector")
    if ledger:
        known = known.union(answered(spark, ledger, VECTORS).join(cache.select("key"), "key", "left_anti"))
    new = keyed.where("key is not null").select("key", "text").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    ledger = ledger or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    claims, run = _claim(new, ledger)

    def vectors(keys: list[str], said: list[str]) -> pa.Table:
        rows = encode(said)
        if len(rows) != len(said) or any(len(v) != size for v in rows):
            raise ValueError(f"the model gives vectors of other than {size} numbers, or not one for each text")
        norms = [math.sqrt(sum(x * x for x in v)) or 1.0 for v in rows]
        return pa.table([pa.array(keys), pa.array([[x / n for x in v] for v, n in zip(rows, norms, strict=True)], _VECTOR.field(1).type)], schema=_VECTOR)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for rows in batches:
            keys, said = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for i in range(0, len(keys), batch):
                part = slice(i, i + batch)
                n += _once(ledger, run, keys[i], keys[part], lambda part=part: vectors(keys[part], said[part]))  # noqa: B023
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    claims.mapInArrow(work, "n long").agg(F.sum("n")).collect()
    fresh = _part(spark, f"{ledger}/answers/{run}", VECTORS)
    return keyed.join(known.union(fresh), "key", "left").select(*texts.columns, "vector"), fresh
