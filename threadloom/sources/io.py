"""Sources and sinks with declared types."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.sources.checks import expect_unique

TWEETS = T.StructType(
    [
        T.StructField("tweet_id", T.LongType(), False),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.LongType()),
    ]
)


def created_at(raw):
    """A stamp like `Tue Oct 31 22:10:47 +0000 2017`; null where it is not of that form."""
    return F.try_to_timestamp(F.substring(raw, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


#: What a piece of a split is: a whole record, one's end, one's beginning, or lines inside one that neither begins nor ends here.
WHOLE, END, BEGIN, INSIDE = 0, 1, 2, 3


class _Split:
    """The lines of one split of a file, put together to records."""

    def __init__(self, file: str, block: int, inside: bool, header: bool):
        self.file, self.block, self.from_before, self.odd = file, block, inside, inside
        self.header = header and block == 0
        self.open: list[str] = []

    def add(self, lines: list[str], odd: np.ndarray) -> Iterator[tuple]:
        """Pieces that end within lines; odd: whether a line has an odd number of quotes."""
        inside = np.logical_xor.accumulate(np.r_[self.odd, odd])[1:]
        start = 0
        for end in (np.flatnonzero(~inside) + 1).tolist():
            text = lines[start] if end == start + 1 else "\n".join(lines[start:end])
            if self.open:
                text = "\n".join([*self.open, text])
                self.open = []
            yield from self.piece(END if self.from_before else WHOLE, text)
            self.from_before, start = False, end
        self.open += lines[start:]
        self.odd = bool(inside[-1]) if len(inside) else self.odd

    def close(self) -> Iterator[tuple]:
        if self.open:
            yield from self.piece(INSIDE if self.from_before else BEGIN, "\n".join(self.open))

    def piece(self, kind: int, text: str) -> Iterator[tuple]:
        if kind == WHOLE and text in ("", "\r"):
            return
        first, self.header = self.header, False
        if not (first and kind == WHOLE):
            yield self.file, self.block, kind, first, text


def _pieces(lines: DataFrame, header: bool) -> DataFrame:
    """(file, block, kind, header, text) of lines (file, block, inside, value) in their order in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            files, blocks = batch.column(0), batch.column(1).to_numpy()
            said = batch.column(3)
            odd = pc.count_substring(said, '"').to_numpy() % 2 == 1
            names = pc.dictionary_encode(files)
            code = names.indices.to_numpy()
            edges = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(blocks)]
            texts, out = said.to_pylist(), []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                file, block = names.dictionary[code[a]].as_py(), int(blocks[a])
                if split is None or (split.file, split.block) != (file, block):
                    out += split.close() if split else ()
                    split = _Split(file, block, batch.column(2)[a].as_py(), header)
                out += split.add(texts[a:b], odd[a:b])
            yield _batch(out)
        if split:
            yield _batch(list(split.close()))

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "block", "kind", "header", "text"])

    return lines.mapInArrow(run, "file string, block long, kind int, header boolean, text string")


def csv_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(record) of the CSV files at path: each record's text, with its line breaks; blank lines and headers are left out.

    A file is read by as many tasks as it has splits. A first pass counts the quotes of each split;
    from their running parity each split knows whether it begins inside a quoted field. A second pass
    puts lines together to records; of a record that crosses splits each has a piece, and only these
    pieces move. Quotes are as in RFC 4180: a field that holds one is quoted, and it is doubled. A file
    that ends inside quotes raises. What comes to every task is a row for each split.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = lines.groupBy("file", "block").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = quotes.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    known = lines.join(F.broadcast(splits), ["file", "block"]).select("file", "block", "inside", "value")
    pieces = _pieces(known, header)
    whole = pieces.where(F.col("kind") == WHOLE).select(F.col("text").alias("record"))
    parts = pieces.where(F.col("kind") != WHOLE).select("file", "block", "kind", "header", "text")
    record = F.sum((F.col("kind") == BEGIN).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind"))
    parts = parts.withColumn("n", record).groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("p"), F.bool_or("header").alias("header"))
    ended = F.when(F.exists("p", lambda x: x["kind"] == END), F.array_join(F.transform("p", lambda x: x["text"]), "\n")).otherwise(F.raise_error(F.concat(F.lit("inside quotes at the end of "), "file")).cast("string"))
    return whole.union(parts.where("not header").select(ended.alias("record")))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = True) -> DataFrame:
    """Quoted CSV with line breaks in fields, in parallel (see csv_records). A record that the schema doesn't fit raises."""
    record = F.when(F.endswith("record", F.lit("\r")), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    parsed = F.from_csv(record, _ddl(schema), {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"})
    return csv_records(spark, path, header).select(parsed.alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with line breaks in fields. Repeated or null ids and stamps of another form raise."""
    raw = read_csv(spark, path, TWEETS)
    out = raw.withColumn("_ts", created_at(F.col("created_at")))
    bad = out.where(F.col("_ts").isNull() & F.col("created_at").isNotNull())
    if n := bad.count():
        raise ValueError(f"{n} stamps do not match the format, such as {[r[0] for r in bad.select('created_at').limit(5).collect()]}")
    expect_unique(out, "tweet_id")
    return out.withColumn("created_at", F.col("_ts")).drop("_ts")


def _records(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """(at, value, r) of the lines that aren't blank: their place (by file, then in it), text, and record, null where it has no key or is broken."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(place.alias("at"), "value").where(F.trim("value") != "")
    return lines.withColumn("r", F.from_json("value", schema)).withColumn("r", F.when(F.col(f"r.{key}").isNotNull(), F.col("r")))


def skipped(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """(file, value): lines that read_latest skips."""
    return _records(spark, path, schema, key).where("r is null").select("at.file", "value")


def read_latest(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines, broken ones skipped with a warning that counts them; the last record of a key counts, files in the order of their names."""
    bad = skipped(spark, path, schema, key)
    if n := bad.count():
        warnings.warn(f"{n} lines are no records with {key} and are skipped, such as {[tuple(r) for r in bad.limit(3).collect()]}", stacklevel=2)
    rows = _records(spark, path, schema, key).where("r is not null")
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of fresh in place of those of the same key."""
    return existing.join(fresh, key, "left_anti").unionByName(fresh)


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, blank ones skipped; a broken one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cached_or_raw(spark: SparkSession, parquet: str, csv: str) -> DataFrame:
    """The Parquet copy of the tweets where there is one, else the CSV; how old the copy is isn't asked."""
    at = spark._jvm.org.apache.hadoop.fs.Path(parquet)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(parquet) if there else read_tweets(spark, csv)


def write_rows(df: DataFrame, path: str, kind: str = "parquet", append: bool = False) -> None:
    """Parquet or JSON lines in place of what is there, or beside it."""
    df.write.mode("append" if append else "overwrite").format(kind).save(path)


def append_record(path: str, record: dict) -> None:
    """One JSON line at the end of a driver's file, on disk when this returns, so that a session can be resumed."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def write_report(path: str, tables: dict) -> None:
    """A nested report, small tables as lists of rows, as one JSON file that appears whole."""
    as_rows = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in tables.items()}
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(as_rows, f, indent=2, ensure_ascii=False, default=str)
    os.replace(f"{path}.part", path)


def merge_scores(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """upsert, each key once on either side and after, in the order of the key."""
    expect_unique(fresh, *key)
    out = upsert(existing, fresh, key)
    expect_unique(out, *key)
    return out.orderBy(*key)


def read_exemplars(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id): conversations listed on exemplar pages, each once; no page, or one that lists none, raises."""
    if not paths:
        raise FileNotFoundError("there are no exemplar pages")
    found = None
    for path in paths:
        ids = spark.read.text(path).select(F.regexp_extract("value", r"^- `(\d+)`", 1).alias("id")).where("id <> ''").select(F.col("id").cast("long").alias("id"))
        if not ids.limit(1).count():
            raise ValueError(f"{path} lists no exemplars")
        found = ids if found is None else found.union(ids)
    return found.distinct()
