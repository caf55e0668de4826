"""Language identification by compression with one zstandard dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A text is coded in pieces of this many bytes, each beginning with the dictionary alone, so that
#: long texts speak of the language as clearly as short ones.
PIECE = 8192
#: Matches of three bytes count, as short function words tell languages apart.
CODING = {"min_match": 3, "strategy": zstandard.STRATEGY_LAZY2, "search_log": 4, "hash_log": 15, "chain_log": 16, "window_log": 17}
_NOT_LETTERS = re.compile(r"[\W\d_]+")

_OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])


def normal(text: str) -> bytes:
    """What is coded: the lower-cased text, each run of other characters than letters as one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def fit(train: DataFrame, text_col: str, lang_col: str, order_col: str, docs_per_language: int = 64, dictionary_bytes: int = 32_768, max_languages: int = 256) -> dict[str, bytes]:
    """One raw-content dictionary for each language.

    Bounded sample, whatever the size of train: of each language, the docs_per_language documents
    whose order_col hashes lowest, in that order, until dictionary_bytes are full. Every language is
    learned, up to max_languages of them (most documents first, then by name), which bounds the
    dictionaries that go to each task. Null texts and languages are left out.
    """
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.col(order_col)).alias("_h"), F.col(order_col).alias("_id"), F.col(text_col).cast("string").substr(1, dictionary_bytes).alias("_t"))
    learned = known.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(max_languages).select("_lang")
    ranked = known.drop("_t").join(F.broadcast(learned), "_lang", "left_semi").select("_lang", "_h", "_id")
    window = Window.partitionBy("_lang").orderBy("_h", "_id")
    chosen = ranked.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= docs_per_language)
    # At most docs_per_language * max_languages rows, here and in the texts below.
    rows = known.join(F.broadcast(chosen.select("_lang", "_id").distinct()), ["_lang", "_id"], "left_semi")
    # Of a repeated id's texts the first ones by their order make up the number.
    again = Window.partitionBy("_lang").orderBy("_h", "_id", "_t")
    rows = rows.withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= docs_per_language).select(F.col("_lang").alias("l"), F.col("_h").alias("h"), F.col("_t").alias("t")).collect()
    texts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        texts.setdefault(r["l"], []).append(normal(r["t"]))
    out = {}
    for lang in sorted(texts):
        parts, room = [], dictionary_bytes
        for t in texts[lang]:
            parts.append(t[:room])
            room -= len(parts[-1])
            if room <= 0:
                break
        out[lang] = b"\n".join(reversed(parts))  # zstandard reaches the end of a dictionary most cheaply
    return out


def predict(text: Column, model: dict[str, bytes]) -> Column:
    """struct(lang_pred, score, margin) of a text.

    lang_pred is the language whose dictionary codes the text smallest (ties: the first name), or
    `und` for a null text or one without a letter. margin is (second - best) / second size, 0 for
    `und` or with one language; score is 1 - 2^-(bytes by which the best is smaller).
    """
    if not model:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"))
    names = sorted(model)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, **CODING)
            content.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))
        for batch in batches:
            langs, scores, margins = [], [], []
            for t in batch:
                if t is None:
                    langs.append("und")
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                data = normal(t)
                pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
                order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
                best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else sizes[order[0]]
                langs.append(names[order[0]])
                scores.append(1 - 2.0 ** -min(60, second - best))
                margins.append((second - best) / second)
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "margin": margins})

    lettered = F.when(text.rlike(r"\p{L}"), text)
    return F.pandas_udf(judged, _OUT)(lettered)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = 0.0, **bounds) -> DataFrame:
    """docs with held_out, lang_pred, score, margin and rejected.

    Learns from the documents that are not held out. A text is rejected when it is `und` or its
    margin is under min_margin. Every row of docs stays, repeated rows too; null and empty texts
    and texts without letters are `und` with score 0; an empty table gives an empty table. Columns
    of docs that have one of the added names are replaced.
    """
    model = fit(docs.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()), text_col, lang_col, id_col, **bounds)
    p = "_p"
    while p in docs.columns:
        p += "_"
    judged = docs.withColumn(p, predict(F.col(text_col), model))
    # Kept out of the Python node's way: the flags are plain expressions of its result.
    return judged.withColumns({"held_out": held_out(F.col(id_col)), "lang_pred": F.col(p)["lang_pred"], "score": F.col(p)["score"], "margin": F.col(p)["margin"], "rejected": (F.col(p)["lang_pred"] == "und") | (F.col(p)["margin"] < min_margin)}).drop(p)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text", "lang"), min_margin=MIN_MARGIN).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


#: Texts whose best and second language differ by less than this part of the coded size are rejected.
MIN_MARGIN = 0.0005
