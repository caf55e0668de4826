"""License scans by diagonal voting over rolling word 2-grams, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases that are counted wherever their words stand consecutively, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Longer wordings by which the method finds licenses, with labels of its own.
TEMPLATES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by": "licensed under cc by",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mit-notice": "released under the mit license",
    "all-rights-reserved": "all rights reserved",
}
#: Of a template's 2-grams, the part that must be found in order.
LEAST = 0.8
#: Diagonals that lie this near are one: so many words more or fewer between two parts.
NEAR = 2
#: Rows of template 2-grams up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_parts(text: Column) -> Column:
    """What stands between the separators of a text, A-Z lower-cased: its words, and an empty string where a separator is at an end."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN)


def inner_words(parts: Column | str) -> Column:
    """The parts without empty ones at either end."""
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def word_array(text: Column) -> Column:
    """Words of a text: runs of digits, letters and all characters beyond ASCII, A-Z lower-cased and nothing else; a null text has none."""
    return inner_words(word_parts(text))


def _templates(spark: SparkSession, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    rows = [(i, label, kind, len(text.split()) - 1, j, *text.split()[j : j + 2]) for i, (label, text, kind) in enumerate([*((v, k, "base") for k, v in base.items()), *((k, v, "own") for k, v in templates.items())]) for j in range(len(text.split()) - 1)]
    df = spark.createDataFrame(rows, "template int, label string, kind string, grams int, at int, w1 string, w2 string")
    return df.select("template", "label", "kind", "grams", "at", F.xxhash64("w1", "w2").alias("gram"), F.col("w1").alias("t1"), F.col("w2").alias("t2"))


def places(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id, label, kind, start, end, share) of each place of a template in docs (id, words)."""
    grams = docs.select("id", F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))).alias("pos", "g"))
    grams = grams.select("id", "pos", F.col("g.a").alias("w1"), F.col("g.b").alias("w2"), F.xxhash64("g.a", "g.b").alias("gram"))
    known = _templates(docs.sparkSession, base, templates)
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    votes = grams.join(known, "gram").where("w1 = t1 and w2 = t2").select("id", "template", "label", "kind", "grams", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    lines = votes.groupBy("id", "template", "label", "kind", "grams", "diagonal").agg(F.count_distinct("at").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("at").alias("at_low"), F.max("at").alias("at_high"))
    # Neighbouring diagonals are one place when the later part of the template follows in the text too:
    # on a higher one after words that were added, on a lower one after words that are missing.
    own = F.col("kind") == "own"
    w = Window.partitionBy("id", "template").orderBy("diagonal")
    apart = ~F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) <= NEAR) & own, F.lit(False))
    lines = lines.withColumn("band", F.sum(apart.cast("int")).over(w))
    w = Window.partitionBy("id", "template", "band").orderBy("low", "diagonal")
    after = (F.col("at_low") > F.lag("at_high").over(w)) & (F.col("low") > F.lag("high").over(w))
    lines = lines.withColumn("place", F.struct("band", F.sum(F.when(F.coalesce(after, F.lit(False)), 0).otherwise(1)).over(w).alias("n")))
    merged = lines.groupBy("id", "template", "label", "kind", "grams", "place").agg(F.sum("votes").alias("votes"), F.min("low").alias("start"), (F.max("high") + 1).alias("end"))
    need = F.when(F.col("kind") == "base", F.col("grams")).otherwise(F.ceil(F.lit(LEAST) * F.col("grams")))
    return merged.where(F.col("votes") >= need).select("id", "label", "kind", "start", "end", F.least(F.col("votes") / F.col("grams"), F.lit(1.0)).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs.

    Every row stays, repeated rows and null ids too. Null and empty texts have no words: counts 0,
    first_word and last_word null, labels empty, score 0. Other columns of docs are not read. score
    is the largest part of a template that was found. A phrase of one word is not a 2-gram: base
    and templates take phrases of two words at least.
    """
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    # Equal (id, text) rows have one id in places, which counts each place of a template once.
    words = rows.select("_doc", word_array(F.col("_text")).alias("words"), F.xxhash64("_text", F.lit(1)).alias("_k"))
    at = places(words.where(F.size("words") > 1).select(F.struct("_doc", "_k").alias("id"), "words"), base, templates).distinct()
    is_base = F.col("kind") == "base"
    found = at.groupBy("id").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    ).select(F.col("id._doc").alias("f_doc"), F.col("id._k").alias("f_k"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    counted = words.select("_doc", "_k", F.size("words").cast("long").alias("n_words"))
    out = counted.join(found, F.col("_doc").eqNullSafe(F.col("f_doc")) & (F.col("_k") == F.col("f_k")), "left")
    return out.select(
        F.col("_doc").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
