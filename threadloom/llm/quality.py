"""Quality classifier: document evidence with hierarchical empirical-Bayes posteriors of host and path."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\w+")
#: A site's own documents hardly count beyond this many prior ones.
LARGEST_STRENGTH = 1e6
#: Sites up to which their sums are broadcast; beyond, the join shuffles, and Spark splits hot sites.
BROADCAST_SITES = 100_000


def shape(text: str) -> tuple[list[float], list[int]]:
    """Ten figures of a text's form, and its distinct words by their crc32, rising."""
    n = len(text)
    tokens = text.split()
    found = _WORD.findall(text.lower())
    distinct = set(found)
    upper = sum(map(str.isupper, tokens))
    letters = sum(map(len, found))
    m, k = max(1, len(found)), max(1, len(tokens))
    return [
        np.log1p(n), len(distinct) / m, len(distinct) / m * np.log1p(m), upper / k, 1 - letters / max(1, n), letters / m / 10,
        text.count("\n") / k, text.count("|") / k, (text.count("!") + text.count("?")) / k, np.log1p(len(found) / max(1, text.count(".") + text.count("!"))),
    ], sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in distinct})


class Evidence:
    """Logistic regression on form and on the words that tell two classes apart."""

    def __init__(self, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, words: dict[int, float]):
        self.weights, self.centre, self.scale, self.words = weights, centre, scale, words

    @classmethod
    def fit(cls, rows: list[tuple[list[float], np.ndarray]], y: np.ndarray, least_docs: int = 5, max_words: int = 20_000) -> Evidence:
        every = np.concatenate([found for _, found in rows] or [np.zeros(0, np.uint32)])
        of = np.repeat(y, [len(found) for _, found in rows]) if len(rows) else y
        known, inverse = np.unique(every, return_inverse=True)
        both, ones = np.bincount(inverse, minlength=len(known)), np.bincount(inverse, of, minlength=len(known))
        n1, n0 = y.sum() + 1, len(y) - y.sum() + 1
        ratio = np.log((ones + 0.5) / n1) - np.log((both - ones + 0.5) / n0)
        often = np.flatnonzero(both >= least_docs)
        often = often[np.argsort(-np.abs(ratio[often]) * np.sqrt(both[often]), kind="stable")][:max_words]
        told = dict(zip(known[often].tolist(), ratio[often].tolist(), strict=True))
        x = np.array([cls._row(figures, found, told) for figures, found in rows], float).reshape(len(rows), 14)
        if len(x) == 0 or y.min() == y.max():
            width = x.shape[1] if len(x) else 14
            bias = np.log(n1 / n0) if len(x) else 0.0
            return cls(np.r_[np.zeros(width), bias], np.zeros(width), np.ones(width), told)
        centre, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - centre) / scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(25):  # Newton's method with a ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (y - p) - np.r_[w[:-1], 0]
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(np.r_[np.ones(len(w) - 1), 1e-6])
            w = w + np.linalg.solve(hess, grad)
        return cls(w, centre, scale, told)

    @staticmethod
    def _row(figures: list[float], found, told: dict[int, float]) -> list[float]:
        seen = [told[w] for w in (found.tolist() if isinstance(found, np.ndarray) else found) if w in told] or [0.0]
        return [*figures, max(seen), min(seen), sum(seen) / len(seen), sum(s for s in seen if s > 2)]

    def logit(self, figures: list[float], found) -> float:
        x = (np.array(self._row(figures, found, self.words)) - self.centre) / self.scale
        return float(np.clip(x @ self.weights[:-1] + self.weights[-1], -12, 12))


def evidence(text: Column, models: dict[str, Evidence]) -> Column:
    """struct of each model's log-odds; null for a null text."""
    names = sorted(models)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                row = None if t is None else shape(t)
                out.append([None if row is None else models[n].logit(*row) for n in names])
            yield pd.DataFrame(out, columns=names, dtype=float)

    return F.pandas_udf(judged, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))(text)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, parent: Column, estimated: bool) -> float:
    """Prior documents by which a site (k: sum, squares: sum of squares, n) is shrunk to its parent: variance within sites over variance between them.

    The method of moments of one-way random effects: within is the documents' variance around their
    own site's mean, N - K degrees of freedom; sites' means are spread around the parent by that, n
    times less, and by the variance between. estimated: the parent is the sites' own overall mean.
    """
    mean = F.col("k") / F.col("n")
    row = sites.where("n > 0").agg(
        F.count("*").alias("sites"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("squares").alias("squares"), F.sum(F.col("k") * mean).alias("own"), F.sum(F.col("n") * (mean - parent) ** 2).alias("apart"),
    ).first()
    n, k = row["n"] or 0, row["sites"]
    if n <= k:  # no site has two documents: nothing tells their noise from the sites' own differences
        return LARGEST_STRENGTH
    within = max(0.0, row["squares"] - row["own"]) / (n - k)
    free = n - row["nn"] / n if estimated else n
    between = (row["apart"] - (k - estimated) * within) / free if free > 0 else 0.0
    return float(min(max(within / between, 0.01), LARGEST_STRENGTH)) if between > 0 else LARGEST_STRENGTH


def posteriors(scored: DataFrame, p: str, host: str = "host", path: str = "path") -> DataFrame:
    """(host, path, host_p, path_p, global_p, ...): mean of p by host shrunk to the global mean, and by path shrunk to its host's.

    The sums (host_k, host_n, path_k, path_n) and strengths (host_m, path_m) let a document be left out of its own site.
    """
    none = F.lit(0.0)  # a site of null texts alone has no sums
    paths = scored.groupBy(host, path).agg(F.coalesce(F.sum(p), none).alias("k"), F.coalesce(F.sum(F.col(p) * F.col(p)), none).alias("squares"), F.count(p).alias("n"))
    hosts = paths.groupBy(host).agg(F.sum("k").alias("k"), F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("k"), F.sum("n")).first()
    overall = ((whole[0] or 0.0) + 1) / ((whole[1] or 0) + 2)
    m = _strength(hosts, F.lit(overall), True)
    hosts = hosts.select(F.col(host).alias("_h"), ((F.col("k") + m * overall) / (F.col("n") + m)).alias("host_p"), F.col("k").alias("host_k"), F.col("n").alias("host_n"), F.lit(m).alias("host_m"))
    joined = paths.join(hosts, F.col(host).eqNullSafe(F.col("_h"))).drop("_h")
    m = _strength(joined, F.col("host_p"), False)
    return joined.select(host, path, "host_p", ((F.col("k") + m * F.col("host_p")) / (F.col("n") + m)).alias("path_p"), F.lit(overall).alias("global_p"), "host_k", "host_n", "host_m", F.col("k").alias("path_k"), F.col("n").alias("path_n"), F.lit(m).alias("path_m"))


def left_out(p: str) -> tuple[Column, Column]:
    """(host, path) posteriors of a document's site from the other documents only; p null: it isn't among them."""
    own, one = F.coalesce(p, F.lit(0.0)), F.col(p).isNotNull().cast("int")
    by_host = (F.greatest(F.col("host_k") - own, F.lit(0.0)) + F.col("host_m") * F.col("global_p")) / (F.col("host_n") - one + F.col("host_m"))
    return by_host, (F.greatest(F.col("path_k") - own, F.lit(0.0)) + F.col("path_m") * by_host) / (F.col("path_n") - one + F.col("path_m"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", section_col: str = "lang", sample_docs: int = 8_000, least_docs: int = 5, max_words: int = 20_000, keep_from: float = 0.5, toxic_from: float = 0.5) -> DataFrame:
    """(doc_id, host, path, quality_doc, quality_host, quality_path, quality, toxic_doc, toxic_path, toxic, keep) of each document.

    The classifiers of one document's text are fitted on a bounded sample, the sample_docs labelled
    documents whose id hashes lowest (labels: id_col, quality, toxic; rows with a null are left
    out), on their form and the max_words words of the sample, in least_docs of its documents, that
    tell the classes apart best. Everything else covers all documents: their probabilities are averaged by host and by
    path (host and section), shrunk towards the parents by strengths estimated from all sites, and
    a document's log-odds move by the log-odds of its path's other documents against the global
    ones: its own evidence counts once. keep: quality of
    keep_from at least and toxic under toxic_from. A null text gets its path's posterior; null
    hosts and sections are sites; rows stay one to one; without labels all are at the prior.
    """
    known = labels.select(F.col(id_col).alias("_id"), "quality", "toxic").dropna().groupBy("_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(F.broadcast(picked), "_id").select("_id", "t", "quality", "toxic")
    sample = sorted(_shaped(picked), key=lambda r: r[0])
    rows = [(r[1], r[2]) for r in sample]
    models = {name: Evidence.fit(rows, np.array([float(r[i] > 0) for r in sample]), least_docs, max_words) for name, i in (("quality", 3), ("toxic", 4))}
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_t"), F.col(host_col).cast("string").alias("host"), F.concat_ws("/", F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.coalesce(F.col(section_col).cast("string"), F.lit(""))).alias("path"))
    from threadloom.llm.shared import written

    scored = written(base.select("doc_id", "host", "path", evidence(F.col("_t"), models).alias("e")).select("doc_id", "host", "path", F.col("e.quality").alias("q"), F.col("e.toxic").alias("x")), "evidence")
    sure = lambda c: 1 / (1 + F.exp(-F.col(c)))
    scored = scored.withColumns({"quality_doc": sure("q"), "toxic_doc": sure("x")})
    for p in ("quality", "toxic"):
        site = posteriors(scored, f"{p}_doc").drop("host_p", "path_p").withColumnsRenamed({"host": "_h", "path": "_p"})
        site = F.broadcast(site) if site.count() <= BROADCAST_SITES else site
        sums = site.columns
        scored = scored.join(site, F.col("host").eqNullSafe(F.col("_h")) & (F.col("path") == F.col("_p")), "left")
        by_host, by_path = left_out(f"{p}_doc")
        scored = scored.withColumns({f"{p}_host": by_host, f"{p}_path": by_path, f"{p}_all": F.col("global_p")}).drop(*sums)
        doc = F.coalesce(F.col("q" if p == "quality" else "x"), _logit(F.col(f"{p}_all")))
        scored = scored.withColumn(p, 1 / (1 + F.exp(-(doc + _logit(F.col(f"{p}_path")) - _logit(F.col(f"{p}_all"))))))
    keep = (F.col("quality") >= keep_from) & (F.col("toxic") < toxic_from)
    return scored.select("doc_id", "host", "path", "quality_doc", "quality_host", "quality_path", "quality", "toxic_doc", "toxic_path", "toxic", keep.alias("keep"))


def _shaped(picked: DataFrame) -> list[tuple]:
    """(id, figures, words, quality, toxic): texts are taken apart on the executors."""
    schema = "id long, figures array<double>, words binary, quality double, toxic double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [shape(t) for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["_id"], "figures": [g[0] for g in got], "words": [np.array(g[1], np.uint32).tobytes() for g in got], "quality": pdf["quality"].astype(float), "toxic": pdf["toxic"].astype(float)})

    return [(r[0], list(r[1]), np.frombuffer(bytes(r[2]), np.uint32), r[3], r[4]) for r in picked.mapInPandas(run, schema).collect()]


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
