"""URL filters: host and path rules, and gradient-boosted trees on lexical features elsewhere."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, rule); a rule is a host, then the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Characters whose frequencies make the entropy.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/-._?=&%#:"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "hyphens", "params", "secure", "entropy", "suffix_rate")


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, the first of equally long ones; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def with_features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features but suffix_rate; a null url counts as empty."""
    u = F.coalesce("url", F.lit(""))
    low = F.lower(u)
    urls = urls.withColumns({"length": F.length(u).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"), "_low": low})
    urls = urls.withColumns(
        {
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digits": F.regexp_count("_low", F.lit("[0-9]")).cast("double"),
            "hyphens": F.regexp_count("_low", F.lit("-")).cast("double"),
            "params": F.regexp_count("_low", F.lit(r"[?&][^=&#]+=")).cast("double"),
            "secure": F.col("_low").startswith("https:").cast("double"),
        }
    )
    urls = urls.withColumn("digit_ratio", F.col("digits") / F.greatest("length", F.lit(1.0)))
    counts = [(F.length("_low") - F.length(F.replace("_low", F.lit(c), F.lit("")))).cast("double") for c in _ALPHABET]
    urls = urls.withColumn("_counts", F.array(*counts))
    n = F.greatest("length", F.lit(1.0))
    bits = F.aggregate("_counts", F.lit(0.0), lambda a, c: a - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))
    return urls.withColumn("entropy", bits).withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).drop("_low", "_counts")


class Trees:
    """Boosted regression trees on the logistic loss, grown on quantile bins."""

    def __init__(self, base: float, trees: list):
        self.base, self.trees = base, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
        mean = (y.sum() + 1) / (len(y) + 2)
        base = float(np.log(mean / (1 - mean)))
        trees: list = []
        if len(y) == 0 or y.min() == y.max():
            return cls(base, trees)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        raw = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            step = np.zeros(len(y))

            def grow(rows: np.ndarray, left: int, grad=grad, hess=hess, step=step):
                g, h = grad[rows].sum(), hess[rows].sum()
                best, found = 1e-6, None
                for j in range(x.shape[1]) if left else ():
                    if not len(edges[j]):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(edges[j]) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(edges[j]) + 1))[:-1]
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, found = gain[k], (j, k)
                if found is None:
                    value = float(rate * g / (h + ridge))
                    step[rows] = value
                    return value
                j, k = found
                low = binned[rows, j] <= k
                return (j, float(edges[j][k]), grow(rows[low], left - 1), grow(rows[~low], left - 1))

            trees.append(grow(np.arange(len(y)), depth))
            raw = raw + step
        return cls(base, trees)

    def column(self, features: list[Column]) -> Column:
        """The model as a native expression: probability of the positive class."""

        def node(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(features[t[0]] <= t[1], node(t[2])).otherwise(node(t[3]))

        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [node(t) for t in self.trees], F.lit(self.base))))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample_rows: int = 20_000, seed: int = 7, prior: float = 20.0) -> DataFrame:
    """(id_col, host, path, rule, verdict, p_block) of each row of pages.

    URLs that a rule decides are the labelled ones. Suffix statistics (smoothed part of blocked URLs
    by last host label) come from all of them, the trees from a bounded sample: the sample_rows
    labelled URLs whose hash with seed is lowest. A URL without a rule gets the trees' verdict, block
    from 0.5; with no labelled URL that is the prior, 0.5. Rows stay one to one; null urls and those
    without `://` have an empty host and path. Other columns of pages are not read.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"))
    base = base.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = with_features(base.withColumns({"rule": rule, "said": verdict}))
    labelled = base.where(F.col("rule").isNotNull())
    block = (F.col("said") == "block").cast("double")
    stats = labelled.groupBy("suffix").agg(F.sum(block).alias("blocked"), F.count("*").alias("n"))
    whole = stats.agg(F.sum("blocked"), F.sum("n")).first()
    overall = ((whole[0] or 0.0) + 1) / ((whole[1] or 0) + 2)
    rates = stats.select(F.col("suffix").alias("_s"), ((F.col("blocked") + prior * overall) / (F.col("n") + prior)).alias("_rate"))
    # One row for each suffix: Spark broadcasts them where they are small, and splits a hot suffix where not.
    base = base.join(rates, F.col("suffix") == F.col("_s"), "left").withColumn("suffix_rate", F.coalesce("_rate", F.lit(overall))).drop("_s", "_rate")
    sample = base.where(F.col("rule").isNotNull()).select(*FEATURES, block.alias("y"), F.xxhash64(F.lit(seed), "url").alias("h")).orderBy("h", *FEATURES).limit(sample_rows).toPandas()
    model = Trees.fit(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float))
    scored = base.withColumn("p_block", model.column([F.col(f) for f in FEATURES]))
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "p_block")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
