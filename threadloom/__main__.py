"""python -m threadloom STAGE ...: the stages on files, each reading what the one before wrote."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.judging import AXES
from threadloom.functions.text import INTENTS
from threadloom.operators import answering, calls, clusters, evaluation, forest, judging, labelling, metrics, sampling, survey, turns, vectors
from threadloom.sources import checks, io


def _forest_input(tweets: DataFrame) -> DataFrame:
    return tweets.select(F.col("tweet_id").alias("id"), F.col("in_response_to_tweet_id").alias("parent"), "inbound", F.col("created_at").alias("ts"), "author_id", "text", F.col("response_tweet_id").alias("responses"))


def ingest(spark, a) -> None:
    tweets = io.cached_or_raw(spark, a.out, a.csv) if a.cached else io.read_tweets(spark, a.csv)
    if not a.no_write and not a.cached:
        io.write_rows(tweets, a.out)
    tweets.groupBy("inbound").count().orderBy("inbound").show()


def threads(spark, a) -> None:
    built = forest.cut(forest.build(_forest_input(spark.read.parquet(a.tweets))))
    survey.thread_summary(built).show(vertical=True)
    if not a.no_write:
        io.write_rows(built, a.out)


def conversations(spark, a) -> None:
    assigned = forest.cut(forest.assign(spark.read.parquet(a.threads)))
    survey.conversation_counts(assigned).show(truncate=False)
    if not a.no_write:
        io.write_rows(assigned, a.out)


def sample(spark, a) -> None:
    rows = _forest_input(spark.read.parquet(a.tweets)).drop("responses").join(spark.read.parquet(a.conversations).select("id", "conversation_id"), "id").where("conversation_id is not null")
    selected = turns.select_brand(rows, a.brand)
    merged = forest.cut(turns.clean(turns.merge_groups(turns.cap(selected, a.most))))
    turned = forest.cut(turns.turns(merged))
    out = forest.cut(turns.nested(turned))
    survey.sample_summary(rows, selected, merged, turned, out).show(vertical=True)
    io.write_rows(out, a.out)


def taxonomy(spark, a) -> None:
    held = spark.read.parquet(a.vectors)
    if a.pool:
        for part in survey.taxonomy_summary(spark.read.parquet(a.pool), spark.read.parquet(a.sampled or a.pool), calls.answered(spark, a.cache or f"{a.pool}-cache", calls.VECTORS), a.model):
            part.show(100, truncate=False)
    clusters.sweep(held, a.k_min, a.k_max).show()
    if a.out:
        rows, _ = clusters.cluster(held.select("id", "cv"), a.k_max)
        chosen = clusters.exemplars(rows.select("id", "cluster").join(held.select("id", "source", "text"), "id"))
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(clusters.exemplar_text(chosen, a.k_max))


def brands(spark, a) -> None:
    tweets = _forest_input(spark.read.parquet(a.tweets)).join(spark.read.parquet(a.conversations).select("id", "conversation_id"), "id")
    replies = tweets.where("not inbound and conversation_id is not null")
    if a.prefixes:
        survey.prefixes(replies, survey.top_brands(replies, a.top)).orderBy("author_id", "rank").show(1000, truncate=False)
    if a.residuals:
        survey.residuals(replies.join(survey.top_brands(replies, a.top).select("author_id"), "author_id", "left_semi")).orderBy("deflection", "id").show(100, truncate=False)
    if not (a.prefixes or a.residuals):
        survey.report(tweets, a.top).show(truncate=False)


def _callable(name: str):
    """What `module:function` names, or None."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _similarities(messages: DataFrame, pool: DataFrame) -> None:
    """The distribution of each message's best similarity, and how many would lie under a floor."""
    top = forest.cut(vectors.top_k(messages.select("query_id", "qv"), pool.select("item_id", "cv"), 1).select("similarity"))
    at = (0, 10, 25, 50, 75, 90, 100)
    print("  ".join(f"p{p}={v:.3f}" for p, v in zip(at, metrics.quantiles(top, "similarity", [p / 100 for p in at]), strict=True) if v is not None))
    edges = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]
    vectors.histogram(top, "similarity", edges).orderBy("low").show()
    top.select("similarity", F.explode(F.array(*[F.lit(e) for e in edges[1:-1]])).alias("floor")).groupBy("floor").agg(F.count_if(F.col("similarity") < F.col("floor")).alias("under")).orderBy("floor").show()


def agent(spark, a) -> None:
    messages, pool = spark.read.parquet(a.messages), spark.read.parquet(a.pool)
    if a.diagnose:
        _similarities(messages, pool)
        return
    classify, reply = (a.classifier, answering.classify_instructions()), (a.generator, answering.reply_instructions(a.brand))
    cache = calls.answered(spark, a.ledger)
    near = forest.cut(answering.retrieved(messages.select("query_id", "qv"), pool, a.k))
    answering.preflight(messages, near, cache, classify, reply, a.force_reply, most=a.max_live_calls).show()
    out = forest.cut(answering.run(messages, pool, cache, classify, reply, _callable(a.call), a.ledger, a.k, a.force_reply))
    out.agg(F.count("*").alias("messages"), F.count_if(F.col("decision") == "escalate").alias("escalated"), F.count_if("reply_generated").alias("replied"), F.count_if(~F.col("parse_ok")).alias("unparsed")).show()
    if a.out:
        io.write_rows(out, a.out, "json")
    else:
        out.select("query_id", "intent", "decision", "reason", "reply").orderBy("query_id").show(1000, truncate=False)


def baselines(spark, a) -> None:
    messages, bank, pool = (spark.read.parquet(x) for x in (a.messages, a.bank, a.pool))
    positions = spark.createDataFrame([(x, i) for i, x in enumerate(INTENTS)], "label string, pos int")
    made = {"knn": lambda: answering.knn_answer(messages, bank, pool, k=a.k), "majority": lambda: answering.majority_answer(messages, bank, positions)}
    for name in [a.only] if a.only else sorted(made):
        out = forest.cut(made[name]())
        truth = bank.select("text", "label").dropDuplicates(["text"])
        right = out.join(messages.select("query_id", "text"), "query_id").join(truth, "text", "left")
        right.agg(F.lit(name).alias("baseline"), F.count("*").alias("messages"), F.count_if(F.col("decision") == "escalate").alias("escalated"), F.count_if(F.col("intent") == F.col("label")).alias("same_label")).show()
        if name == "knn":
            checks.expect_disjoint(messages.withColumnRenamed("query_id", "item_id"), pool, "item_id")
            out.agg(F.count_if(F.col("top_similarity") >= 0.95).alias("near_duplicates"), F.max("top_similarity").alias("most")).show()
        if a.out_dir:
            io.write_rows(out, f"{a.out_dir}/{name}_golden", "json")


def evaluate(spark, a) -> None:
    golden = sampling.numbered(spark.read.json(a.golden).select("conversation_id", F.col("intent").alias("y_true")), "conversation_id", "pos")
    pairs = None
    for path in a.predictions:
        own = evaluation.aligned(golden, spark.read.json(path).select("conversation_id", F.col("intent").alias("y_pred"))).withColumn("system", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
        own = evaluation.checked(own.select("system", "pos", "y_true", "y_pred"))
        pairs = own if pairs is None else pairs.union(own)
    n = golden.count()
    tables = {"intent": evaluation.intent_table(pairs, n, len(INTENTS), a.resamples), "per_class": evaluation.per_class_table(pairs)}
    for t in tables.values():
        t.orderBy("system").show(100, truncate=False)
    if a.json:
        io.write_report(a.json, tables)


def judge(spark, a) -> None:
    schema = "system string, conversation_id long, repeat int, raw string, parse_ok boolean, " + ", ".join(f"{x} int" for x in AXES)
    rows = spark.read.schema(schema).json(a.scores)
    judging.summary(rows).show()
    if a.repeat > 1:
        judging.consistency(rows.where(F.col("system") == a.system), a.repeat).show()
    if a.human:
        human = judging.latest(spark.read.json(a.human).withColumn("_at", F.monotonically_increasing_id()), ["conversation_id"], "_at")
        judging.agreement(human, judging.of_system(rows, a.system)).show()


def label(spark, a) -> None:
    first = spark.read.json(a.first)
    if a.second:
        both, orphans = labelling.joined(first, spark.read.json(a.second))
        print(f"{orphans} of the second pass are not in the first")
        labelling.agreement(both, INTENTS).show()
        labelling.disagreements(both, INTENTS, shown=1000).show(truncate=False)
        labelling.involved(both, INTENTS).show()
    else:
        labelling.relabel(spark.read.parquet(a.pool), first, a.total).show(a.total, truncate=False)


#: stage: (what it runs, its arguments: name, default; no default: needed).
STAGES = {
    "ingest": (ingest, {"csv": None, "out": None, "cached": False, "no_write": False}),
    "threads": (threads, {"tweets": None, "out": "", "no_write": False}),
    "conversations": (conversations, {"threads": None, "out": "", "no_write": False}),
    "sample": (sample, {"tweets": None, "conversations": None, "brand": None, "out": None, "most": turns.MAX_TWEETS}),
    "taxonomy": (taxonomy, {"vectors": None, "k_min": 5, "k_max": 12, "out": "", "pool": "", "sampled": "", "cache": "", "model": "encoder"}),
    "survey": (brands, {"tweets": None, "conversations": None, "top": 8, "prefixes": False, "residuals": False}),
    "agent": (agent, {"messages": None, "pool": None, "ledger": None, "brand": "the company", "classifier": "llama-3.1-8b-instant", "generator": "gemini-flash", "call": "", "k": 3, "force_reply": False, "max_live_calls": 0, "diagnose": False, "out": ""}),
    "baselines": (baselines, {"messages": None, "bank": None, "pool": None, "k": 3, "only": "", "out_dir": ""}),
    "evaluate": (evaluate, {"golden": None, "predictions": [], "resamples": 1000, "json": ""}),
    "judge": (judge, {"scores": None, "system": "agent", "repeat": 1, "human": ""}),
    "label": (label, {"first": None, "second": "", "pool": "", "total": 50}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    stages = out.add_subparsers(dest="stage", required=True)
    for name, (_, options) in STAGES.items():
        one = stages.add_parser(name)
        for option, default in options.items():
            flag = f"--{option.replace('_', '-')}"
            if isinstance(default, bool):
                one.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                one.add_argument(flag, nargs="+", required=True)
            else:
                one.add_argument(flag, required=default is None, default=default, type=type(default) if default is not None else str)
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"threadloom {a.stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        STAGES[a.stage][0](spark, a)
    except (calls.CacheMiss, calls.OverBudget) as e:  # refusals that were asked for, not faults
        print(f"stopped: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
