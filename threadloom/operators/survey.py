"""What brands' replies look like, and stage summaries as one-row frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T
from threadloom.operators.sampling import lot

BROADCAST_BRANDS = 100_000


def top_brands(replies: DataFrame, n: int | None = 8) -> DataFrame:
    """(author_id, conversations): authors of outbound replies in the most conversations, ties by name; n None: all of them."""
    every = replies.groupBy("author_id").agg(F.count_distinct("conversation_id").alias("conversations"))
    return every if n is None else every.orderBy(F.desc("conversations"), "author_id").limit(n)


def several_brands(replies: DataFrame) -> DataFrame:
    """(n, several, several_pct): conversations with replies, and those with replies of more than one brand."""
    per = replies.groupBy("conversation_id").agg(F.count_distinct("author_id").alias("brands"))
    return per.agg(F.count("*").alias("n"), F.count_if(F.col("brands") > 1).alias("several"), (F.avg((F.col("brands") > 1).cast("double")) * 100).alias("several_pct"))


def addressed(inbound: DataFrame, brands: DataFrame) -> DataFrame:
    """(author_id, conversation_id): conversations in which a customer wrote @brand, in any case, also at the start of a longer name.

    What follows each @ is cut to the length of every name that there is (a few lengths, whatever the
    number of names), and these beginnings are joined with the names by equality. Names are not null.
    """
    names = brands.where("author_id is not null").select("author_id", F.lower("author_id").alias("_name"))
    lengths = sorted(r[0] for r in names.select(F.length("_name").alias("n")).distinct().collect())
    if not lengths:
        return inbound.select(F.lit(None).cast("string").alias("author_id"), "conversation_id").limit(0)
    after = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?s)@(?=(.{{0,{lengths[-1]}}}))"), 1)
    starts = F.flatten(F.transform(after, lambda x: F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(x)), lambda n: F.substring(x, F.lit(1), n))))
    said = inbound.select("conversation_id", F.explode(F.array_distinct(starts)).alias("_name")).distinct()
    return said.join(names, "_name").select("author_id", "conversation_id").distinct()


def report(tweets: DataFrame, n: int | None = 8) -> DataFrame:
    """One row for each of the n top brands (None: of all) of tweets (id, author_id, inbound, conversation_id, text), tweets in no conversation left out.

    conversations, median_tweets (of its conversations), answered_pct (of conversations that address
    it, those that it replied in; null if there are none), redirect_pct, deflection_pct,
    median_residual, non_english_pct, multipart_pct. Names of up to BROADCAST_BRANDS brands are sent to all tasks.
    """
    tweets = tweets.where(F.col("conversation_id").isNotNull())
    replies = tweets.where(~F.col("inbound"))
    brands = top_brands(replies, n)
    wanted = brands.select("author_id")
    own = replies if n is None else replies.join(F.broadcast(wanted) if n <= BROADCAST_BRANDS else wanted, "author_id", "left_semi")
    text = own.select("author_id", "conversation_id", T.once(T.normalize(F.col("text"))).alias("t"))
    text = text.select("author_id", T.has_redirect(F.col("t")).alias("redirect"), F.size(T.residual_words(F.col("t"))).alias("residual"), T.is_non_english(F.col("t")).alias("foreign"), F.coalesce(T.is_multipart(F.col("t")), F.lit(False)).alias("multipart"))
    pct = lambda c: F.avg(c.cast("double")) * 100
    rates = text.groupBy("author_id").agg(
        pct(F.col("redirect")).alias("redirect_pct"), pct(F.col("redirect") & (F.col("residual") <= T.MAX_RESIDUAL_WORDS)).alias("deflection_pct"), F.percentile("residual", F.lit(0.5)).alias("median_residual"), pct(F.col("foreign")).alias("non_english_pct"), pct(F.col("multipart")).alias("multipart_pct"),
    )
    pairs = own.select("author_id", "conversation_id").distinct()
    sizes = tweets.groupBy("conversation_id").agg(F.count("*").alias("size"))
    medians = pairs.join(sizes, "conversation_id").groupBy("author_id").agg(F.percentile("size", F.lit(0.5)).alias("median_tweets"))
    asked = addressed(tweets.where("inbound"), brands)
    answered = asked.join(pairs.withColumn("hit", F.lit(1)), ["author_id", "conversation_id"], "left").groupBy("author_id").agg((F.count("hit") / F.count("*") * 100).alias("answered_pct"))
    return brands.join(medians, "author_id").join(answered, "author_id", "left").join(rates, "author_id")


def prefixes(replies: DataFrame, brands: DataFrame, words: int = 6, most: int = 25) -> DataFrame:
    """(author_id, replies, prefixes, rank, prefix, n, share): each brand's `most` frequent beginnings of replies, ties by text."""
    own = replies.join(brands.select("author_id"), "author_id", "left_semi").select("author_id", T.first_words(F.col("text"), words).alias("prefix"))
    counts = own.groupBy("author_id", "prefix").agg(F.count("*").alias("n"))
    totals = counts.groupBy("author_id").agg(F.sum("n").alias("replies"), F.count("*").alias("prefixes"))
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("n"), "prefix"))
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.join(totals, "author_id").select("author_id", "replies", "prefixes", "rank", "prefix", "n", (F.col("n") / F.col("replies") * 100).alias("share"))


def residuals(replies: DataFrame, id_col: str = "id", drawn: int = 400, shown: int = 15, seed: int = 42) -> DataFrame:
    """(id, normal, residual, deflection): of `drawn` replies by lot, `shown` deflections and as many others, with the words that decide it."""
    lots = replies.orderBy(lot(seed, F.col(id_col)), id_col).limit(drawn)
    rows = lots.select(F.col(id_col).alias("id"), T.once(T.normalize(F.col("text"))).alias("normal"))
    rows = rows.select("id", "normal", T.once(T.residual(F.col("normal"))).alias("residual"), T.once(T.is_deflection(F.col("normal"))).alias("deflection"))
    rank = F.row_number().over(Window.partitionBy("deflection").orderBy(lot(seed, F.col("id")), "id"))
    return rows.withColumn("r", rank).where(F.col("r") <= shown).drop("r")


def sample_summary(tweets: DataFrame, selected: DataFrame, merged: DataFrame, turned: DataFrame, nested: DataFrame) -> DataFrame:
    """One row about a sample: tweets in conversations, those of the brand, the ones left after the cap (cleaned), their turns, and conversations.

    conversations, of_brand, kept; tweets, capped_tweets, turns; merged_groups, merged_conversations,
    merged_pct (of those kept), resorted (groups put in the order of their markers); orphan_parts,
    orphan_first (first replies among them); signed (replies), signed_by_several (groups);
    with_reply and without_reply (conversations with a substantive first reply).
    """
    groups = merged.groupBy("conversation_id", "merge_group").agg(F.max("resorted").alias("resorted"), F.count("signature").alias("signed"), F.count_distinct("signature").alias("signatures"))
    parts = [
        tweets.where("conversation_id is not null").agg(F.count_distinct("conversation_id").alias("conversations")),
        selected.agg(F.count_distinct("conversation_id").alias("of_brand"), F.count("*").alias("tweets")),
        groups.agg(F.count_if("resorted").alias("resorted"), F.coalesce(F.sum("signed"), F.lit(0)).alias("signed"), F.count_if(F.col("signatures") > 1).alias("signed_by_several")),
        turned.agg(F.coalesce(F.sum("n_parts"), F.lit(0)).alias("capped_tweets"), F.count("*").alias("turns"), F.count_if(F.col("n_parts") > 1).alias("merged_groups"), F.count_distinct(F.when(F.col("n_parts") > 1, F.col("conversation_id"))).alias("merged_conversations"), F.count_if("orphan_part").alias("orphan_parts")),
        nested.agg(F.count("*").alias("kept"), F.count_if(F.coalesce("first_reply_orphan_part", F.lit(False))).alias("orphan_first"), F.count("first_reply_text").alias("with_reply"), F.count_if(F.col("first_reply_text").isNull()).alias("without_reply")),
    ]
    one = reduce(DataFrame.crossJoin, parts)  # a row each
    return one.withColumn("merged_pct", F.coalesce(F.try_divide(F.col("merged_conversations") * 100, "kept"), F.lit(0.0)))


def taxonomy_summary(pool: DataFrame, sampled: DataFrame, cache: DataFrame, model: str, short: int = 5) -> tuple[DataFrame, DataFrame]:
    """((pool, sampled, texts, cached), (part, source, n, non_english, non_english_pct, short, short_pct)) of conversations (source, opening_text).

    The second has a row for all of the pool, all of the sample, and each source of the sample (part
    pool, sample, source). texts: distinct openings to embed, of which so many are cached.
    """
    texts = sampled.where("opening_text is not null").select(T.cache_key(F.lit(model), F.col("opening_text")).alias("key")).distinct()
    held = texts.join(cache.select("key", F.lit(1).alias("hit")).distinct(), "key", "left").agg(F.count("*").alias("texts"), F.count("hit").alias("cached"))
    one = pool.agg(F.count("*").alias("pool")).crossJoin(sampled.agg(F.count("*").alias("sampled"))).crossJoin(held)
    marked = lambda df: df.select("source", T.once(T.is_non_english(T.normalize(F.col("opening_text")))).alias("f"), (T.word_count(F.col("opening_text")) < short).alias("s"))
    counts = [F.count("*").alias("n"), F.count_if("f").alias("non_english"), (F.avg(F.col("f").cast("double")) * 100).alias("non_english_pct"), F.count_if("s").alias("short"), (F.avg(F.col("s").cast("double")) * 100).alias("short_pct")]
    none = F.lit(None).cast("string").alias("source")
    every = marked(pool).agg(*counts).select(F.lit("pool").alias("part"), none, "*")
    own = marked(sampled)
    return one, every.unionByName(own.agg(*counts).select(F.lit("sample").alias("part"), none, "*")).unionByName(own.groupBy("source").agg(*counts).select(F.lit("source").alias("part"), "*"))


def thread_summary(forest: DataFrame) -> DataFrame:
    """One row: tweets, threads, roots of each kind, branching tweets, the greatest depth and the most branches of a thread."""
    root = F.col("depth") == 0
    kinds = [F.count_if(root & (F.col("root_kind") == k)).alias(f"{k}s") for k in ("customer_root", "brand_root", "orphan")]
    one = forest.agg(F.count("*").alias("tweets"), F.count_distinct("thread_id").alias("threads"), *kinds, F.count_if(F.col("root_kind") == "cycle").alias("cycle_tweets"), F.count_if(F.col("n_children") > 1).alias("branching"), F.max("depth").alias("max_depth"))
    most = forest.groupBy("thread_id").agg(F.max("branch_id").alias("b")).agg((F.max("b") + 1).alias("max_branches"))
    return one.crossJoin(most)


def conversation_counts(assigned: DataFrame) -> DataFrame:
    """(source, conversations, tweets), tweets in no conversation under a null source."""
    return assigned.groupBy(F.col("conversation_source").alias("source")).agg(F.count_distinct("conversation_id").alias("conversations"), F.count("*").alias("tweets"))
