"""Turns: parts of one reply merged, marked order restored, texts cleaned and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import text as T

MAX_TWEETS = 20


def select_brand(tweets: DataFrame, brand: str) -> DataFrame:
    """All tweets of the conversations in which brand wrote an outbound tweet."""
    own = tweets.where((F.col("author_id") == brand) & ~F.col("inbound")).select("conversation_id").distinct()
    return tweets.join(own, "conversation_id", "left_semi")


def cap(tweets: DataFrame, most: int = MAX_TWEETS) -> DataFrame:
    sizes = tweets.groupBy("conversation_id").agg(F.count("*").alias("size")).where(F.col("size") <= most)
    return tweets.join(sizes.select("conversation_id"), "conversation_id", "left_semi")


def merge_groups(tweets: DataFrame) -> DataFrame:
    """tweets (conversation_id, id, author_id, inbound, parent, ts, text) with merge_group, part_number and position.

    A tweet continues the one before it when one author wrote both, both are outbound, and they
    answer the same tweet or it answers the one before. Where marked parts of a group fall out of
    order, the group is ordered by its markers, unmarked parts first.
    """
    w = Window.partitionBy("conversation_id").orderBy("ts", "id")
    before = lambda c: F.lag(c).over(w)
    same = (before("author_id") == F.col("author_id")) & ~before("inbound") & ~F.col("inbound") & ((before("parent") == F.col("parent")) | (F.col("parent") == before("id")))
    out = tweets.withColumns({"_new": (~F.coalesce(same, F.lit(False))).cast("int"), "part_number": T.part_number(F.col("text"))})
    out = out.withColumn("merge_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy("conversation_id", "merge_group")
    out = out.withColumn("_place", F.row_number().over(g.orderBy("ts", "id")))
    out = out.withColumn("_falls", F.coalesce(F.lag("part_number").over(g.orderBy("_place")) > F.col("part_number"), F.lit(False)))
    out = out.withColumn("resorted", F.max("_falls").over(g))
    out = out.withColumn("_key", F.when(F.col("resorted"), F.coalesce("part_number", F.lit(0))).otherwise(F.col("_place")))
    return out.withColumn("position", F.row_number().over(g.orderBy("_key", "_place")) - 1).drop("_new", "_place", "_falls", "_key")


def clean(grouped: DataFrame) -> DataFrame:
    """Texts without signatures, and without the markers that merging makes stale; signed: the last signature of the group up to each tweet."""
    size = F.count("*").over(Window.partitionBy("conversation_id", "merge_group"))
    out = grouped.withColumns({"signature": F.when(~F.col("inbound"), T.signature(F.col("text"))), "text": F.when(~F.col("inbound"), T.without_signature(F.col("text"))).otherwise(F.col("text")), "n_parts": size})
    upto = Window.partitionBy("conversation_id", "merge_group").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("signed", F.last("signature", ignorenulls=True).over(upto))
    return out.withColumn("text", F.when(F.col("position") > 0, T.without_prefix(F.col("text"))).when(F.col("n_parts") > 1, T.without_first_marker(F.col("text"))).otherwise(F.col("text")))


def turns(cleaned: DataFrame) -> DataFrame:
    """One row for each merged group, in turn order within its conversation: who wrote it and in which role from its first tweet that has it, when from its earliest."""
    rows = F.array_sort(F.collect_list(F.struct("position", "id", "text", "author_id", "ts", "signed", "inbound", "part_number")))
    by = cleaned.groupBy("conversation_id", "merge_group").agg(rows.alias("r"))
    first = lambda c: F.get(F.filter(F.transform("r", lambda x: x[c]), lambda v: v.isNotNull()), F.lit(0))
    marked = F.size(F.filter("r", lambda x: x["part_number"].isNotNull()))
    out = by.select(
        "conversation_id", "merge_group", F.transform("r", lambda x: x["id"]).alias("tweet_ids"), F.when(first("inbound"), "customer").otherwise("brand").alias("role"), first("author_id").alias("author_id"), F.array_min(F.transform("r", lambda x: x["ts"])).alias("created_at"),
        F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"), F.element_at("r", -1)["signed"].alias("agent_signature"), F.size("r").alias("n_parts"), marked.alias("n_marked"),
        ((F.size("r") == 1) & (marked == 1)).alias("orphan_part"),
    )
    return out.withColumn("turn_index", F.row_number().over(Window.partitionBy("conversation_id").orderBy("merge_group")) - 1)


def first_reply(turned: DataFrame, compat: bool = False) -> DataFrame:
    """The first brand turn of each conversation that is more than a deflection.

    compat: where that is unsigned, the signature of the next such turn that is signed.
    """
    own = turned.where(F.col("role") == "brand").where(~T.is_deflection(T.normalize(F.col("text"))))
    rank = F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn_index"))
    if compat:
        onward = Window.partitionBy("conversation_id").orderBy("turn_index").rowsBetween(0, Window.unboundedFollowing)
        own = own.withColumn("agent_signature", F.first("agent_signature", ignorenulls=True).over(onward))
    return own.withColumn("r", rank).where("r = 1").drop("r")


def nested(turned: DataFrame) -> DataFrame:
    """One row for each conversation: its opening, its turns as an array of structs, and its first substantive reply."""
    rows = turned.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "role", "tweet_ids", "text"))).alias("turns"), F.sum("n_parts").alias("n_tweets"), F.count("*").alias("n_turns"))
    opening = turned.where((F.col("turn_index") == 0) & (F.col("role") == "customer")).select("conversation_id", F.col("tweet_ids")[0].alias("opening_tweet_id"), F.col("text").alias("opening_text"))
    reply = first_reply(turned).select("conversation_id", F.col("tweet_ids").alias("first_reply_tweet_ids"), F.col("text").alias("first_reply_text"), F.col("agent_signature").alias("first_reply_signature"), F.col("turn_index").alias("first_reply_turn_index"), F.col("orphan_part").alias("first_reply_orphan_part"))
    return rows.join(opening, "conversation_id", "left").join(reply, "conversation_id", "left")
