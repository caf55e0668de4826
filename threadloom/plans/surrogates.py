"""Tables in the shapes that the operators take, derived from the driver's tables by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """df dealt to all cores where it is small: a file of one row group would be one task's, however long its texts take."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * task_bytes else df


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply forest of the conversations: branching, orphans and cycles among it."""
    c = table(spark, sf_dir, "conversations").where("not (conv_id % 7 = 3 and turn = 0)")
    minute = F.when(F.col("conv_id") % 2 == 1, 100 - F.col("turn")).otherwise(F.col("turn"))
    parent = F.when((F.col("turn") == 0) & (F.col("conv_id") % 11 == 5), F.col("conv_id") * 1000 + 1).when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.floor((F.col("turn") - 1) / 2))
    kids = F.concat(F.col("conv_id") * 1000 + 2 * F.col("turn") + 1, F.lit(","), F.col("conv_id") * 1000 + 2 * F.col("turn") + 2)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), parent.alias("parent"), (F.col("role") == "user").alias("inbound"), F.timestamp_seconds(1509400800 + minute * 60).alias("ts"), kids.alias("responses"))


TWEETS_SQL = """
t AS (SELECT conv_id * 1000 + turn AS id,
   CASE WHEN turn = 0 AND conv_id % 11 = 5 THEN conv_id * 1000 + 1 WHEN turn > 0 THEN conv_id * 1000 + (turn - 1) // 2 END AS parent0,
   role = 'user' AS inbound, 1509400800 + 60 * CASE WHEN conv_id % 2 = 1 THEN 100 - turn ELSE turn END AS ts,
   [conv_id * 1000 + 2 * turn + 1, conv_id * 1000 + 2 * turn + 2] AS responses
  FROM conversations WHERE NOT (conv_id % 7 = 3 AND turn = 0)),
b AS (SELECT t.id, p.id AS parent, t.inbound, t.ts, t.parent0 IS NOT NULL AND p.id IS NULL AS dangling FROM t LEFT JOIN t p ON t.parent0 = p.id),
f AS (SELECT id, id AS thread_id, 0 AS depth, [id] AS path, [inbound] AS ins, inbound AS root_in, dangling FROM b WHERE parent IS NULL
  UNION ALL SELECT b.id, f.thread_id, f.depth + 1, list_append(f.path, b.id), list_append(f.ins, b.inbound), f.root_in, f.dangling FROM b JOIN f ON b.parent = f.id)
"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of customer and brand tweets, with marked parts, mentions and signatures."""
    c = table(spark, sf_dir, "conversations")
    swapped = F.when((F.col("conv_id") % 2 == 1) & F.col("turn").isin(1, 2), 3 - F.col("turn")).otherwise(F.col("turn"))
    text = F.concat(F.lit("@u"), F.col("conv_id"), F.lit(" "), F.col("turn"), F.lit(": "), F.col("text"), F.lit(" /AB"))
    return c.select(
        F.col("conv_id").alias("conversation_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 3 == 0).alias("inbound"), F.when(F.col("turn") % 3 == 0, "cust").otherwise("brand").alias("author_id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.floor((F.col("turn") - 1) / 2)).alias("parent"), F.timestamp_seconds(1509400800 + swapped * 60).alias("ts"), F.regexp_replace(text, r"\s+", " ").alias("text"),
    )


POSTS_SQL = r"""
p AS (SELECT conv_id AS conversation_id, conv_id * 1000 + turn AS id, turn % 3 = 0 AS inbound, CASE WHEN turn % 3 = 0 THEN 'cust' ELSE 'brand' END AS author_id,
   CASE WHEN turn > 0 THEN conv_id * 1000 + (turn - 1) // 2 END AS parent, CASE WHEN conv_id % 2 = 1 AND turn IN (1, 2) THEN 3 - turn ELSE turn END AS ts,
   CASE WHEN turn BETWEEN 0 AND 9 THEN turn END AS part_number, turn, '@u' || conv_id AS who, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body
  FROM conversations),
l AS (SELECT *, lag(author_id) OVER w AS a0, lag(inbound) OVER w AS i0, lag(parent) OVER w AS p0, lag(id) OVER w AS id0 FROM p WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, id)),
g AS (SELECT *, sum(CASE WHEN coalesce(a0 = author_id AND NOT i0 AND NOT inbound AND (p0 = parent OR parent = id0), false) THEN 0 ELSE 1 END) OVER (PARTITION BY conversation_id ORDER BY ts, id) AS merge_group FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, merge_group ORDER BY ts, id) AS place FROM g),
k AS (SELECT *, coalesce(lag(part_number) OVER (PARTITION BY conversation_id, merge_group ORDER BY place) > part_number, false) AS falls FROM h),
m AS (SELECT *, max(falls) OVER (PARTITION BY conversation_id, merge_group) AS resorted FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, merge_group ORDER BY CASE WHEN resorted THEN coalesce(part_number, 0) ELSE place END, place) - 1 AS position FROM m)
"""

#: Replies that exercise the text features, our own wording.
REPLIES = (
    "@42 Hi there! Please DM us your account details so we can help /AB",
    "Hey! Sorry to hear that. Which device and app version do you use? Please send us a DM",
    "Thanks for the heads up, restart the app and clean the cache at https://x.example/help",
    "feel free to reach out to us again if anything else comes up",
    "Give us a call or email us anytime",
    "We've just sent you a reply in a direct message",
    "I want a refund and will cancel my subscription, call 917-555-3894 now",
    "my lawyer says this is fraud, write to jo.doe@example.com",
    "you suck, idiots",
    "card 4111 1111 1111 1111 was charged twice",
    "wo ist das? bitte und danke, wir sind nicht da",
    "2/3 then sign out of all devices",
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each document's id with one of the replies, and the documents' own texts."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = F.array(*[F.lit(r) for r in REPLIES])
    return d.select("doc_id", F.element_at(known, (F.col("doc_id") % len(REPLIES) + 1).cast("int")).alias("text")).unionByName(d.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


REPLIES_SQL = f"r AS (SELECT doc_id, ([{', '.join(map(_quoted, REPLIES))}])[(doc_id % {len(REPLIES)})::INT + 1] AS text FROM documents UNION ALL SELECT doc_id + 1000000000, text FROM documents)"

#: The turns of POSTS_SQL with their texts: signatures of outbound tweets go, and of merged ones the markers and later mentions.
TURNS_SQL = POSTS_SQL.rstrip() + r""",
e AS (SELECT *, count(*) OVER (PARTITION BY conversation_id, merge_group) AS parts, rtrim(who || ' ' || turn || ': ' || body) AS signed FROM o),
x AS (SELECT *, CASE WHEN inbound THEN signed || ' /AB' WHEN position > 0 AND turn < 10 THEN CASE WHEN body = '' THEN signed ELSE body END WHEN position > 0 THEN rtrim(turn || ': ' || body) WHEN parts > 1 AND turn < 10 THEN rtrim(who || ' ' || body) ELSE signed END AS said FROM e),
q AS (SELECT conversation_id, merge_group, list(id ORDER BY position) AS tweet_ids, arg_min(CASE WHEN inbound THEN 'customer' ELSE 'brand' END, position) AS role, count(*) AS n_parts, count(part_number) AS n_marked,
   max(CASE WHEN inbound THEN NULL WHEN body IS NOT NULL THEN 'AB' END) AS agent_signature, coalesce(string_agg(said, ' ' ORDER BY position), '') AS text FROM x GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY merge_group) - 1 AS turn_index FROM q)
"""
