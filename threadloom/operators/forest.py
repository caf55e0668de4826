"""Reply forests by pointer doubling, and the conversations that they split into."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.sources.checks import expect_unique


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset and Spark runs locally, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written once to the folder that spark.checkpoint.dir names, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.made = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what cut wrote for these frames, once nothing reads them any more."""
    for frame in frames:
        spark = frame.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(frame.made)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def running(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows before each in its group by order (a unique one).

    Groups are cut into ranges of the order, summed apart and shifted by what lies before them, so a
    group of any size is many tasks'.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.withColumn("_before", F.sum("_s").over(before)).where("_before <> 0").drop("_s")
    own = F.sum(value).over(Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("_own", own).join(shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    return out.withColumn(name, F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_own", "_g", "_r", "_range", "_before")


def climb(state: DataFrame, merge: dict[str, Column], below: str | None = None) -> DataFrame:
    """state (id, up, ...) once every row's up is null, or what is left runs in cycles; pointer doubling.

    A row stands for the way from id to below up. In each round it is joined with the row that stands
    for the way from up on; merge gives its further columns from its own and the other's (with a_
    before their names). below names a column that in each round gains the sums of the rows whose up
    it is, which come partly added up from every task: in the end it sums over all that lies below.
    A row's size stays the same, and a chain of n takes log n rounds, written to the shared folder.
    """
    state, was = cut(state), None
    while True:
        open_ = state.where("up is not null")
        left = open_.count()
        if not left or left == was:  # depths have no gaps: a round that ends no way has cycles before it
            return state
        above = state.select([F.col(c).alias(f"a_{c}") for c in state.columns])
        moved = open_.join(above, F.col("up") == F.col("a_id")).select("id", F.col("a_up").alias("up"), *[c.alias(n) for n, c in merge.items()])
        both = moved.unionByName(state.where("up is null"))
        if below:
            gained = open_.groupBy(F.col("up").alias("_to")).agg(F.sum(below).alias("_gain"))
            both = both.join(gained, F.col("id") == F.col("_to"), "left").withColumn(below, F.col(below) + F.coalesce("_gain", F.lit(0))).drop("_to", "_gain")
        new = cut(both.select(state.columns))
        release(state)
        state, was = new, left


def parents(tweets: DataFrame) -> DataFrame:
    """tweets (id, parent, inbound, ts) with parent null where it names no row, and dangling there."""
    known = tweets.select(F.col("id").alias("known"))
    joined = tweets.join(known, F.col("parent") == F.col("known"), "left")
    return joined.select("id", F.col("known").alias("parent"), "inbound", "ts", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("dangling"))


def _known(tweets: DataFrame) -> DataFrame:
    """parents of tweets, written; an id that is null or stands on several rows raises, as ways would multiply."""
    base = cut(parents(tweets))
    expect_unique(base, "id")
    return base


def _up(base: DataFrame, *more: Column) -> DataFrame:
    """The ways of climb: how far they go, where they end and of what kind that is, and the inbound tweet nearest to the end."""
    kind = F.when(F.col("dangling"), "orphan").when(F.col("inbound"), "customer_root").otherwise("brand_root")
    first = F.when(F.col("inbound"), F.col("id"))
    return base.select("id", F.col("parent").alias("up"), F.col("id").alias("top"), kind.alias("kind"), F.lit(0).alias("far"), first.alias("first_inbound"), F.when(F.col("inbound"), 0).alias("first_far"), *more)


def _merged(**more: Column) -> dict[str, Column]:
    far = F.col("far") + 1
    return {"top": F.col("a_top"), "kind": F.col("a_kind"), "far": far + F.col("a_far"), "first_inbound": F.coalesce("a_first_inbound", "first_inbound"), "first_far": F.coalesce(far + F.col("a_first_far"), "first_far"), **more}


def _placed(ways: DataFrame, base: DataFrame, *more: str) -> DataFrame:
    """(id, thread_id, root_kind, depth, first_inbound, first_inbound_depth, more) of ways that climb has ended, cycles told apart."""
    trees = ways.where("up is null").select("id", F.col("top").alias("thread_id"), F.col("kind").alias("root_kind"), F.col("far").alias("depth"), "first_inbound", (F.col("far") - F.col("first_far")).alias("first_inbound_depth"), *more)
    if not ways.where("up is not null").limit(1).count():
        return trees
    rings = _rings(ways.where("up is not null").select("id"), base)
    return trees.unionByName(rings.select("id", "thread_id", F.lit("cycle").alias("root_kind"), F.lit(-1).alias("depth")), allowMissingColumns=True)


def rooted(tweets: DataFrame) -> DataFrame:
    """(id, thread_id, root_kind, depth, path) of tweets; path: the ids from the root on, which a chain of n needs n * n / 2 numbers for. See build."""
    base = _known(tweets)
    ways = climb(_up(base, F.array("id").alias("path")), _merged(path=F.concat("a_path", "path")))
    return _placed(ways, base, "path").select("id", "thread_id", "root_kind", "depth", "path")


def build(tweets: DataFrame) -> DataFrame:
    """(id, parent, inbound, ts, dangling, thread_id, root_kind, depth, first_inbound, first_inbound_depth, n_children, is_leaf, branch_id) of each tweet.

    first_inbound: the inbound tweet nearest to the root on the way from it, and its depth. Tweets that
    reach a cycle have the least id on it as thread_id, root_kind cycle, depth -1, branch 0 and no
    first_inbound. branch_id counts the leaves that come before a tweet in preorder, siblings by
    (ts, id): the leaves below earlier siblings of it and of all above it. Leaves below a tweet are
    summed while ways double; sums over siblings are running sums of ranges, sums over ancestors a
    second doubling. No row holds its ancestors and no task a thread or all children of a tweet.
    """
    base = _known(tweets)
    kids = base.where("parent is not null").groupBy(F.col("parent").alias("k_id")).agg(F.count("*").alias("n_children"))
    full = cut(base.join(kids, F.col("id") == F.col("k_id"), "left").drop("k_id").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    leaf = (F.col("n_children") == 0).cast("long").alias("leaves")
    ways = climb(_up(full, leaf), _merged(leaves=F.col("leaves")), "leaves")
    placed = _placed(ways, base, "leaves")
    trees = full.join(placed.where("depth >= 0").select("id", "leaves"), "id").select("id", "parent", "ts", "leaves")
    siblings = running(trees.where("parent is not null"), "parent", ["ts", "id"], "leaves", "before").select("id", F.col("parent").alias("up"), "before")
    tops = trees.where("parent is null").select("id", F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("before"))
    before = climb(siblings.unionByName(tops), {"before": F.col("before") + F.col("a_before")}).select("id", F.col("before").alias("branch_id"))
    out = full.join(placed.drop("leaves"), "id").join(before, "id", "left")
    return out.withColumns({"is_leaf": F.col("n_children") == 0, "branch_id": F.coalesce("branch_id", F.lit(0))})


def _rings(nodes: DataFrame, base: DataFrame) -> DataFrame:
    """(id, thread_id): the least id on the cycle that each node runs into."""
    step = nodes.join(base.select("id", "parent"), "id").select("id", F.col("parent").alias("up"), F.col("id").alias("least"))
    reach, n = 1, nodes.count()
    while reach < n:
        above = step.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("least").alias("a_least"))
        step = cut(step.join(above, F.col("up") == F.col("a")).select("id", F.col("a_up").alias("up"), F.least("least", "a_least").alias("least")))
        reach *= 2
    landed = step.select(F.col("id").alias("a"), F.col("least").alias("thread_id"))
    return step.join(landed, F.col("up") == F.col("a")).select("id", "thread_id")


def edge_check(tweets: DataFrame) -> DataFrame:
    """(claims, absent, contradicting): ids listed in `responses` that name no tweet, or one with another parent."""
    claims = tweets.select(F.col("id").alias("claimer"), F.explode(F.filter(F.transform(F.split("responses", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("c")).select("claimer", F.col("c").cast("long").alias("child"))
    joined = claims.join(tweets.select(F.col("id").alias("t"), F.col("parent").alias("p")), F.col("child") == F.col("t"), "left")
    return joined.agg(F.count("*").alias("claims"), F.count_if(F.col("t").isNull()).alias("absent"), F.count_if(F.col("t").isNotNull() & ~F.col("p").eqNullSafe(F.col("claimer"))).alias("contradicting"))


def paths(tweets: DataFrame, ids: list[int]) -> DataFrame:
    """(id, path): ids from the root, or from where a circle closes, down to each of the ids asked for; an unknown one raises."""
    base = parents(tweets).select("id", "parent")
    asked = base.where(F.col("id").isin(list(ids)))
    if asked.count() != len(set(ids)):
        raise KeyError(f"not all of {sorted(set(ids))[:5]} are tweets")
    open_ = cut(asked.select("id", F.array("id").alias("path"), F.col("parent").alias("up")))
    done = None
    while True:
        ends = F.col("up").isNull() | F.array_contains("path", F.coalesce("up", F.lit(-1)))
        ready = open_.where(ends).select("id", "path")
        done = ready if done is None else done.union(ready)
        if not open_.where(~ends).limit(1).count():
            return done
        above = base.select(F.col("id").alias("a"), F.col("parent").alias("next"))
        open_ = cut(open_.where(~ends).join(above, F.col("up") == F.col("a")).select("id", F.concat(F.array("up"), "path").alias("path"), F.col("next").alias("up")))


def warn_backwards(tweets: DataFrame, most: float = 0.01) -> DataFrame:
    """backwards(), with a warning where more than that part of the edges run back in time."""
    counts = cut(backwards(tweets))
    row = counts.first()
    if row["edges"] and row["backwards"] > most * row["edges"]:
        warnings.warn(f"{row['backwards']} of {row['edges']} replies are older than what they answer", stacklevel=2)
    return counts


def backwards(tweets: DataFrame) -> DataFrame:
    up = tweets.select(F.col("id").alias("p_id"), F.col("ts").alias("p_ts"))
    return tweets.join(up, F.col("parent") == F.col("p_id")).agg(F.count("*").alias("edges"), F.count_if(F.col("ts") < F.col("p_ts")).alias("backwards"))


def assign(forest: DataFrame) -> DataFrame:
    """forest with conversation_id, conversation_source and depth_in_conversation.

    A thread whose root is inbound is one conversation. Under an outbound root a conversation begins
    at the first inbound tweet on the way from the root: directly below it, or deep. Tweets before
    one, and those in cycles, have none.
    """
    at, first = F.col("first_inbound_depth"), F.col("first_inbound")
    root_in = F.coalesce(at == 0, F.lit(False))
    conversation = F.when(F.col("depth") < 0, None).when(root_in, F.col("thread_id")).otherwise(first)
    stem = F.when(F.col("root_kind") == "orphan", "orphan_broadcast").otherwise("brand_broadcast")
    source = F.when(root_in, F.when(F.col("root_kind") == "orphan", "orphan_customer").otherwise("customer_root")).otherwise(F.when(at > 1, F.concat(stem, F.lit("_deep"))).otherwise(stem))
    out = forest.withColumn("conversation_id", conversation)
    has = F.col("conversation_id").isNotNull()
    return out.withColumns({"conversation_source": F.when(has, source), "depth_in_conversation": F.when(has, F.when(root_in, F.col("depth")).otherwise(F.col("depth") - at))})


def summarize(assigned: DataFrame) -> DataFrame:
    own = assigned.where("conversation_id is not null")
    return own.groupBy("conversation_id").agg(
        F.first("conversation_source").alias("source"), F.first("thread_id").alias("thread_id"), F.count("*").alias("n_tweets"), F.sum(F.col("inbound").cast("int")).alias("n_customer_tweets"),
        F.sum((~F.col("inbound")).cast("int")).alias("n_brand_tweets"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max("depth_in_conversation").alias("max_depth"),
    )
