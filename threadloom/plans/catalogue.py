"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import rules as R
from threadloom.functions import text as T
from threadloom.operators import forest, metrics, sampling, turns, vectors
from threadloom.plans import surrogates as S
from threadloom.plans.registry import ORACLE_SQL, QUERIES, query, r6  # noqa: F401
from threadloom.sources import io

# --- vectors -----------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("q_label"))
    return q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("cv"), "label")


_SIM = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS q_label FROM embeddings WHERE vec_id % 10 = 0),
s AS (SELECT query_id, q_label, vec_id AS item_id, label, round(list_dot_product(qv, embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings e ON e.vec_id {op} 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s {where})"""
_ALL = _SIM.format(op=">=", where="")
_OTHER = _SIM.format(op=">=", where="WHERE item_id <> query_id")
_CORPUS = _SIM.format(op="% 10 <>", where="")


def _ranked(spark, sf_dir, k, corpus_only=False, exclude=None):
    q, c = _vectors(spark, sf_dir)
    if corpus_only:
        c = c.where("item_id % 10 <> 0")
    return vectors.top_k(q, c, k, exclude).withColumn("similarity", r6("similarity"))


@query(f"WITH {_ALL} SELECT query_id, item_id, similarity, rank FROM n WHERE rank <= 3")
def knn_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, 3).select("query_id", "item_id", "similarity", "rank")


@query(f"""WITH {_CORPUS}, t AS (SELECT similarity AS x FROM n WHERE rank = 1) SELECT count(*) AS n, round(min(x), 6) AS p0, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50,
round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS p100, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM t""")
def knn_top1_distribution(spark, sf_dir):
    t, x = forest.cut(_ranked(spark, sf_dir, 1, True).select("similarity")), F.col("similarity")
    p = {f"p{q:.0f}": r6(F.lit(v).cast("double")).alias(f"p{q:.0f}") for q, v in zip((10, 50, 90), metrics.quantiles(t, "similarity", [0.1, 0.5, 0.9]), strict=True)}
    return t.agg(F.count("*").alias("n"), r6(F.min(x)).alias("p0"), *p.values(), r6(F.max(x)).alias("p100"), r6(F.avg(x)).alias("mean"), r6(F.stddev_pop(x)).alias("std"))


_EDGES = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]


@query(f"""WITH {_CORPUS}, t AS (SELECT similarity AS x FROM n WHERE rank = 1), e AS (SELECT unnest({_EDGES[:-1]}::DOUBLE[]) AS low, unnest({_EDGES[1:]}::DOUBLE[]) AS high)
SELECT low, high, count(x) AS n, round(count(x)::DOUBLE / (SELECT count(*) FROM t), 6) AS share FROM e LEFT JOIN t ON x >= low AND x < high GROUP BY low, high""")
def similarity_histogram(spark, sf_dir):
    return vectors.histogram(_ranked(spark, sf_dir, 1, True), "similarity", _EDGES).withColumn("share", r6("share"))


@query(f"WITH {_CORPUS}, t AS (SELECT similarity AS x FROM n WHERE rank = 1), e AS (SELECT unnest([0.3, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS floor) SELECT floor, count(*) FILTER (x < floor) AS n FROM e, t GROUP BY floor")
def floor_sweep(spark, sf_dir):
    floors = F.array(*[F.lit(f) for f in (0.3, 0.5, 0.6, 0.7, 0.8)])
    return _ranked(spark, sf_dir, 1, True).select("similarity", F.explode(floors).alias("floor")).groupBy("floor").agg(F.count_if(F.col("similarity") < F.col("floor")).alias("n"))


_VOTE = f"""WITH {_OTHER}, v AS (SELECT query_id, any_value(q_label) AS truth, label, count(*) AS votes, max(similarity) AS best FROM n WHERE rank <= 5 GROUP BY query_id, label),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best DESC, label) AS r FROM v), y AS (SELECT query_id, truth AS y_true, label AS y_pred, votes, best FROM w WHERE r = 1)"""


def _votes(spark, sf_dir):
    near = _ranked(spark, sf_dir, 5, exclude=("query_id", "item_id"))
    truth = near.select("query_id", F.col("q_label").alias("y_true")).distinct()
    return vectors.vote(near).join(truth, "query_id").select("query_id", "y_true", F.col("label").alias("y_pred"), "votes", "best")


@query(f"{_VOTE} SELECT query_id, y_true, y_pred, votes, best FROM y")
def loo_knn_vote(spark, sf_dir):
    return _votes(spark, sf_dir)


@query(f"WITH {_CORPUS}, t AS (SELECT similarity AS x FROM n WHERE rank = 1) SELECT 0 AS shared_ids, count(*) FILTER (x >= 0.95) AS near_duplicates, count(*) AS n FROM t")
def near_duplicate_leakage(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    shared = q.join(c.where("item_id % 10 <> 0"), F.col("query_id") == F.col("item_id"), "left_semi").agg(F.count("*").cast("int").alias("shared_ids"))
    return shared.crossJoin(_ranked(spark, sf_dir, 1, True).agg(F.count_if(F.col("similarity") >= 0.95).alias("near_duplicates"), F.count("*").alias("n")))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY label), m AS (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) SELECT vec_id, m.label AS intent, 'auto' AS decision FROM embeddings e, m WHERE vec_id % 10 = 0")
def majority_baseline(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    major = e.where("vec_id % 10 <> 0").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("intent"))
    return e.where("vec_id % 10 = 0").select("vec_id").crossJoin(F.broadcast(major)).withColumn("decision", F.lit("auto"))


# --- metrics -----------------------------------------------------------------------------------

_MATRIX = f"""{_VOTE}, d AS (SELECT unnest(range(10)) AS pos), m AS (SELECT a.pos AS i, b.pos AS j, (SELECT count(*) FROM y WHERE y_true = a.pos AND y_pred = b.pos) AS n FROM d a, d b),
c AS (SELECT pos, (SELECT sum(n) FROM m WHERE i = pos AND j = pos) AS tp, (SELECT sum(n) FROM m WHERE i = pos) AS t, (SELECT sum(n) FROM m WHERE j = pos) AS p FROM d),
pr AS (SELECT pos, tp, p - tp AS fp, t - tp AS fn, t AS support, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN t = 0 THEN 0 ELSE tp / t END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


def _matrix(spark, sf_dir):
    pairs = _votes(spark, sf_dir).select(F.col("y_true").cast("string").alias("y_true"), F.col("y_pred").cast("string").alias("y_pred"))
    return forest.cut(metrics.confusion(pairs, metrics.labels(spark, map(str, range(10)))))


@query(f"{_MATRIX} SELECT i::VARCHAR AS true_label, j::VARCHAR AS pred_label, n FROM m")
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("true_label", "pred_label", "n")


@query(f"{_MATRIX} SELECT pos::VARCHAR AS label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def per_class_report(spark, sf_dir):
    return metrics.per_class(_matrix(spark, sf_dir)).select("label", "tp", "fp", "fn", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""{_MATRIX} SELECT round(avg(f1), 6) AS macro_f1, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (tp + fp = 0), '') AS undefined_precision,
coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (tp + fn = 0), '') AS undefined_recall FROM f""")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(metrics.per_class(_matrix(spark, sf_dir))).withColumn("macro_f1", r6("macro_f1"))


@query(f"""{_MATRIX}, z AS (SELECT sum(n)::DOUBLE AS n, sum(CASE WHEN i = j THEN n END)::DOUBLE AS h, sum(CASE WHEN i = j THEN (SELECT t FROM c WHERE c.pos = i) * (SELECT p FROM c WHERE c.pos = j) END)::DOUBLE AS e,
 sum((i - j) * (i - j) * n)::DOUBLE AS ow, sum((i - j) * (i - j) * (SELECT t FROM c WHERE c.pos = i) * (SELECT p FROM c WHERE c.pos = j))::DOUBLE AS ew FROM m)
SELECT n::BIGINT AS n, round(h / n, 6) AS accuracy, round((h / n - e / n / n) / (1 - e / n / n), 6) AS kappa, round(1 - ow * n / ew, 6) AS qw_kappa FROM z""")
def accuracy_kappa(spark, sf_dir):
    return metrics.kappa(_matrix(spark, sf_dir)).select("n", *[r6(c).alias(c) for c in ("accuracy", "kappa", "qw_kappa")])


@query(f"""{_VOTE}, p AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS pos, (y_true = y_pred)::INT::DOUBLE AS hit FROM y), k AS (SELECT count(*) AS n FROM p),
d AS (SELECT r, ('0x' || substr(md5('42:' || r || ':' || q), 1, 8))::BIGINT % n AS pos FROM k, range(200) a(r), range((SELECT n FROM k)) b(q)), sc AS (SELECT r, avg(hit) AS x FROM d JOIN p USING (pos) GROUP BY r)
SELECT (SELECT n FROM k) AS n, round((SELECT avg(hit) FROM p), 6) AS accuracy, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM sc""")
def bootstrap_ci(spark, sf_dir):
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    pairs = _votes(spark, sf_dir).select((F.row_number().over(Window.orderBy("query_id")) - 1).cast("long").alias("pos"), hit.alias("hit"))
    return metrics.bootstrap(forest.cut(pairs), resamples=200).select("n", *[r6(c).alias(c) for c in ("accuracy", "low", "high")])


# --- forest and conversations ------------------------------------------------------------------

_F = f"WITH RECURSIVE {S.TWEETS_SQL}"
_KIND = "CASE WHEN f.id IS NULL THEN 'cycle' WHEN f.dangling THEN 'orphan' WHEN f.root_in THEN 'customer_root' ELSE 'brand_root' END"
_CONV = f"""{_F}, a AS (SELECT b.id, b.inbound, b.ts, f.thread_id, f.depth, {_KIND} AS kind, f.root_in, list_position(f.ins, true) - 1 AS first_in, f.path FROM b JOIN f ON b.id = f.id),
v AS (SELECT *, CASE WHEN root_in THEN thread_id ELSE path[first_in + 1] END AS conversation_id,
 CASE WHEN root_in THEN CASE WHEN kind = 'orphan' THEN 'orphan_customer' ELSE 'customer_root' END WHEN first_in IS NOT NULL THEN CASE WHEN kind = 'orphan' THEN 'orphan_broadcast' ELSE 'brand_broadcast' END || CASE WHEN first_in > 1 THEN '_deep' ELSE '' END END AS source,
 CASE WHEN root_in THEN depth WHEN first_in IS NOT NULL THEN depth - first_in END AS dc FROM a)"""


@query(f"{_F} SELECT b.id, f.thread_id, coalesce(f.depth, -1) AS depth, {_KIND} AS root_kind, array_to_string(f.path, ',') AS path FROM b LEFT JOIN f ON b.id = f.id WHERE f.id IS NOT NULL")
def forest_depth_root(spark, sf_dir):
    out = forest.rooted(S.tweets(spark, sf_dir)).where("depth >= 0")
    return out.select("id", "thread_id", "depth", "root_kind", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(f"""{_F}, c AS (SELECT b.id FROM b LEFT JOIN f ON b.id = f.id WHERE f.id IS NULL), w AS (SELECT id, id AS at, [id] AS seen FROM c UNION ALL SELECT w.id, b.parent, list_append(seen, b.parent) FROM w JOIN b ON b.id = w.at WHERE NOT list_contains(seen, b.parent)),
e AS (SELECT w.id, list_last(seen) AS last, seen FROM w QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY len(seen) DESC) = 1)
SELECT e.id, list_min(list_slice(seen, list_position(seen, b.parent), len(seen))) AS thread_id, -1 AS depth, 0 AS branch_id, 'cycle' AS root_kind FROM e JOIN b ON b.id = e.last""")
def cycle_quarantine(spark, sf_dir):
    out = forest.build(S.tweets(spark, sf_dir)).where("depth < 0")
    return out.select("id", "thread_id", "depth", F.col("branch_id").cast("int").alias("branch_id"), "root_kind")


@query(f"{_F} SELECT {_KIND} AS root_kind, coalesce(f.depth, -1) AS depth, count(*) AS n FROM b LEFT JOIN f ON b.id = f.id GROUP BY ALL")
def root_kind_counts(spark, sf_dir):
    return forest.build(S.tweets(spark, sf_dir)).groupBy("root_kind", "depth").agg(F.count("*").alias("n"))


@query(f"{_F}, k AS (SELECT parent, count(*) AS n FROM b GROUP BY parent) SELECT b.id, coalesce(k.n, 0) AS n_children, k.n IS NULL AS is_leaf FROM b LEFT JOIN k ON k.parent = b.id")
def children_leaf(spark, sf_dir):
    return forest.build(S.tweets(spark, sf_dir)).select("id", "n_children", "is_leaf")


@query(f"""{_F}, z AS (SELECT b.id, b.parent, f.thread_id FROM b JOIN f ON b.id = f.id), o AS (SELECT f.id, f.thread_id, list(u.ts ORDER BY list_position(f.path, u.id)) AS tss, f.path FROM f JOIN b u ON list_contains(f.path, u.id) GROUP BY f.id, f.thread_id, f.path),
s AS (SELECT o.id, o.thread_id, list_zip(tss, path) AS key, NOT EXISTS (SELECT 1 FROM b WHERE b.parent = o.id) AS leaf FROM o)
SELECT id, (coalesce(sum(leaf::INT) OVER (PARTITION BY thread_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS branch_id FROM s""")
def branch_id(spark, sf_dir):
    return forest.build(S.tweets(spark, sf_dir)).where("depth >= 0").select("id", F.col("branch_id").cast("long").alias("branch_id"))


@query(f"{_F}, c AS (SELECT id AS claimer, unnest(responses) AS child FROM t) SELECT count(*) AS claims, count(*) FILTER (t.id IS NULL) AS absent, count(*) FILTER (t.id IS NOT NULL AND t.parent0 IS DISTINCT FROM claimer) AS contradicting FROM c LEFT JOIN t ON c.child = t.id")
def edge_crosscheck(spark, sf_dir):
    return forest.edge_check(S.tweets(spark, sf_dir))


@query(f"{_F} SELECT count(*) AS edges, count(*) FILTER (b.ts < p.ts) AS backwards FROM b JOIN b p ON b.parent = p.id")
def backwards_edges(spark, sf_dir):
    return forest.backwards(S.tweets(spark, sf_dir))


@query(f"{_CONV} SELECT id, conversation_id, source AS conversation_source, dc AS depth_in_conversation FROM v")
def conversation_assign(spark, sf_dir):
    out = forest.assign(forest.build(S.tweets(spark, sf_dir)).where("depth >= 0"))
    return out.select("id", "conversation_id", "conversation_source", F.col("depth_in_conversation").cast("long").alias("depth_in_conversation"))


@query(f"""{_CONV} SELECT conversation_id, any_value(source) AS source, any_value(thread_id) AS thread_id, count(*) AS n_tweets, sum(inbound::INT)::BIGINT AS n_customer_tweets, sum((NOT inbound)::INT)::BIGINT AS n_brand_tweets,
min(ts) AS started_at, max(ts) AS ended_at, max(dc)::BIGINT AS max_depth FROM v WHERE conversation_id IS NOT NULL GROUP BY conversation_id""")
def conversation_summary(spark, sf_dir):
    out = forest.summarize(forest.assign(forest.build(S.tweets(spark, sf_dir))))
    return out.withColumns({"started_at": F.unix_timestamp("started_at"), "ended_at": F.unix_timestamp("ended_at"), "max_depth": F.col("max_depth").cast("long")})


@query(f"{_CONV}, n AS (SELECT count(*) AS c FROM v WHERE conversation_id IS NOT NULL GROUP BY conversation_id) SELECT " + ", ".join(f"round(quantile_cont(c, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 99)) + " FROM n")
def conversation_size_dist(spark, sf_dir):
    n = forest.cut(forest.summarize(forest.assign(forest.build(S.tweets(spark, sf_dir)))).select("n_tweets"))
    at = (25, 50, 75, 90, 99)
    return n.agg(F.count("*")).select(*[r6(F.lit(v).cast("double")).alias(f"p{p}") for p, v in zip(at, metrics.quantiles(n, "n_tweets", [p / 100 for p in at]), strict=True)])


# --- turns -------------------------------------------------------------------------------------

_P = f"WITH {S.POSTS_SQL}"


@query(f"{_P}, s AS (SELECT conversation_id FROM p GROUP BY 1 HAVING count(*) <= 6) SELECT conversation_id, id FROM p SEMI JOIN (SELECT conversation_id FROM p WHERE author_id = 'brand' AND NOT inbound) USING (conversation_id) SEMI JOIN s USING (conversation_id)")
def brand_select_cap(spark, sf_dir):
    return turns.cap(turns.select_brand(S.posts(spark, sf_dir), "brand"), 6).select("conversation_id", "id")


@query(f"{_P} SELECT conversation_id, id, merge_group::BIGINT AS merge_group, part_number, position, resorted FROM o")
def merge_groups(spark, sf_dir):
    return turns.merge_groups(S.posts(spark, sf_dir)).select("conversation_id", "id", "merge_group", F.col("part_number").cast("long").alias("part_number"), F.col("position").cast("long").alias("position"), "resorted")


def _turns(spark, sf_dir):
    return turns.turns(turns.clean(turns.merge_groups(S.posts(spark, sf_dir))))


@query(f"""WITH {S.TURNS_SQL} SELECT conversation_id, array_to_string(tweet_ids, ',') AS tweet_ids, text, role, n_parts, n_marked, agent_signature, n_parts = 1 AND n_marked = 1 AS orphan_part, turn_index FROM v""")
def merged_turns(spark, sf_dir):
    out = _turns(spark, sf_dir)
    return out.select("conversation_id", F.array_join(F.transform("tweet_ids", lambda x: x.cast("string")), ",").alias("tweet_ids"), "text", "role", F.col("n_parts").cast("long").alias("n_parts"), F.col("n_marked").cast("long").alias("n_marked"), "agent_signature", "orphan_part", F.col("turn_index").cast("long").alias("turn_index"))


# --- text and rules ----------------------------------------------------------------------------

_SP = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_NORM = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '^(?:\s*@[\p{{L}}\p{{M}}\p{{N}}_]+)+\s*', ''), 'https?://\S+', '<url>', 'g'), '\s+', ' ', 'g')))"
_q = S._quoted
_BARE = _NORM
for _p in (*T.BOILERPLATE, T.any_of(T.REDIRECTS.values()), r"[^a-z0-9' ]+"):
    _BARE = f"regexp_replace({_BARE}, {_q(_p)}, ' ', 'g')"
_TEXT = f"WITH {S.REPLIES_SQL}, n AS (SELECT doc_id, text, {_NORM} AS t FROM r)"
_HAS = f"(regexp_matches(t, {_q(T.any_of(T.REDIRECTS.values()))}) AND NOT (regexp_matches(t, {_q(T.SIGN_OFF)}) AND NOT regexp_matches(t, {_q(T.any_of(p for k, p in T.REDIRECTS.items() if k != 'contact_us'))})))"
_LEFT = "list_filter(string_split_regex(" + _BARE.replace(_NORM, "t") + rf", '\s+'), lambda w: w <> '' AND NOT list_contains({list(T.FILLER)}, w))"


@query(f"""WITH {S.TURNS_SQL}, n AS (SELECT *, {_NORM} AS t FROM v), d AS (SELECT conversation_id, turn_index, tweet_ids, text, agent_signature, n_parts = 1 AND n_marked = 1 AS orphan_part, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index) AS r FROM n WHERE role = 'brand' AND NOT ({_HAS} AND len({_LEFT}) <= 3)),
z AS (SELECT conversation_id, to_json(list(struct_pack(turn_index := turn_index, role := role, tweet_ids := tweet_ids, text := text) ORDER BY turn_index))::VARCHAR AS turns, sum(n_parts)::BIGINT AS n_tweets, count(*) AS n_turns FROM v GROUP BY conversation_id)
SELECT z.*, w.tweet_ids[1] AS opening_tweet_id, w.text AS opening_text, array_to_string(d.tweet_ids, ',') AS first_reply_tweet_ids, d.text AS first_reply_text, d.agent_signature AS first_reply_signature, d.turn_index AS first_reply_turn_index, d.orphan_part AS first_reply_orphan_part
FROM z LEFT JOIN v w ON w.conversation_id = z.conversation_id AND w.turn_index = 0 AND w.role = 'customer' LEFT JOIN d ON d.conversation_id = z.conversation_id AND d.r = 1""")
def nested_conversations(spark, sf_dir):
    out = turns.nested(_turns(spark, sf_dir))
    ids = F.array_join(F.transform("first_reply_tweet_ids", lambda x: x.cast("string")), ",")
    return out.withColumns({"turns": F.to_json("turns"), "first_reply_tweet_ids": ids, "first_reply_turn_index": F.col("first_reply_turn_index").cast("long")})


@query(f"{_TEXT} SELECT doc_id, {_HAS} AS redirect, len({_LEFT}) AS residual_words, {_HAS} AND len({_LEFT}) <= 3 AS deflection FROM n")
def deflection_flags(spark, sf_dir):
    t = S.replies(spark, sf_dir).select("doc_id", T.once(T.normalize(F.col("text"))).alias("t"))
    t = t.select("doc_id", T.has_redirect(F.col("t")).alias("redirect"), T.once(F.size(T.residual_words(F.col("t"))).cast("long")).alias("residual_words"))
    return t.withColumn("deflection", F.col("redirect") & (F.col("residual_words") <= T.MAX_RESIDUAL_WORDS))


@query(f"{_TEXT}, x AS (SELECT {_HAS} AS h, len({_LEFT}) AS w FROM n) SELECT count(*) AS n, round(avg(h::INT::DOUBLE) * 100, 6) AS redirect_pct, round(avg((h AND w <= 3)::INT::DOUBLE) * 100, 6) AS deflection_pct, round(median(w), 6) AS median_residual FROM x")
def deflection_rate(spark, sf_dir):
    x = S.replies(spark, sf_dir).select(T.once(T.normalize(F.col("text"))).alias("t")).select(T.has_redirect(F.col("t")).alias("h"), F.size(T.residual_words(F.col("t"))).alias("w"))
    return x.agg(F.count("*").alias("n"), r6(F.avg(F.col("h").cast("double")) * 100).alias("redirect_pct"), r6(F.avg((F.col("h") & (F.col("w") <= 3)).cast("double")) * 100).alias("deflection_pct"), r6(F.percentile("w", F.lit(0.5))).alias("median_residual"))


_PAD = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9@+]+', ' ', 'g')) || ' '"
_LEX = lambda phrases: "(" + " OR ".join(f"contains({_PAD}, {_q(f' {p} ')})" for p in phrases) + ")"
# Look-arounds are spelled as consumed context.
_CARD = r"(?:^|[^\d.-])(?:\d[ -]?){13,16}(?:$|[^\d.-])"
_PHONE = r"(?:^|[^\d.-])(\+?\d[\d ()\-]{7,}\d)(?:$|[^\d.-])"
_PII = rf"(contains(lower(text), '__email__') OR regexp_matches(lower(text), '{R.EMAIL}') OR regexp_matches(text, '{_CARD}') OR len(list_filter(regexp_extract_all(text, '{_PHONE}', 1), lambda m: length(regexp_replace(m, '\D', '', 'g')) >= 10)) > 0)"


@query(f"WITH {S.REPLIES_SQL} SELECT doc_id, {_PII} AS pii FROM r")
def pii_flags(spark, sf_dir):
    return S.replies(spark, sf_dir).select("doc_id", R.has_pii(F.col("text")).alias("pii"))


@query(f"WITH {S.REPLIES_SQL} SELECT doc_id, {_LEX(R.ABUSE)} AS abuse, {_LEX(R.CANCELLATION)} AS cancellation, {_LEX(R.LEGAL)} AS legal FROM r")
def lexicon_flags(spark, sf_dir):
    return S.replies(spark, sf_dir).select("doc_id", T.once(R.phrase_flags(F.col("text"))).alias("f")).select("doc_id", "f.*")


_INTENT = f"({list(T.INTENTS)})[(doc_id % 9)::INT + 1]"
_FIRED = f"""WITH {S.REPLIES_SQL}, s AS (SELECT doc_id, list_filter([CASE WHEN {_INTENT} IN ('billing_dispute', 'account_access') THEN 'intent_needs_account_data' END, CASE WHEN (doc_id % 10) / 10.0 < 0.6 THEN 'no_similar_precedent' END, CASE WHEN {_LEX(R.ABUSE)} THEN 'abuse_or_profanity' END,
CASE WHEN {_LEX(R.CANCELLATION)} THEN 'cancellation_or_refund' END, CASE WHEN {_LEX(R.LEGAL)} THEN 'legal_or_safety' END, CASE WHEN {_PII} THEN 'pii_present' END], lambda x: x IS NOT NULL) AS fired FROM r)"""


def _fired(spark, sf_dir):
    intent = F.element_at(F.array(*[F.lit(i) for i in T.INTENTS]), (F.col("doc_id") % 9 + 1).cast("int"))
    return S.replies(spark, sf_dir).select("doc_id", T.once(R.signals(F.col("text"), intent, (F.col("doc_id") % 10) / 10)).alias("fired"))


@query(f"{_FIRED} SELECT doc_id, CASE WHEN len(fired) > 0 THEN 'escalate' ELSE 'auto' END AS decision, array_to_string(fired, ',') AS signals, CASE fired[1] " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.REASONS.items()) + " END AS reason FROM s")
def escalate_decision(spark, sf_dir):
    return _fired(spark, sf_dir).select("doc_id", F.when(F.size("fired") > 0, "escalate").otherwise("auto").alias("decision"), F.array_join("fired", ",").alias("signals"), R.reason(F.col("fired")).alias("reason"))


@query(f"{_FIRED} SELECT doc_id, " + ", ".join(f"array_to_string(list_filter(fired, lambda x: list_contains({list(v)}, x)), ',') AS {k}_signals" for k, v in R.FAMILIES.items()) + " FROM s")
def signals_by_family(spark, sf_dir):
    m = _fired(spark, sf_dir).select("doc_id", T.once(R.by_family(F.col("fired"))).alias("m"))
    return m.select("doc_id", *[F.array_join(F.element_at("m", F.lit(k)), ",").alias(f"{k}_signals") for k in R.FAMILIES])


_HITS = lambda known: rf"len(list_intersect(list_distinct(string_split_regex(t, '\s+')), {list(known)})) >= 2"
_FOREIGN = f"CASE WHEN length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 10 AND length(regexp_replace(t, '[^\\p{{Latin}}]', '', 'g')) / length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) < 0.8 THEN true WHEN {_HITS(T.ENGLISH_WORDS)} THEN false ELSE " + " OR ".join(_HITS(w) for w in T.FUNCTION_WORDS.values()) + " END"


@query(f"{_TEXT} SELECT doc_id, {_FOREIGN} AS non_english FROM n")
def non_english(spark, sf_dir):
    t = S.replies(spark, sf_dir).select("doc_id", T.once(T.normalize(F.col("text"))).alias("t"))
    return t.select("doc_id", T.is_non_english(F.col("t")).alias("non_english"))


@query(f"{_TEXT}, x AS (SELECT array_to_string(list_slice(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> ''), 1, 6), ' ') AS prefix FROM n), c AS (SELECT prefix, count(*) AS n FROM x GROUP BY prefix) SELECT prefix, n, round(n / (SELECT count(*) FROM x), 6) AS share FROM c ORDER BY n DESC, prefix LIMIT 20")
def prefix_counts(spark, sf_dir):
    x = S.replies(spark, sf_dir).select(T.first_words(F.col("text")).alias("prefix"))
    c = x.groupBy("prefix").agg(F.count("*").alias("n"))
    return c.crossJoin(x.agg(F.count("*").alias("all"))).select("prefix", "n", r6(F.col("n") / F.col("all")).alias("share")).orderBy(F.desc("n"), "prefix").limit(20)


@query(rf"{_TEXT}, x AS (SELECT {_FOREIGN} AS f, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM n) SELECT count(*) AS n, round(avg(f::INT::DOUBLE) * 100, 6) AS non_english_pct, round(avg((w < 5)::INT::DOUBLE) * 100, 6) AS short_pct, round(median(w), 6) AS median_words FROM x")
def text_stats(spark, sf_dir):
    x = S.replies(spark, sf_dir).select("text", T.once(T.normalize(F.col("text"))).alias("t")).select(T.is_non_english(F.col("t")).alias("f"), T.word_count(F.col("text")).alias("w"))
    return x.agg(F.count("*").alias("n"), r6(F.avg(F.col("f").cast("double")) * 100).alias("non_english_pct"), r6(F.avg((F.col("w") < 5).cast("double")) * 100).alias("short_pct"), r6(F.percentile("w", F.lit(0.5))).alias("median_words"))


@query("SELECT event_id, epoch(strptime(strftime(ts, '%a %b %d %H:%M:%S +0000 %Y'), '%a %b %d %H:%M:%S %z %Y'))::BIGINT AS parsed FROM events")
def parse_created_at(spark, sf_dir):
    raw = S.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Tue "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy")).alias("raw"))
    return raw.select("event_id", F.unix_timestamp(io.created_at(F.col("raw"))).alias("parsed"))


@query("SELECT doc_id, sha256('model' || chr(0) || coalesce(source, '') || chr(0) || text) AS key, ceil(length(text) / 3.5)::BIGINT AS tokens FROM documents")
def cache_keys(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", T.cache_key(F.lit("model"), F.col("source"), F.col("text")).alias("key"), T.tokens(F.col("text")).cast("long").alias("tokens"))


@query("WITH k AS (SELECT DISTINCT sha256(text) AS key, text FROM documents), c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 3 = 0) SELECT count(*) FILTER (c.key IS NOT NULL) AS cached, count(*) FILTER (c.key IS NULL) AS calls, sum(CASE WHEN c.key IS NULL THEN ceil(length(text) / 3.5) ELSE 0 END)::BIGINT AS tokens FROM k LEFT JOIN c USING (key)")
def cache_preflight(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    have = d.where("doc_id % 3 = 0").select("key", F.lit(1).alias("hit")).distinct()
    x = d.groupBy("key").agg(F.max(T.tokens(F.col("text"))).alias("t")).join(have, "key", "left")
    return x.agg(F.count("hit").alias("cached"), F.count_if(F.col("hit").isNull()).alias("calls"), F.sum(F.when(F.col("hit").isNull(), F.col("t")).otherwise(0)).cast("long").alias("tokens"))


# --- samples and agreement ---------------------------------------------------------------------

_ALLOC = """c AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY source), a AS (SELECT *, 200.0::DOUBLE * n / sum(n) OVER () AS x FROM c), q AS (SELECT stratum, n, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, stratum) AS o FROM a),
al AS (SELECT stratum, n, (f + (o <= 200 - sum(f) OVER ())::INT)::BIGINT AS quota FROM q)"""


@query(f"WITH {_ALLOC} SELECT stratum, n, quota FROM al")
def allocate_strata(spark, sf_dir):
    return sampling.allocate(S.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n")), 200)


@query(f"WITH {_ALLOC}, d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id)) AS r FROM documents) SELECT doc_id, source FROM d JOIN al ON source = stratum WHERE r <= quota")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(S.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 200)


@query("""WITH d AS (SELECT doc_id, source, n_chars, n_chars < 800 AS s, md5('42:' || doc_id) AS k FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source, s ORDER BY k) AS r FROM d), b AS (SELECT *, CASE WHEN s THEN r <= 2 ELSE r <= 18 END AS f FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f DESC, k) AS n FROM b) SELECT doc_id, source FROM c WHERE n <= 20""")
def short_oversample(spark, sf_dir):
    return sampling.short_oversample(S.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", "source", "n_chars", 20, short=800).select("doc_id", "source")


@query("""WITH RECURSIVE l AS (SELECT doc_id, quality * 2 + toxic AS stratum FROM labels WHERE quality * 2 + toxic IS NOT NULL), c AS (SELECT stratum, count(*) AS n FROM l GROUP BY stratum),
w(i, stratum, n, quota, rest) AS (SELECT 0, stratum, n, 0::BIGINT, 60::BIGINT FROM c UNION ALL SELECT i + 1, stratum, n, quota + give, (rest - sum(give) OVER ())::BIGINT FROM
 (SELECT *, greatest(0, least(x, rest - (sum(x) OVER (ORDER BY stratum) - x)))::BIGINT AS give FROM (SELECT *, CASE WHEN quota < n THEN least(greatest(1, rest // greatest(1, count(*) FILTER (quota < n) OVER ())), n - quota) ELSE 0 END AS x FROM w WHERE rest > 0 AND i < 60))),
q AS (SELECT stratum, arg_max(quota, i) AS quota FROM w GROUP BY stratum), d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('44:' || doc_id)) AS r FROM l) SELECT doc_id, stratum FROM d JOIN q USING (stratum) WHERE r <= quota""")
def equal_share_sample(spark, sf_dir):
    d = S.table(spark, sf_dir, "labels").withColumn("stratum", F.col("quality") * 2 + F.col("toxic")).where("stratum is not null")
    quota = sampling.equal_shares({r["stratum"]: r["n"] for r in d.groupBy("stratum").agg(F.count("*").alias("n")).collect()}, 60)
    most = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("stratum"))
    return sampling.first_by_lot(d.withColumn("most", most), ["stratum"], "most", sampling.lot(44, F.col("doc_id"))).select("doc_id", "stratum")


@query("WITH a AS (SELECT doc_id, quality AS p1, ((doc_id * 7) % 5 = 0)::INT AS p2 FROM labels), d AS (SELECT p1, p2, count(*) AS n FROM a WHERE p1 <> p2 GROUP BY ALL) SELECT p1, p2, n, row_number() OVER (ORDER BY n DESC, p1, p2) AS rank FROM d")
def disagreement_pairs(spark, sf_dir):
    a = S.table(spark, sf_dir, "labels").select(F.col("quality").alias("p1"), ((F.col("doc_id") * 7) % 5 == 0).cast("int").alias("p2"))
    d = a.where("p1 <> p2").groupBy("p1", "p2").agg(F.count("*").alias("n"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "p1", "p2")).cast("long"))


@query("WITH e AS (SELECT doc_id, 0 AS repeat, quality AS score FROM labels), f AS (SELECT doc_id, 0 AS repeat, 5 AS score FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 1, 4 FROM labels WHERE doc_id % 8 = 0) SELECT * FROM e ANTI JOIN f USING (doc_id, repeat) UNION ALL SELECT * FROM f")
def upsert_scores(spark, sf_dir):
    own = S.table(spark, sf_dir, "labels")
    old = own.select("doc_id", F.lit(0).alias("repeat"), F.col("quality").alias("score"))
    new = own.where("doc_id % 4 = 0").select("doc_id", F.lit(0).alias("repeat"), F.lit(5).alias("score")).union(own.where("doc_id % 8 = 0").select("doc_id", F.lit(1), F.lit(4)))
    return io.upsert(old, new, ["doc_id", "repeat"])


@query("WITH s AS (SELECT doc_id, unnest([0, 1]) AS repeat, unnest([1 + doc_id % 5, 1 + (doc_id * 3) % 5]) AS score FROM labels), g AS (SELECT doc_id, max(score) - min(score) AS spread FROM s GROUP BY doc_id HAVING count(score) = 2) SELECT round(avg(spread), 6) AS mean_spread, count(*) FILTER (spread = 0) AS agreed, max(spread) AS worst, arg_min(doc_id, struct_pack(a := -spread, b := doc_id)) AS worst_id FROM g")
def judge_consistency(spark, sf_dir):
    s = S.table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(1 + F.col("doc_id") % 5, 1 + (F.col("doc_id") * 3) % 5)).alias("score"))
    g = s.groupBy("doc_id").agg((F.max("score") - F.min("score")).alias("spread"), F.count("score").alias("c")).where("c = 2")
    return g.agg(r6(F.avg("spread")).alias("mean_spread"), F.count_if(F.col("spread") == 0).alias("agreed"), F.max("spread").alias("worst"), F.min(F.struct((-F.col("spread")).alias("a"), "doc_id"))["doc_id"].alias("worst_id"))
