"""Registered queries on judge scores, evaluation tables, answers, the survey, labelling and calls, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.functions import judging as J
from threadloom.functions import rules as R
from threadloom.functions import text as T
from threadloom.operators import answering, calls, clusters, evaluation, forest, judging, labelling, sampling, survey, turns
from threadloom.plans import catalogue as C
from threadloom.plans import surrogates as S
from threadloom.plans.registry import query, r6
from threadloom.sources import checks, io

_q = S._quoted

# --- judge -------------------------------------------------------------------------------------

#: Judge texts around a score %s, and whether they hold three scores: then groundedness, correctness, tone.
FORMS = (
    ('{"groundedness": %s, "correctness": 5, "tone": 4}', ("%s", 5, 4)),
    ('```json\n{"groundedness": "%s", "correctness": 4.0, "tone": 3}\n```', ("%s", 4, 3)),
    ('The scores are {"groundedness": %s, "correctness": 2, "tone": 1}, as asked.', ("%s", 2, 1)),
    ('Of "{this}" I think {"tone": 2, "groundedness": %s, "correctness": 3} {"tone": 1}', ("%s", 3, 2)),
    ('{"groundedness": %s, "correctness": 5}', None),
    ('{"groundedness": %s, "correctness": 5, "tone": 4, "style": 4}', None),
    ('{"groundedness": true, "correctness": %s, "tone": 4}', None),
    ('{"groundedness": %s.5, "correctness": 5, "tone": 4}', None),
    ("four, %s and five", None),
    ('{"groundedness": %s7, "correctness": 5, "tone": 4}', None),
    ('{"groundedness": %s, "correctness": 5, "tone": 4', None),
)
_SCORE = "(1 + doc_id % 5)"


def _expected(i: int) -> str:
    cases = " ".join(f"WHEN {n} THEN {_SCORE if f[1][i] == '%s' else f[1][i]}" for n, f in enumerate(FORMS) if f[1])
    return f"(CASE doc_id % {len(FORMS)} {cases} END)::INT"


@query(f"SELECT doc_id, {', '.join(f'{_expected(i)} AS {a}' for i, a in enumerate(J.AXES))}, {_expected(0)} IS NOT NULL AS parse_ok FROM documents")
def parse_scores(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    form = F.element_at(F.array(*[F.lit(f[0]) for f in FORMS]), (F.col("doc_id") % len(FORMS) + 1).cast("int"))
    raw = d.select("doc_id", F.replace(form, F.lit("%s"), (1 + F.col("doc_id") % 5).cast("string")).alias("raw"))
    return raw.select("doc_id", J.parse_scores(F.col("raw")).alias("s")).select("doc_id", "s.*")


def _judge_rows(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conversation_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))
    d = d.select("conversation_id", "repeat", F.explode(F.array(F.lit("agent"), F.lit("knn"))).alias("system"))
    ok = (F.col("conversation_id") + F.col("repeat")) % 7 != 0
    x = F.col("conversation_id") + F.length("system")
    score = lambda c: F.when(ok, (1 + c % 5).cast("int"))
    return d.select("conversation_id", "repeat", "system", score(x).alias("groundedness"), score(x * 3 + F.col("repeat")).alias("correctness"), score(x * 7 + F.col("repeat") * (x % 3)).alias("tone"), ok.alias("parse_ok"))


_JUDGE = """WITH i AS (SELECT doc_id AS conversation_id, repeat, system, doc_id + length(system) AS x, (doc_id + repeat) % 7 <> 0 AS ok FROM documents, (SELECT unnest([0, 1]) AS repeat), (SELECT unnest(['agent', 'knn']) AS system)),
j AS (SELECT conversation_id, repeat, system, CASE WHEN ok THEN 1 + x % 5 END AS groundedness, CASE WHEN ok THEN 1 + (x * 3 + repeat) % 5 END AS correctness, CASE WHEN ok THEN 1 + (x * 7 + repeat * (x % 3)) % 5 END AS tone, ok AS parse_ok FROM i)"""


@query(f"{_JUDGE} SELECT system, count(*) AS n_rows, count(*) FILTER (parse_ok) AS n_parsed, count(*) FILTER (NOT parse_ok) AS n_failed, {', '.join(f'round(avg({a}), 6) AS mean_{a}' for a in J.AXES)} FROM j GROUP BY system")
def judge_summary(spark, sf_dir):
    out = judging.summary(_judge_rows(spark, sf_dir))
    return out.select("system", "n_rows", "n_parsed", "n_failed", *[r6(f"mean_{a}").alias(f"mean_{a}") for a in J.AXES])


_SPREADS = " UNION ALL ".join(f"SELECT '{a}' AS axis, conversation_id, max({a}) - min({a}) AS s FROM j WHERE system = 'agent' GROUP BY conversation_id HAVING count(*) = 2 AND bool_and(parse_ok)" for a in J.AXES)


@query(f"{_JUDGE}, s AS ({_SPREADS}) SELECT axis, count(*) AS n_compared, round(avg(s), 6) AS mean_spread, count(*) FILTER (s = 0) AS n_agreed, round(avg((s = 0)::INT), 6) AS share_agreed, max(s)::INT AS worst_spread, arg_min(conversation_id, struct_pack(a := -s, b := conversation_id)) AS worst_id FROM s GROUP BY axis")
def judge_consistency_by_axis(spark, sf_dir):
    out = judging.consistency(_judge_rows(spark, sf_dir).where("system = 'agent'"), 2)
    return out.withColumns({"mean_spread": r6("mean_spread"), "share_agreed": r6("share_agreed")})


_HUMAN = "h AS (SELECT doc_id AS conversation_id, 1 + doc_id % 5 AS groundedness, 1 + (doc_id * 3) % 4 AS correctness, 1 + (doc_id % 2) * 4 AS tone FROM documents WHERE doc_id % 3 = 0)"
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS axis, h.{a} AS h, j.{a} AS j FROM h JOIN j USING (conversation_id) WHERE j.system = 'agent' AND repeat = 0 AND parse_ok" for a in J.AXES)


@query(f"""{_JUDGE}, {_HUMAN}, p AS ({_PAIRS}), t AS (SELECT axis, count(*) AS n, avg((h = j)::INT) AS po, sum((h - j) ** 2) AS ow, avg(j) AS jm, avg(h) AS hm FROM p GROUP BY axis), r AS (SELECT axis, h, count(*) AS c FROM p GROUP BY ALL), k AS (SELECT axis, j, count(*) AS c FROM p GROUP BY ALL),
e AS (SELECT r.axis, sum(CASE WHEN h = j THEN r.c * k.c ELSE 0 END)::DOUBLE AS e, sum((h - j) ** 2 * r.c * k.c)::DOUBLE AS ew FROM r JOIN k ON r.axis = k.axis GROUP BY r.axis)
SELECT axis, n, round((po - e / n / n) / (1 - e / n / n), 6) AS kappa, round(1 - ow * n / ew, 6) AS qw_kappa, round(po, 6) AS raw_agreement, round(jm, 6) AS judge_mean, round(hm, 6) AS human_mean FROM t JOIN e USING (axis)""")
def judge_agreement(spark, sf_dir):
    x = F.col("doc_id")
    written = S.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(x.alias("conversation_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("at"), (1 + x % 5).alias("g"), (1 + (x * 3) % 4).alias("c"), (1 + (x % 2) * 4).alias("t"))
    # Scored twice: the first scores are superseded.
    human = judging.latest(written.select("conversation_id", "at", *[F.when(F.col("at") == 1, F.col(a[0])).otherwise(1).cast("int").alias(a) for a in J.AXES]), ["conversation_id"], "at")
    judge = judging.of_system(_judge_rows(spark, sf_dir), "agent", 0).where("parse_ok")
    return judging.agreement(human, judge).select("axis", "n", *[r6(c).alias(c) for c in ("kappa", "qw_kappa", "raw_agreement", "judge_mean", "human_mean")])


@query(f"{_JUDGE} SELECT conversation_id, 'm' || conversation_id AS text, 'r' || conversation_id AS reply, 'c' || conversation_id AS retrieved FROM j WHERE system = 'knn' AND repeat = 1 AND parse_ok ORDER BY 1 LIMIT 50")
def judge_cases(spark, sf_dir):
    rows = judging.of_system(_judge_rows(spark, sf_dir), "knn", 1)
    named = lambda c: F.concat(F.lit(c), "conversation_id")
    drafts = rows.select("conversation_id", named("m").alias("text"), F.when(F.col("parse_ok"), named("r")).otherwise("").alias("reply"))
    return judging.cases(drafts, rows.select("conversation_id", named("c").alias("retrieved")), 50)


# --- evaluation --------------------------------------------------------------------------------

_GOLD = """g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, coalesce(toxic, 0) = 1 AS y_true, (coalesce(quality, 0) + doc_id) % 3 AS c_true FROM labels),
y AS (SELECT 'agent' AS system, pos, y_true, doc_id * 7 % 5 = 0 AS y_pred, c_true, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE c_true END AS c_pred FROM g UNION ALL SELECT 'trivial', pos, y_true, false, c_true, 1 FROM g),
d AS (SELECT r, ('0x' || substr(md5('42:' || r || ':' || q), 1, 8))::BIGINT % n AS pos FROM (SELECT count(*) AS n FROM g), range(100) a(r), range((SELECT count(*) FROM g)) b(q))"""


def _golden(spark, sf_dir):
    """(conversation_id, pos, y_true, c_true): positions rise with the ids, from a range-partitioned count and not from one task."""
    g = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conversation_id"), (F.coalesce("toxic", F.lit(0)) == 1).alias("y_true"), ((F.coalesce("quality", F.lit(0)) + F.col("doc_id")) % 3).cast("int").alias("c_true"))
    return sampling.numbered(g, "conversation_id", "pos")


def _system_pairs(spark, sf_dir, true: str, pred: dict):
    golden = forest.cut(_golden(spark, sf_dir))
    out = None
    for system, value in pred.items():
        own = evaluation.aligned(golden, golden.select("conversation_id", value.alias("y_pred")))
        own = evaluation.checked(own.select(F.lit(system).alias("system"), "pos", F.col(true).alias("y_true"), "y_pred"))
        out = own if out is None else out.union(own)
    return out, golden.count()


@query(f"""WITH {_GOLD}, s AS (SELECT system, r, sum((y_true AND y_pred)::INT) AS tp, sum(y_pred::INT) AS p, sum(y_true::INT) AS t FROM d JOIN y USING (pos) GROUP BY ALL), f AS (SELECT system, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (p + t) END AS f1 FROM s),
w AS (SELECT system, sum((y_true AND y_pred)::INT) AS tp, sum(y_pred::INT) AS p, sum(y_true::INT) AS t FROM y GROUP BY system)
SELECT system, round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS precision, round(CASE WHEN t = 0 THEN 0 ELSE tp / t END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (p + t) END, 6) AS f1, round(quantile_cont(f.f1, 0.025), 6) AS low, round(quantile_cont(f.f1, 0.975), 6) AS high, p::BIGINT AS n_predicted, t::BIGINT AS support FROM w JOIN f USING (system) GROUP BY ALL""")
def escalate_table(spark, sf_dir):
    pairs, n = _system_pairs(spark, sf_dir, "y_true", {"agent": F.col("conversation_id") * 7 % 5 == 0, "trivial": F.lit(False)})
    out = evaluation.binary_table(pairs, n, resamples=100)
    return out.select("system", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "low", "high")], F.col("n_predicted").cast("long").alias("n_predicted"), F.col("support").cast("long").alias("support"))


_CLASS = "SELECT {by}, l, sum((c_true = l AND c_pred = l)::INT) AS tp, sum((c_pred = l)::INT) AS p, sum((c_true = l)::INT) AS t FROM {rows}, (SELECT unnest([0, 1, 2]) AS l) GROUP BY ALL"
_F1 = "CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (p + t) END"


@query(f"""WITH {_GOLD}, k AS ({_CLASS.format(by='system, r', rows='d JOIN y USING (pos)')}), m AS (SELECT system, r, avg({_F1}) AS x FROM k GROUP BY ALL), w AS ({_CLASS.format(by='system', rows='y')}), v AS (SELECT system, avg({_F1}) AS x FROM w GROUP BY system), a AS (SELECT system, avg((c_true = c_pred)::INT) AS a FROM y GROUP BY system)
SELECT system, round(a, 6) AS accuracy, round(v.x, 6) AS macro_f1, round(quantile_cont(m.x, 0.025), 6) AS low, round(quantile_cont(m.x, 0.975), 6) AS high FROM v JOIN a USING (system) JOIN m USING (system) GROUP BY ALL""")
def intent_table(spark, sf_dir):
    pairs, n = _system_pairs(spark, sf_dir, "c_true", {"agent": F.when(F.col("conversation_id") % 4 == 0, 0).otherwise(F.col("c_true")), "trivial": F.lit(1)})
    return evaluation.intent_table(pairs, n, 3, resamples=100).select("system", *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "low", "high")])


@query(f"WITH {_GOLD}, w AS ({_CLASS.format(by='system', rows='y')}) SELECT system, l AS label, round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS precision, round(CASE WHEN t = 0 THEN 0 ELSE tp / t END, 6) AS recall, round({_F1}, 6) AS f1, t::BIGINT AS support FROM w WHERE p + t > 0")
def per_class_table(spark, sf_dir):
    pairs, _ = _system_pairs(spark, sf_dir, "c_true", {"agent": F.when(F.col("conversation_id") % 4 == 0, 0).otherwise(F.col("c_true")), "trivial": F.lit(1)})
    return evaluation.per_class_table(pairs).select("system", "label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


_FAMILY_RULES = {"intent": "doc_id % 3 = 0", "similarity": "doc_id % 5 = 1", "text": "doc_id % 7 < 2"}


@query("WITH " + _GOLD + ", f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS system, g.pos, y_true, {v} AS y_pred FROM g" for k, v in _FAMILY_RULES.items()) + """), s AS (SELECT system, r, sum((y_true AND y_pred)::INT) AS tp, sum(y_pred::INT) AS p, sum(y_true::INT) AS t FROM d JOIN f USING (pos) GROUP BY ALL), b AS (SELECT system, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (p + t) END AS f1 FROM s),
w AS (SELECT system, sum((y_true AND y_pred)::INT) AS tp, sum(y_pred::INT) AS p, sum(y_true::INT) AS t FROM f GROUP BY system)
SELECT system AS family, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (p + t) END, 6) AS f1, round(quantile_cont(b.f1, 0.025), 6) AS low, round(quantile_cont(b.f1, 0.975), 6) AS high, p::BIGINT AS n_fired FROM w JOIN b USING (system) GROUP BY ALL""")
def family_table(spark, sf_dir):
    golden = forest.cut(_golden(spark, sf_dir).withColumnRenamed("y_true", "escalate"))
    fires = [F.when(F.expr(rule.replace("doc_id", "conversation_id")), F.lit(own[0])) for rule, own in zip(_FAMILY_RULES.values(), R.FAMILIES.values(), strict=True)]
    fired = golden.select("conversation_id", F.array_compact(F.array(*fires)).alias("fired"))
    out = evaluation.binary_table(evaluation.family_pairs(golden, fired, R.FAMILIES), golden.count(), resamples=100)
    return out.select(F.col("system").alias("family"), *[r6(c).alias(c) for c in ("f1", "low", "high")], F.col("n_predicted").cast("long").alias("n_fired"))


# --- answers -----------------------------------------------------------------------------------

_SAMPLED = "s AS (SELECT conv_id AS conversation_id, any_value('r' || conv_id) AS first_reply_text, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 4 = 1 END AS orphan, conv_id % 5 = 0 AS golden FROM conversations GROUP BY conv_id)"


def _corpus(spark, sf_dir):
    ids = S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct()
    sampled = ids.select("conversation_id", F.concat(F.lit("r"), "conversation_id").alias("first_reply_text"), F.when(F.col("conversation_id") % 4 != 0, F.col("conversation_id") % 4 == 1).alias("first_reply_orphan_part"))
    return answering.corpus(sampled, ids.where("conversation_id % 5 = 0"))


@query(f"WITH {_SAMPLED} SELECT conversation_id, first_reply_text FROM s WHERE NOT golden AND NOT coalesce(orphan, false)")
def retrieval_corpus(spark, sf_dir):
    return _corpus(spark, sf_dir)[0].select("conversation_id", "first_reply_text")


@query(f"WITH {_SAMPLED} SELECT count(*) AS n, count(*) FILTER (golden) AS golden, count(*) FILTER (orphan) AS orphans, count(*) FILTER (golden AND orphan) AS both, count(*) FILTER (NOT golden AND NOT coalesce(orphan, false)) AS kept FROM s")
def corpus_exclusions(spark, sf_dir):
    return _corpus(spark, sf_dir)[1]


#: What a classifier says, and the label and whether it parses.
SAID = (("app_bug", "app_bug", True), (' "Billing Dispute." ', "billing_dispute", True), ("The label is how-to question", "how_to_question", True), ("app_bug or other", "other", False), ("none of them", "other", False))
_REPLY_OF = f"([{', '.join(map(_q, S.REPLIES))}])[(vec_id % {len(S.REPLIES)})::INT + 1]"
_FIRES = f"""list_filter([CASE WHEN intent IN ('billing_dispute', 'account_access') THEN 'intent_needs_account_data' END, CASE WHEN top < 0.6 THEN 'no_similar_precedent' END, CASE WHEN {C._LEX(R.ABUSE)} THEN 'abuse_or_profanity' END,
CASE WHEN {C._LEX(R.CANCELLATION)} THEN 'cancellation_or_refund' END, CASE WHEN {C._LEX(R.LEGAL)} THEN 'legal_or_safety' END, CASE WHEN {C._PII} THEN 'pii_present' END], lambda x: x IS NOT NULL)"""


def _messages(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("vec_id") % len(values) + 1).cast("int"))
    m = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), pick(S.REPLIES).alias("text"), F.element_at(F.array(*[F.lit(s[0]) for s in SAID]), (F.floor(F.col("vec_id") / 10) % len(SAID) + 1).cast("int")).alias("raw_intent"), F.col("embedding").alias("qv"))
    pool = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("cv"), F.concat(F.lit("q"), "vec_id").alias("opening_text"), F.concat(F.lit("r"), "vec_id").alias("first_reply_text"))
    return m, pool


_INTENTS_SAID = "CASE (vec_id // 10) % {n} " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(SAID))) + " END"
_OF = lambda values: _INTENTS_SAID.format(*values, n=len(SAID))


@query(f"""WITH {C._CORPUS}, k AS (SELECT query_id, max(similarity) AS top, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS near FROM n WHERE rank <= 3 GROUP BY query_id),
m AS (SELECT vec_id AS query_id, {_REPLY_OF} AS text, {_OF([_q(s[1]) for s in SAID])} AS intent, {_OF([str(s[2]).lower() for s in SAID])} AS parse_ok FROM embeddings WHERE vec_id % 10 = 0),
z AS (SELECT *, {_FIRES} AS fired FROM m JOIN k USING (query_id))
SELECT query_id, intent, parse_ok, near, round(top, 6) AS top_similarity, CASE WHEN len(fired) > 0 THEN 'escalate' ELSE 'auto' END AS decision, array_to_string(fired, ',') AS signals, CASE WHEN len(fired) = 0 AND query_id % 20 = 0 THEN 'd' || query_id END AS reply, len(fired) = 0 AND query_id % 20 = 0 AS reply_generated FROM z""")
def answers(spark, sf_dir):
    messages, pool = _messages(spark, sf_dir)
    drafts = messages.where("query_id % 20 = 0").select("query_id", F.concat(F.lit(" d"), "query_id", F.lit(" ")).alias("reply"))
    out = answering.answer(messages, pool, drafts)
    near = F.array_join(F.transform("retrieved", lambda x: x["item_id"].cast("string")), ",").alias("near")
    return out.select("query_id", "intent", "parse_ok", near, r6("top_similarity").alias("top_similarity"), "decision", F.array_join("triggered_signals", ",").alias("signals"), "reply", "reply_generated")


@query(f"{C._VOTE}, c AS (SELECT query_id AS cid, item_id AS near, similarity AS top FROM (SELECT q.query_id, e.vec_id AS item_id, list_dot_product(qv, embedding::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(qv, embedding::DOUBLE[]), 9) DESC, e.vec_id) AS r FROM q JOIN embeddings e ON e.vec_id % 10 <> 0) WHERE r = 1) SELECT query_id, y_pred AS intent, votes, round(top, 6) AS top_similarity, 'auto' AS decision, 'r' || near AS reply, true AS reply_generated FROM y JOIN c ON cid = query_id")
def knn_answer(spark, sf_dir):
    messages, pool = _messages(spark, sf_dir)
    own = messages.select("query_id", "qv", F.concat(F.lit("t"), "query_id").alias("text"))
    bank = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("cv"), "label", F.concat(F.lit("t"), "vec_id").alias("text"))
    return answering.knn_answer(own, bank, pool).withColumn("top_similarity", r6("top_similarity"))


@query(f"WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY label), m AS (SELECT label FROM c ORDER BY n DESC, label DESC LIMIT 1) SELECT vec_id AS query_id, m.label AS intent, 'auto' AS decision, {_q(answering.CANNED)} AS reply FROM embeddings e, m WHERE vec_id % 10 = 0")
def majority_answer(spark, sf_dir):
    messages, _ = _messages(spark, sf_dir)
    bank = S.table(spark, sf_dir, "embeddings").where("vec_id % 10 <> 0").select("label")
    positions = spark.createDataFrame([(i, -i) for i in range(100)], "label int, pos int")
    return answering.majority_answer(messages, bank, positions)


@query("""WITH c AS (SELECT a.conv_id, a.text AS t, b.text AS r, printf('%.3f', (a.conv_id % 1000) / 1000.0::DOUBLE) AS s FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0)
SELECT conv_id AS query_id, 'Customer: ' || t || chr(10) || 'Label:' AS classify, concat_ws(chr(10), '[1] similarity ' || s, 'Customer: ' || t, 'Reply: ' || r, '', '[new] other', 'Customer: ' || t, 'Reply:') AS reply,
concat_ws(chr(10), '[nothing similar]', '', '[new]', 'Customer: ' || t, 'Draft: ' || r, 'Scores:') AS judge FROM c""")
def prompts(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    first, second = c.where("turn = 0").select("conv_id", F.col("text").alias("t")), c.where("turn = 1").select("conv_id", F.col("text").alias("r"))
    items = F.array(F.struct(((F.col("conv_id") % 1000) / 1000).alias("similarity"), F.col("t").alias("opening_text"), F.col("r").alias("first_reply_text")))
    rows = first.join(second, "conv_id", "left")
    return rows.select(F.col("conv_id").alias("query_id"), answering.classify_prompt(F.col("t")).alias("classify"), answering.reply_prompt(F.col("t"), F.lit("other"), items).alias("reply"), answering.judge_prompt(F.col("t"), F.col("r"), F.slice(items, 1, 0)).alias("judge"))


# --- survey and summaries ----------------------------------------------------------------------

_TWEETS = f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, role = 'user' AS inbound, CASE WHEN role = 'user' THEN 'cust' ELSE 'Brand' || ((conv_id + turn // 4) % 12) END AS author_id, CASE WHEN conv_id % 13 <> 0 THEN conv_id END AS conversation_id,
 CASE WHEN role = 'user' THEN '@BRAND' || (conv_id % 12) || ' ' || coalesce(text, '') WHEN conv_id % 2 = 0 THEN ([{', '.join(map(_q, S.REPLIES))}])[((conv_id + turn) % {len(S.REPLIES)})::INT + 1] ELSE text END AS text FROM conversations),
a AS (SELECT * FROM w WHERE conversation_id IS NOT NULL), o AS (SELECT * FROM a WHERE NOT inbound), b AS (SELECT author_id, count(DISTINCT conversation_id) AS conversations FROM o GROUP BY author_id)"""


def _brand_tweets(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    known = F.array(*[F.lit(r) for r in S.REPLIES])
    user = F.col("role") == "user"
    brand = F.concat(F.lit("Brand"), ((F.col("conv_id") + F.floor(F.col("turn") / 4)) % 12).cast("string"))
    text = F.when(user, F.concat(F.lit("@BRAND"), (F.col("conv_id") % 12).cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))).when(F.col("conv_id") % 2 == 0, F.element_at(known, ((F.col("conv_id") + F.col("turn")) % len(S.REPLIES) + 1).cast("int"))).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), user.alias("inbound"), F.when(user, "cust").otherwise(brand).alias("author_id"), F.when(F.col("conv_id") % 13 != 0, F.col("conv_id")).alias("conversation_id"), text.alias("text"))


_MULTI = _q(T.MULTIPART.removeprefix("(?U)"))


@query(f"""{_TWEETS}, s AS (SELECT conversation_id, count(*) AS c FROM a GROUP BY 1), u AS (SELECT DISTINCT author_id, conversation_id FROM o SEMI JOIN b USING (author_id)), md AS (SELECT author_id, median(c) AS m FROM u JOIN s USING (conversation_id) GROUP BY 1),
ad AS (SELECT DISTINCT b.author_id, a.conversation_id FROM a JOIN b ON a.inbound AND contains(lower(a.text), '@' || lower(b.author_id))), an AS (SELECT author_id, avg((u.conversation_id IS NOT NULL)::INT) * 100 AS p FROM ad LEFT JOIN u USING (author_id, conversation_id) GROUP BY 1),
n AS (SELECT author_id, {C._NORM} AS t FROM o SEMI JOIN b USING (author_id)), x AS (SELECT author_id, {C._HAS} AS h, len({C._LEFT}) AS w, {C._FOREIGN} AS f, coalesce(regexp_matches(t, {_MULTI}), false) AS mp FROM n),
r AS (SELECT author_id, avg(h::INT) * 100 AS rp, avg((h AND w <= 3)::INT) * 100 AS dp, median(w) AS mw, avg(f::INT) * 100 AS fp, avg(mp::INT) * 100 AS mpp FROM x GROUP BY 1)
SELECT author_id, conversations, round(m, 6) AS median_tweets, round(p, 6) AS answered_pct, round(rp, 6) AS redirect_pct, round(dp, 6) AS deflection_pct, round(mw, 6) AS median_residual, round(fp, 6) AS non_english_pct, round(mpp, 6) AS multipart_pct FROM b JOIN md USING (author_id) LEFT JOIN an USING (author_id) JOIN r USING (author_id)""")
def brand_report(spark, sf_dir):
    out = survey.report(_brand_tweets(spark, sf_dir), None)
    return out.select("author_id", "conversations", *[r6(c).alias(c) for c in ("median_tweets", "answered_pct", "redirect_pct", "deflection_pct", "median_residual", "non_english_pct", "multipart_pct")])


@query(f"{_TWEETS}, p AS (SELECT conversation_id, count(DISTINCT author_id) AS c FROM o GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (c > 1) AS several, round(avg((c > 1)::INT) * 100, 6) AS several_pct FROM p")
def several_brands(spark, sf_dir):
    t = _brand_tweets(spark, sf_dir).where("conversation_id is not null and not inbound")
    return survey.several_brands(t).withColumn("several_pct", r6("several_pct"))


@query(f"""{C._F}, k AS (SELECT parent, count(*) AS n FROM b GROUP BY parent), z AS (SELECT b.id, {C._KIND} AS kind, f.depth, coalesce(k.n, 0) AS kids FROM b LEFT JOIN f ON b.id = f.id LEFT JOIN k ON k.parent = b.id),
lv AS (SELECT f.thread_id, count(*) AS leaves FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.parent = f.id) GROUP BY 1)
SELECT count(*) FILTER (kind <> 'cycle') AS tweets, (SELECT count(DISTINCT thread_id) FROM f) AS threads, count(*) FILTER (depth = 0 AND kind = 'customer_root') AS customer_roots, count(*) FILTER (depth = 0 AND kind = 'brand_root') AS brand_roots, count(*) FILTER (depth = 0 AND kind = 'orphan') AS orphans, 0 AS cycle_tweets, count(*) FILTER (kids > 1 AND kind <> 'cycle') AS branching, max(depth) AS max_depth, (SELECT max(leaves) FROM lv) AS max_branches FROM z""")
def thread_summary(spark, sf_dir):
    return survey.thread_summary(forest.build(S.tweets(spark, sf_dir)).where("depth >= 0"))


@query(f"""WITH {S.TURNS_SQL}, sb AS (SELECT conversation_id, count(*) AS c FROM p GROUP BY 1 HAVING bool_or(author_id = 'brand' AND NOT inbound)), s AS (SELECT conversation_id FROM sb WHERE c <= 6), vs AS (SELECT * FROM v SEMI JOIN s USING (conversation_id)),
os AS (SELECT conversation_id, merge_group, max(resorted) AS resorted, count(CASE WHEN NOT inbound AND body IS NOT NULL THEN 1 END) AS signed FROM o SEMI JOIN s USING (conversation_id) GROUP BY ALL), n AS (SELECT *, {C._NORM} AS t FROM vs),
d AS (SELECT *, n_parts = 1 AND n_marked = 1 AS orphan, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index) AS r FROM n WHERE role = 'brand' AND NOT ({C._HAS} AND len({C._LEFT}) <= 3)), f AS (SELECT s.conversation_id, d.text, d.orphan FROM s LEFT JOIN d ON d.conversation_id = s.conversation_id AND d.r = 1)
SELECT (SELECT count(DISTINCT conversation_id) FROM p) AS conversations, (SELECT count(*) FROM sb) AS of_brand, (SELECT sum(c) FROM sb)::BIGINT AS tweets, (SELECT count(*) FROM os WHERE resorted) AS resorted, (SELECT sum(signed) FROM os)::BIGINT AS signed, 0::BIGINT AS signed_by_several,
sum(n_parts)::BIGINT AS capped_tweets, count(*) AS turns, count(*) FILTER (n_parts > 1) AS merged_groups, count(DISTINCT CASE WHEN n_parts > 1 THEN conversation_id END) AS merged_conversations, count(*) FILTER (n_parts = 1 AND n_marked = 1) AS orphan_parts,
(SELECT count(*) FROM f) AS kept, (SELECT count(*) FROM f WHERE orphan) AS orphan_first, (SELECT count(text) FROM f) AS with_reply, (SELECT count(*) FROM f WHERE text IS NULL) AS without_reply, round(count(DISTINCT CASE WHEN n_parts > 1 THEN conversation_id END) * 100 / (SELECT count(*) FROM f), 6) AS merged_pct FROM vs""")
def sample_summary(spark, sf_dir):
    posts = S.posts(spark, sf_dir)
    selected = turns.select_brand(posts, "brand")
    merged = turns.clean(turns.merge_groups(turns.cap(selected, 6)))
    turned = forest.cut(turns.turns(merged))
    return survey.sample_summary(posts, selected, merged, turned, turns.nested(turned)).withColumn("merged_pct", r6("merged_pct"))


@query(f"{C._CONV} SELECT source, count(DISTINCT conversation_id) AS conversations, count(*) AS tweets FROM v GROUP BY source")
def conversation_counts(spark, sf_dir):
    return survey.conversation_counts(forest.assign(forest.build(S.tweets(spark, sf_dir)).where("depth >= 0")))


# --- labelling ---------------------------------------------------------------------------------

_NAMES = tuple("abc")
_PASSES = "f AS (SELECT doc_id, (['a', 'b', 'c'])[(doc_id % 3)::INT + 1] AS y FROM labels WHERE doc_id % 2 = 0), s AS (SELECT doc_id, (['a', 'b', 'c'])[(doc_id * 5 % 7 % 3)::INT + 1] AS y FROM labels WHERE doc_id % 3 <> 0), j AS (SELECT doc_id, f.y AS p1, s.y AS p2 FROM f JOIN s USING (doc_id))"


def _passes(spark, sf_dir):
    own = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conversation_id"))
    named = lambda i: F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (i % 3 + 1).cast("int")).alias("intent")
    x = F.col("conversation_id")
    return own.where(x % 2 == 0).select(x, named(x)), own.where(x % 3 != 0).select(x, named(x * 5 % 7))


@query(f"WITH {_PASSES} SELECT (SELECT count(*) FROM s ANTI JOIN f USING (doc_id)) AS orphans, count(*) AS n, round(avg((p1 = p2)::INT), 6) AS accuracy, round((avg((p1 = p2)::INT) - e) / (1 - e), 6) AS kappa FROM j, (SELECT sum(x.c * y.c) / any_value((SELECT count(*) FROM j)) ** 2 AS e FROM (SELECT p1, count(*) AS c FROM j GROUP BY 1) x JOIN (SELECT p2, count(*) AS c FROM j GROUP BY 1) y ON p1 = p2) GROUP BY e")
def pass_agreement(spark, sf_dir):
    both, orphans = labelling.joined(*_passes(spark, sf_dir))
    return labelling.agreement(both, _NAMES).select(F.lit(orphans).cast("long").alias("orphans"), "n", r6("accuracy").alias("accuracy"), r6("kappa").alias("kappa"))


@query(f"WITH {_PASSES} SELECT p1 AS pass1, p2 AS pass2, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM j WHERE p1 <> p2 GROUP BY ALL")
def pass_disagreements(spark, sf_dir):
    both, _ = labelling.joined(*_passes(spark, sf_dir))
    return labelling.disagreements(both, _NAMES).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(f"WITH {_PASSES}, i AS (SELECT unnest([p1, p2]) AS label FROM j WHERE p1 <> p2), c AS (SELECT label, count(*) AS n FROM i GROUP BY label) SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS rank FROM c")
def label_involvement(spark, sf_dir):
    both, _ = labelling.joined(*_passes(spark, sf_dir))
    return labelling.involved(both, _NAMES).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_PASSES}, c AS (SELECT y, count(*) AS n FROM f GROUP BY y), a AS (SELECT *, 20.0::DOUBLE * n / sum(n) OVER () AS x FROM c), q AS (SELECT y, floor(x) AS fl, row_number() OVER (ORDER BY x - floor(x) DESC, y) AS o FROM a),
al AS (SELECT y, fl + (o <= 20 - sum(fl) OVER ())::INT AS quota FROM q), d AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('43:' || doc_id)) AS r FROM f) SELECT doc_id AS conversation_id FROM d JOIN al USING (y) WHERE r <= quota""")
def relabel_draw(spark, sf_dir):
    first, _ = _passes(spark, sf_dir)
    pool = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conversation_id"), F.lit("x").alias("note"))
    return labelling.relabel(pool, first, 20)


# --- calls -------------------------------------------------------------------------------------

_ASKED = "r AS (SELECT doc_id, 'gemini-x' AS model, source AS system, text AS prompt, doc_id % 2 AS variant FROM documents WHERE text IS NOT NULL), k AS (SELECT *, sha256(model || chr(0) || coalesce(system, '') || chr(0) || prompt || CASE WHEN variant = 0 THEN '' ELSE chr(0) || variant END) AS key FROM r), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)"


def _requests(spark, sf_dir):
    r = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lit("gemini-x").alias("model"), F.col("source").alias("system"), F.col("text").alias("prompt"), (F.col("doc_id") % 2).cast("int").alias("variant"))
    return r, calls.asked(r.where("doc_id % 3 = 0")).dropDuplicates(["key"]).select("key", F.concat(F.lit("said "), "key").alias("response"))


@query(f"WITH {_ASKED} SELECT DISTINCT key, 'gemini' AS provider, variant::INT AS variant FROM k ANTI JOIN c USING (key)")
def cache_misses(spark, sf_dir):
    return calls.misses(*_requests(spark, sf_dir)).select("key", "provider", "variant")


@query(f"WITH {_ASKED}, u AS (SELECT key, any_value(coalesce(system, '') || prompt) AS t FROM k GROUP BY key) SELECT count(*) AS n, count(c.key) AS cached, count(*) FILTER (c.key IS NULL) AS calls, coalesce(sum(CASE WHEN c.key IS NULL THEN ceil(length(t) / 3.5) END), 0)::BIGINT AS tokens FROM u LEFT JOIN c USING (key)")
def call_budget(spark, sf_dir):
    return calls.budget(*_requests(spark, sf_dir))


@query(f"WITH {_ASKED} SELECT doc_id, key, 'said ' || key AS response FROM k SEMI JOIN c USING (key)")
def cache_replay(spark, sf_dir):
    requests, cache = _requests(spark, sf_dir)
    known = calls.asked(requests).join(cache, "key", "left_semi").select(*requests.columns)
    return calls.complete(known, cache)[0].select("doc_id", "key", "response")


@query("""WITH e AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[aeiou]')) AS v FROM documents) SELECT doc_id, CASE WHEN n = 0 AND v = 0 THEN 0 ELSE round((n / sqrt(n * n + v * v))::FLOAT::DOUBLE, 6) END AS x, CASE WHEN n = 0 AND v = 0 THEN 0 ELSE round((v / sqrt(n * n + v * v))::FLOAT::DOUBLE, 6) END AS y FROM e""")
def embedded_texts(spark, sf_dir):
    """Each document's vector from a stand-in model (letters, vowels): a third of the texts from the cache, each other text through the ledger once."""
    d = S.spread(S.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n, v = F.length("text").cast("double"), F.regexp_count("text", F.lit("[aeiou]")).cast("double")
    cached = d.where("doc_id % 3 = 0 and length(text) > 0").select("text", F.array(n / F.sqrt(n * n + v * v), v / F.sqrt(n * n + v * v)).cast("array<float>").alias("vector"))
    cache = cached.select(T.cache_key(F.lit("stand-in"), F.col("text")).alias("key"), "vector").dropDuplicates(["key"])
    out, _ = calls.embed(d, cache, "stand-in", lambda texts: [[float(len(t)), float(sum(map(t.count, "aeiou")))] for t in texts], 2, batch=1024)
    return out.select("doc_id", *[r6(F.col("vector")[i].cast("double")).alias(c) for i, c in enumerate("xy")])


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_texts(spark, sf_dir):
    return calls.first_of(S.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def csv_documents(spark, sf_dir):
    """All documents through a quoted CSV in the shared folder, read back by as many tasks as its files have splits."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    path = f"{forest.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    d.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.read_csv(spark, path, d.schema)


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def one_to_one_join(spark, sf_dir):
    return checks.join_one_to_one(S.table(spark, sf_dir, "documents").select("doc_id", "source"), S.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


# --- clusters ----------------------------------------------------------------------------------


@query()
def cluster_sweep(spark, sf_dir):
    """k, inertia, silhouette and sizes over all vectors: 10 starts of each k from 5 to 12."""
    return clusters.sweep(S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("cv")))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT label, count(*) AS n FROM e GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS far FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
m AS (SELECT vec_id, d.label, max(CASE WHEN other = d.label THEN far / (n - 1) END) AS own, min(CASE WHEN other <> d.label THEN far / n END) AS near FROM d JOIN c ON c.label = d.other GROUP BY ALL)
SELECT c.label, c.n, round(avg((near - own) / greatest(near, own)), 6) AS silhouette FROM m JOIN c USING (label) GROUP BY ALL""")
def silhouette_by_label(spark, sf_dir):
    rows = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("cv"), F.col("label").alias("cluster"))
    return clusters.silhouette_values(rows).groupBy(F.col("cluster").alias("label")).agg(F.count("*").alias("n"), r6(F.avg("s")).alias("silhouette"))


@query("WITH c AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label), z AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS rank, sum(n) OVER () AS total FROM c), d AS (SELECT vec_id, label AS cluster, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) AS r FROM embeddings) SELECT rank, cluster, n, round(n / total * 100, 6) AS share, least(n, 10) AS shown, vec_id AS id, 's' AS source, 'text ' || vec_id AS text FROM d JOIN z USING (cluster) WHERE r <= 10")
def cluster_exemplars(spark, sf_dir):
    rows = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.lit("s").alias("source"), F.concat(F.lit(" text \n"), "vec_id").alias("text"))
    return clusters.exemplars(rows).withColumns({"share": r6("share"), "rank": F.col("rank").cast("long"), "shown": F.col("shown").cast("long")})

