"""Answers to messages: the corpus they are drawn from, retrieval, escalation, drafts, and two baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import rules as R
from threadloom.functions import text as T
from threadloom.operators import calls, vectors
from threadloom.operators.forest import cut
from threadloom.sources.checks import expect_all, expect_unique

#: What the trivial baseline sends to everybody.
CANNED = "Thanks for getting in touch. We'll take a look and get back to you."


def corpus(sampled: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): sampled conversations that may be retrieved, and what was left out.

    Golden conversations go, and those whose first reply is one part of several (null: it isn't).
    Both may hold for one row: counts (n, golden, orphans, both, kept) has each on its own.
    """
    known = golden.select("conversation_id").distinct().withColumn("_g", F.lit(True))
    marked = sampled.join(known, "conversation_id", "left")
    is_golden, is_orphan = F.coalesce("_g", F.lit(False)), F.coalesce("first_reply_orphan_part", F.lit(False))
    marked = marked.withColumns({"_g": is_golden, "_o": is_orphan})
    counts = marked.agg(F.count("*").alias("n"), F.count_if("_g").alias("golden"), F.count_if("_o").alias("orphans"), F.count_if(F.col("_g") & F.col("_o")).alias("both"), F.count_if(~(F.col("_g") | F.col("_o"))).alias("kept"))
    rows = marked.where(~(F.col("_g") | F.col("_o"))).drop("_g", "_o")
    expect_unique(rows, "conversation_id")
    expect_all(rows, F.col("first_reply_text").isNotNull(), "a retrievable conversation has a first reply")
    return rows, counts


def retrieved(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(query_id, retrieved, top_similarity) of queries (query_id, qv): the k nearest of pool (item_id, cv, ...), nearest first.

    retrieved: array of structs of rank, item_id, similarity and pool's further columns. With an
    empty pool it is empty and top_similarity 0.
    """
    more = [c for c in pool.columns if c not in ("item_id", "cv")]
    near = vectors.top_k(queries.select("query_id", "qv"), pool, k)
    rows = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "similarity", *more))).alias("retrieved"))
    out = queries.select("query_id").join(rows, "query_id", "left")
    none = F.array().cast(rows.schema["retrieved"].dataType)
    out = out.withColumn("retrieved", F.coalesce("retrieved", none))
    return out.withColumn("top_similarity", F.coalesce(F.get("retrieved", F.lit(0))["similarity"], F.lit(0.0)))


def decided(rows: DataFrame, floor: float = R.SIMILARITY_FLOOR) -> DataFrame:
    """rows (text, intent, top_similarity, ...) with decision, reason, triggered_signals and signals_by_family."""
    out = rows.select("*", T.once(R.signals(F.col("text"), F.col("intent"), F.col("top_similarity"), floor)).alias("triggered_signals"))
    fired = F.col("triggered_signals")
    return out.withColumns({"decision": F.when(F.size(fired) > 0, "escalate").otherwise("auto"), "reason": R.reason(fired), "signals_by_family": R.by_family(fired)})


def answer(messages: DataFrame, pool: DataFrame, replies: DataFrame, k: int = 3, force_reply: bool = False, floor: float = R.SIMILARITY_FLOOR) -> DataFrame:
    """Parse, retrieve, decide, and the draft unless the message is escalated or drafts are forced.

    messages (query_id, text, raw_intent, qv): raw_intent is the classifier's text. replies
    (query_id, reply) are drafts; a message that needs one and has none gets null. The result has
    intent, parse_ok, retrieved, top_similarity, the columns of decided, reply, reply_generated.
    """
    parsed = messages.select("query_id", "text", "raw_intent", "qv", T.once(T.parse_intent(F.col("raw_intent"))).alias("p"))
    parsed = parsed.select("query_id", "text", "raw_intent", "qv", "p.intent", "p.parse_ok")
    rows = decided(parsed.drop("qv").join(retrieved(parsed.select("query_id", "qv"), pool, k), "query_id"), floor)
    wanted = F.lit(True) if force_reply else F.col("decision") == "auto"
    out = rows.join(replies.select("query_id", F.trim("reply").alias("_reply")), "query_id", "left")
    return out.withColumn("reply", F.when(wanted, F.col("_reply"))).drop("_reply").withColumn("reply_generated", F.col("reply").isNotNull())


def knn_answer(messages: DataFrame, bank: DataFrame, pool: DataFrame, vote_k: int = 5, k: int = 3) -> DataFrame:
    """(query_id, intent, votes, top_similarity, decision, reply, reply_generated): the voted intent and the nearest reply as it is.

    messages and bank share texts: a message doesn't vote for itself, by equal text. bank (item_id,
    cv, label, text), at least vote_k of other texts for each message, else this raises; pool
    (item_id, cv, first_reply_text).
    """
    far = bank.withColumnRenamed("text", "bank_text")
    near = vectors.top_k(messages.select("query_id", "qv", "text"), far, vote_k, exclude=("text", "bank_text"))
    expect_all(messages.select("query_id").join(near.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left"), F.col("n") >= vote_k, f"{vote_k} others can vote")
    voted = vectors.vote(near).select("query_id", F.col("label").alias("intent"), "votes")
    best = retrieved(messages.select("query_id", "qv"), pool, k)
    reply = F.get("retrieved", F.lit(0))["first_reply_text"]
    out = voted.join(best, "query_id").select("query_id", "intent", "votes", "top_similarity", F.lit("auto").alias("decision"), reply.alias("reply"))
    return out.withColumn("reply_generated", F.col("reply").isNotNull())


def majority_answer(messages: DataFrame, bank: DataFrame, positions: DataFrame) -> DataFrame:
    """(query_id, intent, decision, reply): the bank's most frequent label (ties by position), the canned reply, never escalated."""
    most = bank.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(positions), "label").orderBy(F.desc("n"), "pos").limit(1).select(F.col("label").alias("intent"))
    return messages.select("query_id").crossJoin(F.broadcast(most)).withColumns({"decision": F.lit("auto"), "reply": F.lit(CANNED)})


# --- a run -------------------------------------------------------------------------------------


def classify_requests(messages: DataFrame, model: str, instructions: str) -> DataFrame:
    return messages.select("query_id", F.lit(model).alias("model"), F.lit(instructions).alias("system"), classify_prompt(F.col("text")).alias("prompt"), F.lit(0).alias("variant"))


def reply_requests(rows: DataFrame, model: str, instructions: str) -> DataFrame:
    return rows.select("query_id", F.lit(model).alias("model"), F.lit(instructions).alias("system"), reply_prompt(F.col("text"), F.col("intent"), F.col("retrieved")).alias("prompt"), F.lit(0).alias("variant"))


def understood(messages: DataFrame, raw: DataFrame, near: DataFrame, floor: float) -> DataFrame:
    """messages (query_id, text) whose classifier's text is in raw (query_id, response), with intent, parse_ok, near's columns and those of decided."""
    parsed = messages.select("query_id", "text").join(raw.select("query_id", "response"), "query_id").select("query_id", "text", T.once(T.parse_intent(F.col("response"))).alias("p"))
    return decided(parsed.select("query_id", "text", "p.intent", "p.parse_ok").join(near, "query_id"), floor)


def preflight(messages: DataFrame, near: DataFrame, cache: DataFrame, classify: tuple[str, str], reply: tuple[str, str], force_reply: bool = False, floor: float = R.SIMILARITY_FLOOR, most: int | None = None) -> DataFrame:
    """calls.agent_budget of a run on messages; classify and reply are (model, instructions). More calls than most raises, before any goes out."""
    held = cache.select("key", "response")
    first = calls.asked(classify_requests(messages, *classify)).join(held, "key", "left").select("query_id", "response")
    known = cut(understood(messages, first.where("response is not null"), near, floor))
    classified = first.select("query_id", F.col("response").isNotNull().alias("cached")).join(known.select("query_id", "decision"), "query_id", "left")
    drafts = calls.asked(reply_requests(known, *reply)).join(held, "key", "left").select("query_id", F.col("response").isNotNull().alias("cached"))
    plan = cut(calls.agent_budget(classified, drafts, force_reply))
    if most is not None and (total := plan.first()["total"]) > most:
        raise calls.OverBudget(f"{total} calls are needed and {most} allowed; nothing has been sent")
    return plan


def run(messages: DataFrame, pool: DataFrame, cache: DataFrame, classify: tuple[str, str], reply: tuple[str, str], call: Callable | None = None, ledger: str | None = None, k: int = 3, force_reply: bool = False, floor: float = R.SIMILARITY_FLOOR, most: int | None = None, gap: float = calls.GAP_S) -> DataFrame:
    """answer's columns for messages (query_id, text, qv): classified, decided and drafted by calls that the cache, the ledger or call answers.

    pool (item_id, cv, opening_text, first_reply_text). Drafts are asked for only where none would be
    thrown away. most: see preflight. Without call, what the cache lacks raises CacheMiss.
    """
    near = cut(retrieved(messages.select("query_id", "qv"), pool, k))
    held = cache.select("key", "response")
    if ledger:
        held = held.union(calls.answered(messages.sparkSession, ledger).join(held.select("key"), "key", "left_anti").select("key", "response"))
    if most is not None:
        preflight(messages, near, held, classify, reply, force_reply, floor, most)
    raw, _ = calls.complete(classify_requests(messages, *classify), held, call, ledger, gap)
    rows = cut(understood(messages, raw, near, floor))
    wanted = rows if force_reply else rows.where(F.col("decision") == "auto")
    drafts, _ = calls.complete(reply_requests(wanted, *reply), held, call, ledger, gap)
    out = rows.join(drafts.select("query_id", F.trim("response").alias("reply")), "query_id", "left")
    return out.withColumn("reply_generated", F.col("reply").isNotNull())


# --- instructions and prompts ------------------------------------------------------------------

#: What each intent stands for, in our words; a caller with a taxonomy of its own gives its own.
GLOSSES = {
    "playback_library": "sound, playlists, downloads or saved items do not behave as they should",
    "app_bug": "the application crashes, freezes or shows an error",
    "content_issue": "something is missing from the catalogue, or wrong in it",
    "account_access": "the customer cannot get into the account, or somebody else has",
    "billing_dispute": "a charge is wrong, doubled or unwanted, or money should come back",
    "subscription_query": "a question about plans, prices, offers or who may use them",
    "feature_request": "a wish for something that the product does not do",
    "how_to_question": "how to do something that works",
    "other": "no request, or none of the above",
}
#: What each axis asks of a draft, and what its ends look like.
RUBRIC = {
    "groundedness": ("does every statement rest on the earlier replies?", "facts or rules of its own making", "nothing that the earlier replies do not carry"),
    "correctness": ("is anything untrue, or promised that support cannot keep?", "an untruth, or a promise of money, a fix or a date", "nothing untrue and no such promise"),
    "tone": ("does it read like the earlier replies?", "stiff, cold, or too familiar", "short, plain and friendly, as they are"),
}


def classify_instructions(glosses: dict[str, str] = GLOSSES) -> str:
    """Instructions for a classifier over the given labels."""
    return "\n".join(["Give the customer's message one label, by what the customer wants to be done.", "", *[f"- {label}: {gloss}" for label, gloss in glosses.items()], "", "Several wishes: the first one counts. Anger alone is no wish. A vague report of a fault is still that fault.", "Answer with the label and nothing else."])


def reply_instructions(brand: str) -> str:
    """Instructions for a writer of replies of a brand."""
    return "\n".join([f"You answer customers for {brand}, in its own voice.", "Earlier conversations come first, with the replies that were sent; then the new message.", "", "Say nothing about the customer's account, which you cannot see. Promise only what those replies promise.", "Where they ask for details, ask for them too. Be as short as they are. Write the reply alone."])


def judge_instructions(rubric: dict[str, tuple[str, str, str]] = RUBRIC, low: int = 1, high: int = 5) -> str:
    """Instructions for a judge that scores each axis of the rubric."""
    axes = [line for axis, (question, worst, best) in rubric.items() for line in (f"{axis}: {question}", f"  {low}: {worst}", f"  {high}: {best}")]
    shape = ", ".join(f'"{axis}": n' for axis in rubric)
    return "\n".join([f"Score the draft on each axis, in whole numbers from {low} to {high}. Earlier conversations and the new message come before it.", "", *axes, "", "Length is no fault. Answer with this JSON and nothing else:", "{" + shape + "}"])


def precedent(items: Column, opening: str = "opening_text", reply: str = "first_reply_text", similarity: str | None = "similarity") -> Column:
    """The retrieved conversations as numbered blocks; similarity None leaves that out, so that it doesn't sway a judge."""
    head = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.format_string("] similarity %.3f", x[similarity]) if similarity else F.lit("]"))
    block = F.transform(items, lambda x, i: F.concat_ws("\n", head(x, i), F.concat(F.lit("Customer: "), x[opening]), F.concat(F.lit("Reply: "), x[reply])))
    return F.when(F.size(items) > 0, F.array_join(block, "\n\n")).otherwise("[nothing similar]")


def classify_prompt(text: Column) -> Column:
    return F.concat(F.lit("Customer: "), text, F.lit("\nLabel:"))


def reply_prompt(text: Column, intent: Column, items: Column) -> Column:
    return F.concat_ws("\n", precedent(items), F.lit(""), F.concat(F.lit("[new] "), intent), F.concat(F.lit("Customer: "), text), F.lit("Reply:"))


def judge_prompt(text: Column, reply: Column, items: Column) -> Column:
    return F.concat_ws("\n", precedent(items, similarity=None), F.lit(""), F.lit("[new]"), F.concat(F.lit("Customer: "), text), F.concat(F.lit("Draft: "), reply), F.lit("Scores:"))
