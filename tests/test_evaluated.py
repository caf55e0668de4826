import json
import math

import pytest
from pyspark.sql import functions as F

from threadloom import __main__ as cli
from threadloom.functions import judging as J
from threadloom.operators import answering, calls, clusters, evaluation, forest, judging, labelling, metrics, sampling, survey, turns
from threadloom.sources import checks, io

GOOD = '{"groundedness": 4, "correctness": 5, "tone": 3}'


@pytest.mark.parametrize(
    "raw",
    [GOOD, f"```json\n{GOOD}\n```", f"```\n{GOOD}", f"Here: {GOOD} thanks", GOOD.replace("4", '" 4 "'), GOOD.replace("4", "4.0"), 'He said "{no" and "}" then ' + GOOD, '{"tone": 3, "groundedness": 4, "correctness": 5}', r'"\"{" ' + GOOD],
)
def test_scores_are_read(raw):
    assert J.read_scores(raw) == {"groundedness": 4, "correctness": 5, "tone": 3, "parse_ok": True}


@pytest.mark.parametrize(
    "raw",
    [None, "", "four", "[4, 5, 3]", "4", GOOD[:-1], '{"groundedness": 4}', GOOD.replace("}", ', "x": 1}'), *[GOOD.replace("4", x) for x in ("true", "4.5", '"four"', "0", "6", "-4", "null", "[4]", "1e999", "NaN", '"4.0"', '"²"')], 'Note: "{unclosed ' + GOOD],
)
def test_other_scores_are_not(raw):
    assert J.read_scores(raw) == {"groundedness": None, "correctness": None, "tone": None, "parse_ok": False}


def scores(spark, rows):
    return spark.createDataFrame([(s, i, r, *([x] * 3 if isinstance(x, int) or x is None else x), x is not None) for s, i, r, x in rows], "system string, conversation_id long, repeat int, groundedness int, correctness int, tone int, parse_ok boolean")


def test_judge_tables(spark):
    rows = scores(spark, [("agent", 1, 0, 4), ("agent", 1, 1, 4), ("agent", 2, 0, 3), ("agent", 2, 1, 4), ("agent", 3, 0, 1), ("agent", 3, 1, 3), ("agent", 4, 0, None), ("agent", 4, 1, 5), ("agent", 5, 0, 5), ("none", 1, None, None)])
    by = {r["system"]: r for r in judging.summary(rows).collect()}
    assert (by["agent"]["n_rows"], by["agent"]["n_parsed"], by["agent"]["n_failed"], by["none"]["mean_tone"]) == (9, 8, 1, None)
    one = {r["axis"]: r for r in judging.consistency(rows.where("system = 'agent'"), 2).collect()}["groundedness"]
    assert (one["n_compared"], one["mean_spread"], one["n_agreed"], one["worst_spread"], one["worst_id"]) == (3, 1.0, 1, 2, 3)
    with pytest.raises(ValueError, match="repeat"):
        judging.consistency(rows, 1)
    assert judging.of_system(rows, "none", 0).count() == 1
    with pytest.raises(ValueError, match="no rows"):
        judging.of_system(rows, "other")
    own = judging.of_system(rows, "agent", 0).where("parse_ok")
    same = {r["axis"]: (r["n"], r["kappa"], r["qw_kappa"], r["raw_agreement"]) for r in judging.agreement(own, own).collect()}
    assert same["tone"] == pytest.approx((4, 1.0, 1.0, 1.0))
    with pytest.raises(ValueError, match="without context"):
        judging.cases(own.withColumns({"reply": F.lit("x"), "text": F.lit("t")}), spark.createDataFrame([(1, "c")], "conversation_id long, retrieved string"))


def test_alignment_and_intervals(spark):
    golden = spark.createDataFrame([(i,) for i in (5, 1, 3)], "conversation_id long")
    good = golden.withColumn("p", F.lit(1))
    assert evaluation.aligned(golden, good).count() == 3
    for bad, said in ((good.where("conversation_id <> 1"), "no prediction"), (good.union(spark.createDataFrame([(9, 1)], good.schema)), "no golden"), (good.union(good), "repeat")):
        with pytest.raises(ValueError, match=said):
            evaluation.aligned(golden, bad)
    numbered = sampling.numbered(golden, "conversation_id", "pos").collect()
    assert sorted((r["conversation_id"], r["pos"]) for r in numbered) == [(1, 0), (3, 1), (5, 2)]
    pairs = spark.createDataFrame([(s, i, t, p if s == "x" else t) for s in "xy" for i, (t, p) in enumerate(zip("aabc", "abba", strict=True))], "system string, pos long, y_true string, y_pred string")
    table = {r["system"]: r for r in evaluation.intent_table(pairs, 4, 3, resamples=20).collect()}
    assert table["x"]["macro_f1"] == pytest.approx((0.5 + 2 / 3) / 3) and table["x"]["accuracy"] == 0.5
    assert (table["y"]["macro_f1"], table["y"]["accuracy"], table["y"]["high"]) == pytest.approx((1.0, 1.0, 1.0))
    assert table["x"]["low"] <= table["x"]["macro_f1"] <= table["x"]["high"]
    one = {r["system"]: r for r in evaluation.binary_table(pairs, 4, "c", resamples=20).collect()}["x"]
    assert (one["precision"], one["f1"], one["n_predicted"], one["support"]) == (0.0, 0.0, 0, 1)
    with pytest.raises(ValueError, match="no rows"):
        evaluation.checked(pairs.limit(0))
    with pytest.raises(ValueError, match="percentile"):
        evaluation.interval(pairs, evaluation.accuracy, 4, 5, high=97.5)


def test_corpus_and_answers(spark):
    sampled = spark.createDataFrame([(1, "a", None), (2, "b", True), (3, "c", False), (4, "d", True)], "conversation_id long, first_reply_text string, first_reply_orphan_part boolean")
    rows, counts = answering.corpus(sampled, spark.createDataFrame([(3,), (4,)], "conversation_id long"))
    assert [r["conversation_id"] for r in rows.collect()] == [1]
    assert tuple(counts.first()) == (4, 2, 2, 1, 1)
    messages = spark.createDataFrame([(1, "hello", "app_bug", [1.0, 0.0]), (2, "I want a refund", "app bug", [1.0, 0.0])], "query_id long, text string, raw_intent string, qv array<double>")
    pool = spark.createDataFrame([(10, [1.0, 0.0], "o", "r10"), (11, [0.0, 1.0], "o", "r11")], "item_id long, cv array<double>, opening_text string, first_reply_text string")
    drafts = spark.createDataFrame([(1, " hi "), (2, "no")], "query_id long, reply string")
    got = {r["query_id"]: r for r in answering.answer(messages, pool, drafts, k=3).collect()}
    assert (got[1]["decision"], got[1]["reply"], got[1]["top_similarity"], [x["item_id"] for x in got[1]["retrieved"]]) == ("auto", "hi", 1.0, [10, 11])
    assert (got[2]["decision"], got[2]["reply"], got[2]["reply_generated"], got[2]["triggered_signals"]) == ("escalate", None, False, ["cancellation_or_refund"])
    assert {r["reply"] for r in answering.answer(messages, pool, drafts, force_reply=True).collect()} == {"hi", "no"}
    alone = answering.answer(messages, pool.limit(0), drafts).collect()
    assert all(r["retrieved"] == [] and r["top_similarity"] == 0.0 and "no_similar_precedent" in r["signals_by_family"]["similarity"] for r in alone)
    bank = spark.createDataFrame([(i, [math.cos(math.radians(a)), math.sin(math.radians(a))], label, t) for i, (t, label, a) in enumerate([("hello", "x", 0), ("b", "billing", 1), ("c", "billing", 2), ("d", "content", 3), ("e", "content", 4), ("f", "content", 5)])], "item_id long, cv array<double>, label string, text string")
    voted = answering.knn_answer(messages.where("query_id = 1"), bank, pool).first()
    assert (voted["intent"], voted["votes"], voted["reply"], voted["decision"]) == ("content", 3, "r10", "auto")
    with pytest.raises(ValueError, match="can vote"):
        answering.knn_answer(messages.where("query_id = 1"), bank, pool, vote_k=6)


def test_paced_calls():
    slept, now, tries = [], [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def call(model, system, prompt):
        tries.append(prompt)
        if prompt == "denied":
            raise calls.Denied("key")
        if prompt == "never" or len(tries) < 3:
            raise calls.Busy(7.0 if len(tries) == 2 else None)
        return prompt.upper()

    one = calls.paced(call, sleep, lambda: now[0])
    assert one("m", None, "a") == "A" and slept == [4.0, 7.0]
    assert one("m", None, "b") == "B" and slept[2:] == [4.0]
    with pytest.raises(calls.Denied):
        one("m", None, "denied")
    with pytest.raises(RuntimeError, match="busy"):
        one("m", None, "never")
    assert tries.count("never") == calls.TRIES and tries.count("denied") == 1
    assert [calls.waits(i) for i in range(6)] == [4, 8, 16, 32, 64, 64] and calls.waits(3, 1.5) == 1.5


def test_cache_and_budget(spark):
    rows = [(1, "gemini-a", None, "p", 0), (2, "gemini-a", "", "p", None), (3, "gemini-a", None, "p", 1), (4, "llama-b", "s", "q", 0)]
    requests = spark.createDataFrame(rows, "id long, model string, system string, prompt string, variant int")
    keys = {r["id"]: (r["key"], r["provider"]) for r in calls.asked(requests).collect()}
    assert keys[1] == keys[2] and keys[1][0] != keys[3][0] and keys[4][1] == "groq"
    cache = spark.createDataFrame([(keys[1][0], "m", None, "p", "said", 0, None)], calls.CACHE)
    assert tuple(calls.budget(requests, cache).first())[:3] == (3, 1, 2)
    with pytest.raises(calls.OverBudget):
        calls.budget(requests, cache, most=1)
    with pytest.raises(calls.CacheMiss):
        calls.complete(requests, cache)
    answered, fresh = calls.complete(requests, cache, lambda m, s, p: f"{m}:{p}")
    assert {r["id"]: r["response"] for r in answered.where("id <> 3").collect()} == {1: "said", 2: "said", 4: "llama-b:q"}
    assert calls.misses(requests, cache.unionByName(fresh.where("model = 'llama-b'"))).count() == 1
    with pytest.raises(Exception, match="unknown model"):
        calls.asked(requests.withColumn("model", F.lit("other"))).collect()
    plan = spark.createDataFrame([(1, True, "auto"), (2, True, "escalate"), (3, False, None), (4, True, "auto")], "query_id long, cached boolean, decision string")
    has = spark.createDataFrame([(1, True), (4, False)], "query_id long, cached boolean")
    assert calls.agent_budget(plan, has).first().asDict() == {"n": 4, "classify_misses": 1, "reply_misses": 1, "reply_unknown": 1, "skipped": 1, "total": 3, "exact": False}


def test_embeddings_come_once(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abc"), (4, None)], "id long, text string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    out, fresh = calls.embed(texts, cache, "m", lambda ts: [[3.0, 4.0 * len(t) / 2] for t in ts], 2)
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert got[1] == got[2] == pytest.approx([0.6, 0.8]) and got[4] is None and math.hypot(*got[3]) == pytest.approx(1)
    assert fresh.count() == 2 and calls.embed(texts, fresh, "m", lambda ts: 1 / 0, 2)[0].where("vector is not null").count() == 3
    with pytest.raises(Exception, match="other than 3"):
        calls.embed(texts, cache, "m", lambda ts: [[1.0]] * len(ts), 3)[0].collect()


def test_clusters(spark):
    points = [(i, [math.cos(a), math.sin(a)], f" text\n {i}", "s") for i, a in enumerate([0, 0.01, 0.02, 0.03, 2, 2.01, 2.02, 4, 4.01])]
    rows = spark.createDataFrame(points, "id long, cv array<double>, text string, source string")
    table = {r["k"]: r for r in clusters.sweep(rows.select("id", "cv"), 2, 4, starts=3).collect()}
    assert (table[3]["smallest"], table[3]["median"], table[3]["largest"]) == (2, 3, 4)
    assert table[2]["inertia"] > table[3]["inertia"] > table[4]["inertia"] and max(table, key=lambda k: table[k]["silhouette"]) == 3
    own, _ = clusters.cluster(rows.select("id", "cv"), 3, starts=2)
    by_hand, at = [], {r["id"]: (r["cv"], r["cluster"]) for r in own.collect()}
    for i, (x, c) in at.items():
        mean = {}
        for d in {v[1] for v in at.values()}:
            far = [math.dist(x, y) for j, (y, e) in at.items() if e == d and j != i]
            mean[d] = sum(far) / len(far)
        a, b = mean.pop(c), min(mean.values())
        by_hand.append((b - a) / max(a, b))
    assert clusters.silhouette(own) == pytest.approx(sum(by_hand) / len(by_hand))
    page = clusters.exemplar_text(clusters.exemplars(own.select("id", "cluster").join(rows, "id"), 2), 3)
    assert page.count("## Cluster") == 3 and "2 of 4 shown." in page and "All 2 shown." in page and "- `7` [s] text 7" in page


def test_labelling(spark):
    pool = spark.createDataFrame([(i, "t", "secret") for i in range(40)], "conversation_id long, text string, intent string")
    first = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "conversation_id long, intent string")
    drawn = labelling.relabel(pool, first, 9)
    assert drawn.columns == ["conversation_id", "text"] and sorted(r[0] % 3 for r in drawn.collect()) == [0] * 3 + [1] * 3 + [2] * 3
    assert [r[0] for r in drawn.collect()] == [r[0] for r in labelling.relabel(pool.repartition(3), first, 9).collect()]
    with pytest.raises(ValueError, match="answers"):
        labelling.assert_blind(pool)
    with pytest.raises(ValueError, match="unknown"):
        labelling.relabel(pool.where("conversation_id > 3"), first, 9)
    both, orphans = labelling.joined(first, spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (4, "a"), (99, "c")], "conversation_id long, intent string"))
    assert orphans == 1 and labelling.agreement(both, "abc").first()["accuracy"] == 0.25
    assert [tuple(r) for r in labelling.disagreements(both, "abc").collect()] == [("b", "a", 2, [1, 4]), ("c", "a", 1, [2])]
    assert [tuple(r) for r in labelling.disagreements(both, "abc", shown=1).collect()] == [("b", "a", 2, [1]), ("c", "a", 1, [2])]
    assert [tuple(r) for r in labelling.involved(both, "abc").orderBy("rank").collect()] == [("a", 3, 1), ("b", 2, 2), ("c", 1, 3)]


def test_disagreements_keep_every_id(spark):
    both = spark.range(2500).selectExpr("id", "'b' as y_true", "'a' as y_pred")
    (row,) = labelling.disagreements(both, "abc").collect()
    assert (row["n"], row["ids"]) == (2500, list(range(2500)))


def test_survey(spark):
    rows = [(1, True, "c", 1, "@acmeplus help"), (2, False, "acme", 1, "Please DM us"), (3, False, "beta", 1, "restart the app and clean every file"), (4, True, "c", 2, "@ACME hi"), (5, False, "beta", 2, "1/2 hello there you"), (6, False, "acme", None, "lost"), (7, False, "beta", 3, "fine")]
    t = spark.createDataFrame(rows, "id long, inbound boolean, author_id string, conversation_id long, text string")
    got = {r["author_id"]: r for r in survey.report(t, 2).collect()}
    assert (got["beta"]["conversations"], got["beta"]["median_tweets"], got["beta"]["answered_pct"]) == (3, 2.0, None)
    assert (got["acme"]["answered_pct"], got["acme"]["deflection_pct"], got["acme"]["redirect_pct"]) == (50.0, 100.0, 100.0)
    assert got["beta"]["multipart_pct"] == pytest.approx(100 / 3)
    assert tuple(survey.several_brands(t.where("not inbound and conversation_id is not null")).first()) == (3, 1, pytest.approx(100 / 3))


def test_names_in_texts(spark):
    """Equality instead of a search for each name: the same pairs, whatever the names hold, and no nested loop."""
    names = ["Acme", "acme", "Acme Air", "x@y", "é1", "LONGNAME", "a"]
    texts = ["@acme air is late", "@ACMEplus", "mail x@y now", "@x@y hi", "@@a", "@É1", "acme", "@longnam", None, "", "@", "see @longname/@Acme\n@b", "a@\nAcme"]
    inbound, brands = spark.createDataFrame(list(enumerate(texts)), "conversation_id long, text string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "author_id string")
    out = survey.addressed(inbound, brands)
    assert sorted(map(tuple, out.collect())) == sorted((n, i) for n in names for i, t in enumerate(texts) if t and f"@{n.lower()}" in t.lower())
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and survey.addressed(inbound, brands.limit(0)).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    schema = spark.createDataFrame([], "a long, b string").schema
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert sorted(map(tuple, io.read_strict(spark, str(path), schema).collect())) == [(1, "x"), (2, None)]
    path.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_strict(spark, str(path), schema).collect()
    with pytest.warns(UserWarning, match="1 lines are no records"):
        assert [r["a"] for r in io.read_latest(spark, str(path), schema, "a").collect()] == [1]
    assert [r["value"] for r in io.skipped(spark, str(path), schema, "a").collect()] == ['{"a": ']
    for name, b in (("0", "old"), ("1", "new")):
        (tmp_path / "several").mkdir(exist_ok=True)
        (tmp_path / "several" / f"{name}.jsonl").write_text(f'{{"a": 1, "b": "{b}"}}\n' + '{"a": 2}\n' * (9 if b == "old" else 1))
    assert {r["a"]: r["b"] for r in io.read_latest(spark, str(tmp_path / "several"), schema, "a").collect()} == {1: "new", 2: None}
    log = tmp_path / "log.jsonl"
    for i in range(3):
        io.append_record(str(log), {"a": i // 2, "b": f"é{i}"})
    assert sorted(map(tuple, io.read_latest(spark, str(log), schema, "a").collect())) == [(0, "é1"), (1, "é2")]
    df = spark.createDataFrame([(1, "x")], schema)
    io.write_rows(df, str(tmp_path / "out"), "json")
    io.write_rows(df, str(tmp_path / "out"), "json", append=True)
    assert io.read_strict(spark, str(tmp_path / "out"), schema).count() == 2
    io.write_report(str(tmp_path / "r.json"), {"t": df, "n": 3})
    assert json.loads((tmp_path / "r.json").read_text()) == {"t": [{"a": 1, "b": "x"}], "n": 3}
    merged = io.merge_scores(spark.createDataFrame([(2, "old"), (1, "old")], schema), spark.createDataFrame([(2, "new"), (3, "new")], schema), ["a"])
    assert list(map(tuple, merged.collect())) == [(1, "old"), (2, "new"), (3, "new")]
    with pytest.raises(ValueError, match="repeat"):
        io.merge_scores(df, df.union(df), ["a"])
    pages = [tmp_path / f"clusters_k{k}.md" for k in (5, 6)]
    for k, p in enumerate(pages):
        p.write_text(f"# page\n- `{k}` [s] x\n- `7` [s] y\n`9` no\n")
    assert sorted(r["id"] for r in io.read_exemplars(spark, list(map(str, pages))).collect()) == [0, 1, 7]
    with pytest.raises(FileNotFoundError):
        io.read_exemplars(spark, [])
    pages[0].write_text("nothing")
    with pytest.raises(ValueError, match="no exemplars"):
        io.read_exemplars(spark, [str(pages[0])])


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (2, None)], "k long, v long")
    checks.expect_unique(df, "k")
    checks.expect_same_count(df, df, "copy")
    checks.expect_sum(df, "v", 2)
    checks.expect_disjoint(df, df.withColumn("k", F.col("k") + 5), "k")
    assert checks.join_one_to_one(df, df.where("k = 1").select("k", F.lit(7).alias("w")), "k").where("w is null").count() == 1
    for broken in (lambda: checks.expect_unique(df.union(df), "k"), lambda: checks.expect_unique(df, "v"), lambda: checks.expect_all(df, F.col("v") > 0, "v is positive"), lambda: checks.expect_within(df, df.where("k = 1"), "k"), lambda: checks.expect_disjoint(df, df, "k"), lambda: checks.expect_sum(df, "v", 3), lambda: checks.expect_same_count(df, df.limit(1), "x"), lambda: checks.join_one_to_one(df, df.limit(1), "k", complete=True)):
        with pytest.raises(checks.BrokenRule):
            broken()


def test_command_line(spark, tmp_path, capfd):
    csv = tmp_path / "tweets.csv"
    csv.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,c,True,Tue Oct 31 22:10:47 +0000 2017,"help, my\nmusic",2,\n2,acme,False,Tue Oct 31 22:11:47 +0000 2017,@c restart the app then sign in again /AB,,1\n')
    p = lambda name: str(tmp_path / name)
    # The session is the tests' own, so stages are run on it.
    for line in (f"ingest --csv {csv} --out {p('t')}", f"threads --tweets {p('t')} --out {p('f')}", f"conversations --threads {p('f')} --out {p('c')}", f"sample --tweets {p('t')} --conversations {p('c')} --brand acme --out {p('s')}", f"survey --tweets {p('t')} --conversations {p('c')}"):
        a = cli.parser().parse_args(line.split())
        cli.STAGES[a.stage][0](spark, a)
    row = spark.read.parquet(p("s")).first()
    assert (row["n_turns"], row["opening_text"], row["first_reply_signature"]) == (2, "help, my\nmusic", "AB")
    assert "acme" in capfd.readouterr().out


def test_paths_and_edges(spark):
    rows = [(1, None, 0), (2, 1, 1), (3, 2, 2), (7, 8, 0), (8, 9, 0), (9, 8, 0), (5, 404, 1)]
    t = spark.createDataFrame([(i, p, True, m) for i, p, m in rows], "id long, parent long, inbound boolean, m long").withColumn("ts", F.timestamp_seconds("m")).drop("m")
    assert {r["id"]: r["path"] for r in forest.paths(t, [3, 1, 7, 8, 5]).collect()} == {1: [1], 3: [1, 2, 3], 7: [9, 8, 7], 8: [9, 8], 5: [5]}
    with pytest.raises(KeyError):
        forest.paths(t, [3, 99])
    late = t.withColumn("ts", F.when(F.col("id") == 2, F.timestamp_seconds(F.lit(-5))).otherwise(F.col("ts")))
    with pytest.warns(UserWarning, match="older"):
        assert forest.warn_backwards(late).first()["backwards"] == 1


def test_first_values_that_are_there(spark):
    """Who wrote a turn and when come from its first tweet that has them; its signature is the last up to its end."""
    at = [None, "2017-01-01 00:00:02", "2017-01-01 00:00:03"]
    rows = [(1, 0, i, None if i == 0 else "acme", i != 0 and None, ts, f"part {i}", sig, 3, i, None) for i, (ts, sig) in enumerate(zip(at, ["AB", "CD", None], strict=True))]
    cleaned = spark.createDataFrame(rows, "conversation_id long, merge_group long, id long, author_id string, inbound boolean, ts string, text string, signature string, n_parts long, position long, part_number int")
    upto = turns.Window.partitionBy("conversation_id", "merge_group").orderBy("position")
    got = turns.turns(cleaned.withColumn("signed", F.last("signature", ignorenulls=True).over(upto))).first()
    assert (got["author_id"], got["created_at"], got["role"], got["agent_signature"]) == ("acme", at[1], "brand", "CD")


def test_signature_of_the_first_reply(spark):
    rows = [(1, 0, "customer", "help", None), (1, 1, "brand", "restart the app and sign in once more", None), (1, 2, "brand", "then clean every downloaded file again", "LS")]
    t = spark.createDataFrame(rows, "conversation_id long, turn_index int, role string, text string, agent_signature string")
    assert turns.first_reply(t).first()["agent_signature"] is None
    both = turns.first_reply(t, compat=True).first()
    assert (both["turn_index"], both["agent_signature"]) == (1, "LS")


def test_quotas_of_strata(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 2 if i < 8 else 9) for i in range(60)], "id long, s string, w int")
    quota = spark.createDataFrame([("a", 10), ("b", 20)], "stratum string, quota long")
    got = sampling.short_oversample(rows, "id", "s", "w", quota).collect()
    assert {s: (sum(r["s"] == s for r in got), sum(r["s"] == s and r["w"] < 5 for r in got)) for s in "ab"} == {"a": (10, 1), "b": (20, 2)}


def test_ranges_of_metrics(spark):
    one = metrics.confusion(spark.createDataFrame([("a", "a")], "y_true string, y_pred string"), metrics.labels(spark, "a"))
    with pytest.raises(ValueError, match="two labels"):
        metrics.kappa(one)
    with pytest.raises(ValueError, match="percentiles"):
        metrics.bootstrap(spark.createDataFrame([(0, 1.0)], "pos long, hit double"), 5, low=2.5)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_tweets(spark, "/nowhere/tweets.csv")
