"""Whole runs of an agent and the baselines, by a stand-in model, and the summaries of stages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom import __main__ as cli
from threadloom.operators import answering, calls, survey

CLASSIFY, REPLY = ("llama-x", "label"), ("gemini-x", "write")


def model(folder):
    folder = str(folder)

    def call(name, system, prompt):
        with open(f"{folder}/{name}-{os.urandom(5).hex()}", "w"):
            pass
        if name == "llama-x":
            return "billing dispute" if "charged" in prompt else "App_Bug." if "crash" in prompt else "no idea"
        return f" reply to {prompt.splitlines()[-2]} "

    return call


def sent(folder, name):
    return sum(x.startswith(name) for x in os.listdir(folder))


@pytest.fixture
def tables(spark):
    messages = spark.createDataFrame([(1, "it does crash", [1.0, 0.0]), (2, "I was charged", [1.0, 0.0]), (3, "hm", [0.0, 1.0]), (4, "crash, my lawyer says", [1.0, 0.0])], "query_id long, text string, qv array<float>")
    pool = spark.createDataFrame([(10, [1.0, 0.0], "o10", "r10"), (11, [0.8, 0.6], "o11", "r11"), (12, [0.0, 1.0], "o12", "r12")], "item_id long, cv array<float>, opening_text string, first_reply_text string")
    return messages, pool, spark.createDataFrame([], calls.CACHE)


def test_a_run(spark, tables, tmp_path):
    messages, pool, cache = tables
    at, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    at.mkdir()
    with pytest.raises(calls.OverBudget, match="8 calls"):
        answering.run(messages, pool, cache, CLASSIFY, REPLY, model(at), ledger, most=7, gap=0)
    assert not os.listdir(at)
    out = answering.run(messages, pool, cache, CLASSIFY, REPLY, model(at), ledger, k=2, gap=0)
    got = {r["query_id"]: r for r in out.collect()}
    assert {i: (r["intent"], r["parse_ok"], r["decision"]) for i, r in got.items()} == {1: ("app_bug", True, "auto"), 2: ("billing_dispute", True, "escalate"), 3: ("other", False, "auto"), 4: ("app_bug", True, "escalate")}
    assert got[1]["reply"] == "reply to Customer: it does crash" and got[2]["reply"] is None and not got[4]["reply_generated"]
    assert [x["item_id"] for x in got[1]["retrieved"]] == [10, 11] and got[3]["top_similarity"] == 1.0
    assert (sent(at, "llama"), sent(at, "gemini")) == (4, 2)
    near = answering.retrieved(messages.select("query_id", "qv"), pool, 2)
    plan = answering.preflight(messages, near, calls.answered(spark, ledger), CLASSIFY, REPLY, True).first()
    assert (plan["classify_misses"], plan["reply_misses"], plan["reply_unknown"], plan["exact"]) == (0, 2, 0, True)
    again = answering.run(messages, pool, cache, CLASSIFY, REPLY, None, ledger, k=2, most=0)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))
    with pytest.raises(calls.CacheMiss):
        answering.run(messages, pool, cache, CLASSIFY, REPLY, None, ledger, k=2, force_reply=True)
    forced = answering.run(messages, pool, cache, CLASSIFY, REPLY, model(at), ledger, k=2, force_reply=True, gap=0)
    assert forced.where("reply is null").count() == 0 and (sent(at, "llama"), sent(at, "gemini")) == (4, 4)


def test_instructions_hold_what_they_are_given():
    text = answering.classify_instructions({"a": "first", "b": "second"})
    assert "- a: first\n- b: second" in text and set(answering.GLOSSES) == set(cli.INTENTS)
    assert all(f"- {i}: " in answering.classify_instructions() for i in cli.INTENTS)
    assert "Acme" in answering.reply_instructions("Acme")
    judge = answering.judge_instructions({"x": ("q?", "bad", "good")}, 0, 9)
    assert "x: q?\n  0: bad\n  9: good" in judge and judge.endswith('{"x": n}')
    assert answering.judge_instructions().endswith('{"groundedness": n, "correctness": n, "tone": n}')


def test_agent_and_baselines_from_files(spark, tables, tmp_path, capsys):
    messages, pool, _ = tables
    messages.write.parquet(f"{tmp_path}/messages")
    pool.write.parquet(f"{tmp_path}/pool")
    spark.createDataFrame([(20 + i, [1.0, 0.0], "app_bug", f"b{i}") for i in range(5)] + [(30, [0.0, 1.0], "other", "hm")], "item_id long, cv array<float>, label string, text string").write.parquet(f"{tmp_path}/bank")
    own = ["--messages", f"{tmp_path}/messages", "--pool", f"{tmp_path}/pool"]
    assert cli.main(["agent", *own, "--ledger", f"{tmp_path}/ledger"]) == 1 and "stopped: 8 calls" in capsys.readouterr().err
    assert cli.main(["agent", *own, "--ledger", f"{tmp_path}/ledger", "--max-live-calls", "99"]) == 1 and "not in the cache" in capsys.readouterr().err
    assert cli.main(["agent", *own, "--ledger", f"{tmp_path}/ledger", "--diagnose"]) == 0 and "p50=1.000" in capsys.readouterr().out
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert cli.main(["baselines", *own, "--bank", f"{tmp_path}/bank", "--out-dir", f"{tmp_path}/out"]) == 0
    rows = [json.loads(x) for f in sorted((tmp_path / "out" / "knn_golden").glob("*.json")) for x in f.read_text().splitlines()]
    assert {r["query_id"]: (r["intent"], r["reply"]) for r in rows} == {1: ("app_bug", "r10"), 2: ("app_bug", "r10"), 3: ("app_bug", "r12"), 4: ("app_bug", "r10")}
    assert "majority" in capsys.readouterr().out


def test_prefixes_and_residuals(spark):
    rows = [(i, "acme", "Please DM us your details now ok then") for i in range(6)] + [(i + 10, "acme", "Restart the app and clean every file, thanks") for i in range(3)] + [(20, "beta", "hello"), (21, "gone", "hello")]
    replies = spark.createDataFrame(rows, "id long, author_id string, text string")
    brands = spark.createDataFrame([("acme",), ("beta",)], "author_id string")
    got = [tuple(r) for r in survey.prefixes(replies, brands, 2, 1).orderBy("author_id").collect()]
    assert [(a, n, d, r, c) for a, n, d, r, _, c, _ in got] == [("acme", 9, 2, 1, 6), ("beta", 1, 1, 1, 1)] and got[0][6] == pytest.approx(600 / 9)
    shown = survey.residuals(replies, shown=2).collect()
    assert len(shown) == 4 and {r["deflection"] for r in shown} == {True, False} and all(r["normal"] for r in shown)


def test_taxonomy_summary(spark):
    rows = [(1, "a", "where is my song please"), (2, "a", "hi"), (3, "b", "wo ist das? bitte und danke, wir sind nicht da"), (4, None, None), (5, "b", "hi")]
    pool = spark.createDataFrame(rows, "conversation_id long, source string, opening_text string")
    cache = spark.createDataFrame([("hi",)], "t string").select(survey.T.cache_key(F.lit("m"), F.col("t")).alias("key"))
    one, parts = survey.taxonomy_summary(pool, pool.where("conversation_id > 1"), cache, "m")
    assert one.first().asDict() == {"pool": 5, "sampled": 4, "texts": 2, "cached": 1}
    got = {(r["part"], r["source"]): r for r in parts.collect()}
    assert set(got) == {("pool", None), ("sample", None), ("source", "a"), ("source", "b"), ("source", None)}
    assert (got["pool", None]["n"], got["pool", None]["non_english"], got["pool", None]["short"]) == (5, 1, 2) and got["source", "b"]["short_pct"] == 50
