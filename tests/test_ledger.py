"""External calls go out once: two actions, a run that ends halfway, a task that is tried again."""

import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators import calls

REQUESTS = "id long, model string, system string, prompt string, variant int"


def counted(folder, fail=()):
    """A stand-in model that leaves a file for each call, whatever process makes it."""
    folder = str(folder)

    def call(model, system, prompt):
        with open(f"{folder}/{prompt}-{os.urandom(6).hex()}", "w"):
            pass
        if prompt in fail:
            raise calls.Denied(prompt)
        return f"{prompt}!"

    return call


def sent(folder):
    return sorted(n.rpartition("-")[0] for n in os.listdir(folder))


@pytest.fixture
def asked(spark):
    rows = [(i, "gemini-a" if i % 2 else "llama-b", None, f"p{i % 6}", 0) for i in range(12)]
    return spark.createDataFrame(rows, REQUESTS), spark.createDataFrame([], calls.CACHE)


def test_two_actions_send_once(asked, tmp_path):
    requests, cache = asked
    out, fresh = calls.complete(requests, cache, counted(tmp_path), gap=0)
    assert out.count() == 12 and {r["response"] for r in out.collect()} == {f"p{i}!" for i in range(6)}
    assert fresh.count() == fresh.count() == 6 and sent(tmp_path) == [f"p{i}" for i in range(6)]
    assert all(r["created_at"] is not None and r["variant"] == 0 for r in fresh.collect())


def test_a_lost_run_is_resumed(spark, asked, tmp_path):
    requests, cache = asked
    at, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    at.mkdir()
    with pytest.raises(Exception, match="p3"):
        calls.complete(requests, cache, counted(at, fail=("p3",)), ledger, gap=0)
    first = sent(at)
    known = {r["prompt"] for r in calls.answered(spark, ledger).collect()}
    assert "p3" not in known and known <= set(first) and [r for r in calls.in_doubt(spark, ledger).collect()]
    out, fresh = calls.complete(requests, cache, counted(at), ledger, gap=0)
    again = sent(at)
    assert {r["id"]: r["response"] for r in out.collect()} == {i: f"p{i % 6}!" for i in range(12)}
    assert {p: again.count(p) for p in known} == dict.fromkeys(known, 1) and set(again) == {f"p{i}" for i in range(6)}
    assert fresh.count() == 6 - len(known) and calls.in_doubt(spark, ledger).count() == 0
    out, fresh = calls.complete(requests, cache, lambda *a: 1 / 0, ledger, gap=0)
    assert fresh.count() == 0 and out.where("response is null").count() == 0 and sent(at) == again


def test_replay_from_a_settled_ledger(spark, asked, tmp_path):
    requests, cache = asked
    at, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    at.mkdir()
    assert calls.answered(spark, ledger).count() == 0 and calls.settle(spark, ledger) == 0
    calls.complete(requests, cache, counted(at), ledger, gap=0)
    assert calls.settle(spark, ledger) == 6 and calls.settle(spark, ledger) == 0
    assert sorted(os.listdir(ledger)) == ["cache"] and calls.answered(spark, ledger).count() == 6
    assert calls.complete(requests, calls.answered(spark, ledger))[0].where("response is null").count() == 0
    assert calls.complete(requests, cache, ledger=ledger)[0].where("response is null").count() == 0
    with pytest.raises(calls.CacheMiss):
        calls.complete(requests.withColumn("variant", F.lit(1)), cache, ledger=ledger)
    calls.complete(requests.withColumn("variant", F.lit(1)), cache, counted(at), ledger, gap=0)
    assert calls.settle(spark, ledger) == 6 and sent(at) == sorted([f"p{i}" for i in range(6)] * 2)


def test_a_task_that_is_tried_again_asks_for_the_rest(tmp_path):
    """What a second attempt does: batches with an answer are passed over, half-written ones aren't."""
    made = []
    ask = lambda k: lambda: made.append(k) or calls.pa.table({"key": [k], "vector": [[1.0]]}, schema=calls._VECTOR)
    ledger = f"file:{tmp_path}"
    assert [calls._once(ledger, "r", k, [k], ask(k)) for k in "abab"] == [1, 1, 0, 0] and made == ["a", "b"]
    with pytest.raises(ZeroDivisionError):
        calls._once(ledger, "r", "c", ["c"], lambda: 1 / 0)
    assert calls._once(ledger, "r", "c", ["c"], ask("c")) == 1 and made == ["a", "b", "c"]
    assert sorted(os.listdir(tmp_path / "answers/r")) == ["a.parquet", "b.parquet", "c.parquet"]


def test_embeddings_are_resumed(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"t{i % 50}") for i in range(100)] + [(200, None)], "id long, text string").repartition(3)
    cache = spark.createDataFrame([], calls.VECTORS)
    at, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(at)

    def encode(said, bad=()):
        if set(said) & set(bad):
            raise RuntimeError("lost")
        for t in said:
            with open(f"{at}/{t}-{os.urandom(6).hex()}", "w"):
                pass
        return [[3.0, 4.0] for _ in said]

    with pytest.raises(Exception, match="lost"):
        calls.embed(texts, cache, "m", lambda said: encode(said, ("t7",)), 2, batch=4, ledger=ledger)
    known = {r["key"] for r in calls.answered(spark, ledger, calls.VECTORS).collect()}
    out, fresh = calls.embed(texts, cache, "m", encode, 2, batch=4, ledger=ledger)
    assert out.where("vector is not null").count() == 100 and out.count() == 101 and fresh.count() == 50 - len(known)
    assert sent(at) == sorted(f"t{i}" for i in range(50))
    assert calls.settle(spark, ledger, calls.VECTORS) == 50
    assert calls.embed(texts, calls.answered(spark, ledger, calls.VECTORS), "m", lambda said: 1 / 0, 2)[1].count() == 0
