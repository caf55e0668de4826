import datetime as dt
import hashlib
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import rules as R
from threadloom.functions import text as T
from threadloom.operators import forest, metrics, sampling, turns, vectors
from threadloom.sources import io

START = dt.datetime(2017, 10, 31, 22, tzinfo=dt.UTC)


def tweets(spark, rows):
    data = [(i, p, i_in, START + dt.timedelta(minutes=m)) for i, p, i_in, m in rows]
    return spark.createDataFrame(data, "id long, parent long, inbound boolean, ts timestamp")


def test_branches_and_leaves(spark):
    out = {r["id"]: r for r in forest.build(tweets(spark, [(10, None, True, 0), (11, 10, False, 2), (12, 10, False, 1), (13, 12, True, 3)])).collect()}
    assert {k: r["depth"] for k, r in out.items()} == {10: 0, 11: 1, 12: 1, 13: 2}
    assert {k: r["branch_id"] for k, r in out.items()} == {10: 0, 12: 0, 13: 0, 11: 1}
    assert {r["thread_id"] for r in out.values()} == {10} and out[10]["n_children"] == 2
    paths = {r["id"]: r["path"] for r in forest.rooted(tweets(spark, [(10, None, True, 0), (11, 10, False, 2), (12, 10, False, 1), (13, 12, True, 3)])).collect()}
    assert paths[13] == [10, 12, 13] and paths[10] == [10]
    assert {k for k, r in out.items() if r["is_leaf"]} == {11, 13}


def test_orphans_and_cycles(spark):
    out = {r["id"]: r for r in forest.build(tweets(spark, [(21, 99, True, 1), (22, 21, False, 2), (40, 41, True, 0), (41, 40, False, 1), (42, 41, True, 2), (43, None, True, 3), (50, 50, True, 0)])).collect()}
    assert [(out[i]["root_kind"], out[i]["depth"], out[i]["thread_id"]) for i in (21, 22)] == [("orphan", 0, 21), ("orphan", 1, 21)]
    assert out[21]["parent"] is None
    assert all((out[i]["root_kind"], out[i]["depth"], out[i]["thread_id"]) == ("cycle", -1, 40) for i in (40, 41, 42))
    assert out[50]["thread_id"] == 50 and out[43]["root_kind"] == "customer_root"


def test_conversations(spark):
    rows = [(20, None, False, 0), (21, 20, True, 1), (22, 21, False, 2), (23, 20, True, 3), (24, 23, False, 4), (30, None, False, 0), (31, 30, False, 1), (32, 31, True, 2), (33, 32, False, 3), (60, 99, True, 0), (61, 60, False, 1)]
    out = {r["id"]: (r["conversation_id"], r["conversation_source"], r["depth_in_conversation"]) for r in forest.assign(forest.build(tweets(spark, rows))).collect()}
    assert out[20] == (None, None, None) and out[22] == (21, "brand_broadcast", 1) and out[24] == (23, "brand_broadcast", 1)
    assert out[31][0] is None and out[33] == (32, "brand_broadcast_deep", 1)
    assert out[61] == (60, "orphan_customer", 1)


def posts(spark, rows):
    data = [(1, i, a or ("cust" if inb else "brand"), inb, p, START + dt.timedelta(minutes=m), t) for i, p, inb, m, t, a in rows]
    return spark.createDataFrame(data, "conversation_id long, id long, author_id string, inbound boolean, parent long, ts timestamp, text string")


def test_turns_merge_and_reorder(spark):
    first = (10, None, True, 0, "my music stopped", None)
    got = turns.turns(turns.clean(turns.merge_groups(posts(spark, [first, (11, 10, False, 2, "@116129 1: first half", None), (12, 10, False, 1, "@116129 2: second half /RH", None)])))).orderBy("turn_index").collect()
    assert [r["tweet_ids"] for r in got] == [[10], [11, 12]]
    assert got[1]["text"] == "@116129 first half second half" and got[1]["agent_signature"] == "RH" and got[1]["n_parts"] == 2
    other = turns.turns(turns.clean(turns.merge_groups(posts(spark, [first, (11, 10, False, 1, "1: a", None), (12, 10, False, 2, "2: b", "else")])))).count()
    assert other == 3


def test_first_reply_skips_deflection(spark):
    rows = [(10, None, True, 0, "help", None), (11, 10, False, 1, "Could you DM us your details? /LS", None), (12, 11, True, 2, "ok", None), (13, 12, False, 3, "Hold the power and volume buttons for ten seconds /CH", None)]
    r = turns.first_reply(turns.turns(turns.clean(turns.merge_groups(posts(spark, rows))))).first()
    assert (r["tweet_ids"], r["agent_signature"], r["turn_index"]) == ([13], "CH", 3)


def test_part_numbers(spark):
    texts = ["1: a", "2. b", "(1/3) c", "2 of 3 d", "@116129 1: e", "f", "24/7 g"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.part_number(F.col("t"))).collect()] == [1, 2, 1, 2, 1, None, None]


def test_pii_and_phrases(spark):
    yes = ["4111 1111 1111 1111", "917-565-3894", "__email__", "jane.doe@example.com"]
    no = ["£14.99", "1.0.69.323", "error 404 since 2017"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in df.select(R.has_pii(F.col("t"))).collect()] == [True] * 4 + [False] * 3
    row = spark.createDataFrame([("I want a refund, Idiotstagram", "other", 0.6)], "t string, i string, s double").select(R.signals(F.col("t"), F.col("i"), F.col("s")).alias("f")).select("f", R.reason(F.col("f")).alias("r")).first()
    assert row["f"] == ["cancellation_or_refund"] and row["r"] == R.REASONS["cancellation_or_refund"]


def test_phones_as_in_sql(spark):
    """A number one character after another match isn't seen, as SQL's matches hold the characters beside them."""
    import duckdb

    from threadloom.plans import catalogue

    texts = ['token = "946686402c9336462518b77"', "123456789 ,1234567890", "123456789,1234567890", "12345678\n917-565-3894\n", "+44 20 7946 0958", "917-565-3894", "x917-565-3894", "call (917) 565 3894.", "1234567890.5", "a\n9175653894\n", "", "-+1234567890", "123456789İ1234567890", "91@0a.İa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    want = [duckdb.execute(f"SELECT {catalogue._PII} FROM (SELECT ? AS text)", [t]).fetchone()[0] for t in texts]
    assert [r[0] for r in df.select(R.has_pii(F.col("t"))).collect()] == want
    assert not want[0] and want[1] and not want[2]


def test_parse_intent(spark):
    df = spark.createDataFrame([(x,) for x in (" 'Billing-dispute'. ", "The intent here is app_bug, sure", "app_bug or other", "nothing", "", "other")], "t string")
    assert [tuple(r[0]) for r in df.select(T.parse_intent(F.col("t"))).collect()] == [("billing_dispute", True), ("app_bug", True), ("other", False), ("other", False), ("other", False), ("other", True)]


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y_true string, y_pred string")
    m = metrics.confusion(pairs, metrics.labels(spark, "abcd"))
    report = {r["label"]: (r["precision"], r["recall"], round(r["f1"], 4)) for r in metrics.per_class(m).collect()}
    assert report["a"] == (0.5, 0.5, 0.5) and report["b"] == (0.5, 1.0, 0.6667) and report["c"] == (0.0, 0.0, 0.0)
    assert metrics.macro_f1(metrics.per_class(m)).first()["undefined_precision"] == "c,d"
    k = metrics.kappa(metrics.confusion(pairs, metrics.labels(spark, "abc"))).first()
    assert k["accuracy"] == 0.5 and abs(k["kappa"] - 0.2) < 1e-9
    q = spark.createDataFrame([("1", "1"), ("2", "3"), ("3", "3"), ("3", "1")], "y_true string, y_pred string")
    assert abs(metrics.kappa(metrics.confusion(q, metrics.labels(spark, "123"))).first()["qw_kappa"] - 2 / 7) < 1e-9
    with pytest.raises(Exception, match="not declared"):
        metrics.confusion(pairs, metrics.labels(spark, "ab")).collect()


def test_knn_ties(spark):
    corpus = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.6, 0.8]), (13, [1.0, 0.0])], "item_id long, cv array<float>")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qv array<float>")
    assert [r["item_id"] for r in vectors.top_k(query, corpus, 3).orderBy("rank").collect()] == [10, 13, 12]
    assert vectors.top_k(query, corpus, 9).count() == 4
    with pytest.raises(ValueError):
        vectors.top_k(query, corpus, 0)


def by_hand(queries, corpus, k, same=None):
    out = []
    dot = lambda a, b: reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b, strict=True), 0.0)  # noqa: E731  in order: sum() compensates
    for q, qv, qk in queries:
        near = sorted((-dot(qv, cv), c) for c, cv, ck in corpus if same is None or qk != ck)[:k]
        out += [(q, c, -s, rank + 1) for rank, (s, c) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("block", "sample"), [(1024, 16_384), (7, 16_384), (16, 5)])
def test_neighbours_by_hand(spark, monkeypatch, block, sample):
    """Clustered vectors of different lengths, copies that tie, excluded pairs; the same in small blocks and with a useless sample."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "ASK_BLOCK", block)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", sample)
    r = random.Random(4)
    middle = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    near = lambda i: [float(np.float32(x * (1 + i % 3) + r.gauss(0, 0.1))) for x in middle[i % 9]]
    corpus = [(i, near(i), r.choice([None, "a", "b"])) for i in range(300)]
    corpus += [(400 + i, corpus[5][1], "c") for i in range(40)] + [(500, [0.0] * 6, "a")]
    queries = [(i, near(i), r.choice([None, "a", "d"])) for i in range(50)] + [(60, corpus[5][1], "d"), (61, [0.0] * 6, "d")]
    q = spark.createDataFrame([(*x, 7) for x in queries] + [(99, None, "a", 7)], "query_id long, qv array<float>, qt string, row int").repartition(3)
    c = spark.createDataFrame([(*x, 8) for x in corpus] + [(600, None, "a", 8)], "item_id long, cv array<float>, ct string, cell int").repartition(3)
    for exclude in (None, ("qt", "ct")):
        got, share = vectors.neighbours(q, c, 4, exclude)
        rows = got.collect()
        assert sorted((x["query_id"], x["item_id"], x["similarity"], x["rank"]) for x in rows) == by_hand(queries, corpus, 4, exclude)
        assert all(x["row"] == 7 and x["cell"] == 8 and (exclude is None or x["qt"] != x["ct"]) for x in rows)
        pairs, compared = share.first()
        assert pairs == 52 * 341 and compared <= pairs


def test_few_pairs_are_compared(spark):
    """On clustered vectors most cells can't hold a neighbour."""
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(40, 32)), 50, 0) * 4 + r.normal(size=(2000, 32)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    near, share = vectors.neighbours(spark.createDataFrame(rows[::10], "query_id long, qv array<double>"), spark.createDataFrame(rows, "item_id long, cv array<double>"), 3)
    pairs, compared = share.first()
    assert near.where("rank = 1 and query_id <> item_id").count() == 0 and near.count() == 600 and compared < 0.3 * pairs
    empty = spark.createDataFrame([], "item_id long, cv array<double>, more string")
    assert vectors.top_k(spark.createDataFrame(rows[:3], "query_id long, qv array<double>"), empty, 3).count() == 0


def test_allocation(spark):
    def quotas(counts, total):
        return {r["stratum"]: r["quota"] for r in sampling.allocate(spark.createDataFrame(list(counts.items()), "stratum string, n long"), total).collect()}

    assert quotas({"brand_broadcast": 115, "customer_root": 27245, "orphan_broadcast": 34, "orphan_customer": 31}, 2000) == {"brand_broadcast": 8, "customer_root": 1987, "orphan_broadcast": 3, "orphan_customer": 2}
    assert quotas({"a": 50, "b": 50}, 3) == {"a": 2, "b": 1}
    with pytest.raises(Exception, match="more asked"):
        quotas({"a": 10, "b": 5}, 20)
    assert sampling.equal_shares({1: 2, 2: 100}, 20) == {1: 2, 2: 18}


def test_tweets_csv(spark, tmp_path):
    head = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
    good = head + '1,a,True,Tue Oct 31 22:10:47 +0000 2017,hello,2,\n2,b,False,Tue Oct 31 22:11:47 +0000 2017,"Hi ""there""!\nPlease DM us,\nwe can help.","4,5",1\n'
    (tmp_path / "a.csv").write_text(good)
    rows = {r["tweet_id"]: r for r in io.read_tweets(spark, str(tmp_path / "a.csv")).collect()}
    assert rows[2]["text"] == 'Hi "there"!\nPlease DM us,\nwe can help.' and rows[2]["response_tweet_id"] == "4,5" and rows[1]["in_response_to_tweet_id"] is None
    (tmp_path / "b.csv").write_text(head + "1,a,True,2017-10-31,x,,\n")
    with pytest.raises(ValueError, match="do not match"):
        io.read_tweets(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text(good + good.splitlines()[1] + "\n")
    with pytest.raises(AssertionError):
        io.read_tweets(spark, str(tmp_path / "c.csv"))


def test_bootstrap_of_any_metric(spark):
    rows = [(i, float(i % 3 == 0), float(i % 4)) for i in range(11)]
    pairs = spark.createDataFrame(rows, "pos long, hit double, weight double")
    scores = []
    for r in range(1000):
        drawn = [rows[int(hashlib.md5(f"42:{r}:{p}".encode()).hexdigest()[:8], 16) % 11] for p in range(11)]
        scores.append(sum(x[1] * x[2] for x in drawn) / max(sum(x[2] for x in drawn), 1.0))
    scores.sort()
    at = lambda q: scores[int(q * 999)] + (q * 999 - int(q * 999)) * (scores[int(q * 999) + 1] - scores[int(q * 999)])
    weighted = F.sum(F.col("hit") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1.0))
    got = metrics.bootstrap(pairs, metric=weighted, name="weighted").first()
    assert got["n"] == 11 and got["weighted"] == pytest.approx(sum(x[1] * x[2] for x in rows) / sum(x[2] for x in rows))
    assert (got["low"], got["high"]) == pytest.approx((at(0.025), at(0.975)))
