"""Forests by doubling, against a walk."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import forest

START = dt.datetime(2017, 10, 31, 22, tzinfo=dt.UTC)


def walked(rows):
    """id -> (thread_id, root_kind, depth, branch_id, first_inbound, its depth, children) by a walk in preorder."""
    known = {r[0]: r for r in rows}
    parent = {i: p if p in known else None for i, p, _, _ in rows}
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)
    out = {}
    for root in kids.get(None, []):
        kind = "orphan" if known[root][1] is not None else "customer_root" if known[root][2] else "brand_root"
        stack, leaves = [(root, 0, None, None)], 0
        while stack:
            i, depth, first, at = stack.pop()
            if first is None and known[i][2]:
                first, at = i, depth
            out[i] = (root, kind, depth, leaves, first, at, len(kids.get(i, [])))
            leaves += i not in kids
            stack += [(k, depth + 1, first, at) for k in sorted(kids.get(i, []), key=lambda k: (known[k][3], k), reverse=True)]
    for i in parent:
        if i not in out:
            seen = [i]
            while parent[seen[-1]] not in seen:
                seen.append(parent[seen[-1]])
            out[i] = (min(seen[seen.index(parent[seen[-1]]) :]), "cycle", -1, 0, None, None, len(kids.get(i, [])))
    return out


def built(spark, rows):
    df = spark.createDataFrame([(i, p, b, START + dt.timedelta(minutes=m)) for i, p, b, m in rows], "id long, parent long, inbound boolean, ts timestamp")
    return {r["id"]: (r["thread_id"], r["root_kind"], r["depth"], r["branch_id"], r["first_inbound"], r["first_inbound_depth"], r["n_children"]) for r in forest.build(df.repartition(3)).collect()}, df


@pytest.mark.parametrize("seed", range(3))
def test_same_as_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, 9999, r.randrange(300), r.randrange(max(0, i - 5), i + 1), r.randrange(i + 1)]), r.random() < 0.4, r.randrange(5)) for i in range(300)]
    want = walked(rows)
    got, df = built(spark, rows)
    assert got == want and any(k[1] == "cycle" for k in want.values())
    paths = {x["id"]: x for x in forest.rooted(df).collect()}
    for i, x in paths.items():
        assert (x["thread_id"], x["root_kind"], x["depth"]) == want[i][:3] and (x["path"] is None) == (x["depth"] < 0)
        if x["path"]:
            assert x["path"][-1] == i and x["path"][0] == x["thread_id"] and len(x["path"]) == x["depth"] + 1 and (len(x["path"]) == 1 or x["path"][-2] == rows[i][1])


def test_a_chain_and_a_star(spark):
    rows = [(0, None, False, 0)] + [(i, i - 1, i == 1500, i) for i in range(1, 2000)] + [(10_000 + i, 700, True, 7 * i % 1000) for i in range(2000)]
    got, _ = built(spark, rows)
    assert got == walked(rows)


def test_repeated_ids_raise(spark):
    for rows in ([(1, None, True, 0), (1, 2, True, 1), (2, 1, True, 2)], [(None, None, True, 0)]):
        with pytest.raises(ValueError, match="repeat or are null"):
            built(spark, rows)


def test_running_sums(spark):
    r = random.Random(9)
    rows = [(i, r.choice([1, 1, 1, None, 2]), r.randrange(9), r.randrange(-3, 4)) for i in range(400)]
    out = forest.running(spark.createDataFrame(rows, "id long, g int, at int, v long"), "g", ["at", "id"], "v", "before").collect()
    assert len(out) == 400
    for x in out:
        assert x["before"] == sum(v for i, g, at, v in rows if g == x["g"] and (at, i) < (x["at"], x["id"]))


def test_steps_leave_one_folder(spark):
    state = spark.range(100).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit(1).alias("n"))
    out = forest.climb(state, {"n": F.col("n") + F.col("a_n")})
    folder = os.path.dirname(out.made.removeprefix("file:"))
    before = os.listdir(folder)
    assert {x["id"]: x["n"] for x in out.collect()} == {i: i + 1 for i in range(100)}
    again = forest.climb(state, {"n": F.col("n") + F.col("a_n")})
    assert len(os.listdir(folder)) == len(before) + 1
    forest.release(again)
    assert len(os.listdir(folder)) == len(before)
    assert built(spark, [])[0] == {}
