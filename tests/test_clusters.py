"""k-means of many runs at once and silhouettes, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import clusters


def blobs(spark, n=90, size=5, seed=1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(4, size)) * 3
    x = [(middle[i % 4] + r.normal(size=size)).tolist() for i in range(n)]
    return np.array(x), spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, cv array<double>").repartition(5)


def silhouettes_by_hand(x, of):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, c in enumerate(of):
        mean = {d: apart[i, of == d].sum() / max(1, (of == d).sum() - (d == c)) for d in set(of)}
        own = mean.pop(c)
        out.append(0.0 if (of == c).sum() == 1 or not mean else (min(mean.values()) - own) / max(min(mean.values()), own))
    return np.array(out)


@pytest.mark.parametrize("stripe", [8192, 40, 7])
def test_silhouettes_by_hand(spark, monkeypatch, stripe):
    """Several assignments of the same rows at once; one row alone, an unused number, and the same point twice."""
    monkeypatch.setattr(clusters, "STRIPE_ROWS", stripe)
    x, _ = blobs(spark)
    x[5] = x[6]
    of = np.stack([np.arange(90) % 4, np.r_[3, np.zeros(89, int)], np.arange(90) // 30, np.zeros(90, int)], 1)
    rows = spark.createDataFrame([(i, v.tolist(), c.tolist()) for i, (v, c) in enumerate(zip(x, of, strict=True))], "id long, cv array<double>, clusters array<int>").repartition(3)
    got = {(r["id"], r["at"]): (r["cluster"], r["s"]) for r in clusters.silhouettes(rows, [4, 5, 3, 1]).collect()}
    assert len(got) == 360
    for at in range(4):
        want = silhouettes_by_hand(x, of[:, at])
        assert [got[i, at][0] for i in range(90)] == of[:, at].tolist()
        assert np.allclose([got[i, at][1] for i in range(90)], want, atol=1e-9)


def test_silhouette_of_named_clusters(spark):
    x, rows = blobs(spark)
    named = rows.withColumn("cluster", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    got = {r["id"]: (r["cluster"], r["s"]) for r in clusters.silhouette_values(named).collect()}
    assert {got[i][0] for i in range(90)} == {"a", "b", None}
    assert np.allclose([got[i][1] for i in range(90)], silhouettes_by_hand(x, np.arange(90) % 3))
    with pytest.raises(ValueError, match="two clusters"):
        clusters.silhouette(rows.withColumn("cluster", F.lit(1)))
    with pytest.raises(ValueError, match="two rows"):
        clusters.silhouette(rows.withColumn("cluster", F.col("id")))


def lloyd_by_hand(x, centres, steps, least):
    for step in range(steps + 1):
        apart = ((x[:, None] - centres[None]) ** 2).sum(2)
        own, cost = apart.argmin(1), apart.min(1).sum()
        moved = np.array([x[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centres)])
        if step == steps or ((moved - centres) ** 2).sum() <= least:
            return centres, cost
        centres = moved


def test_runs_take_their_own_steps(spark, monkeypatch):
    """Each run ends as if it were alone, and a step is one scan for all of them."""
    x, rows = blobs(spark)
    scans, step, starts = [], clusters._step, {}
    monkeypatch.setattr(clusters, "_step", lambda v, runs: scans.append(len(runs)) or step(v, runs))
    spread = clusters._spread_out
    monkeypatch.setattr(clusters, "_spread_out", lambda a, k, draw: starts.setdefault(k, []).append(spread(a, k, draw)) or starts[k][-1])
    best = clusters.fit(rows, [2, 4, 7], starts=5, tol=1e-6)
    assert scans[0] == 15 and len(scans) < 40 and sorted(scans, reverse=True) == scans
    for k, run in best.items():
        every = [lloyd_by_hand(x, c, 300, 1e-6 * x.var(0).mean()) for c in starts[k]]
        assert run.cost == pytest.approx(min(c for _, c in every)) and run.start == int(np.argmin([round(c, 9) for _, c in every]))
        assert np.allclose(run.centres, every[run.start][0])
    own = {r["id"]: r["clusters"] for r in clusters.assign(rows, [best[2].centres, best[7].centres]).collect()}
    assert all(own[i] == [int(((v - best[k].centres) ** 2).sum(1).argmin()) for k in (2, 7)] for i, v in enumerate(x))


def test_few_and_equal_vectors(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id long, cv array<double>")
    best = clusters.fit(rows, [3], starts=2)[3]
    assert best.cost == 0 and {r["cluster"] for r in clusters.cluster(rows, 3, starts=1)[0].collect()} == {0}
    table = clusters.sweep(rows.union(spark.createDataFrame([(9, [5.0, 5.0])], rows.schema)), 2, 3, starts=2).collect()
    assert [(r["k"], r["largest"]) for r in table] == [(2, 6), (3, 6)] and all(r["silhouette"] == pytest.approx(6 / 7) for r in table)
    with pytest.raises(ValueError, match="no vectors"):
        clusters.fit(rows.limit(0), [2])
