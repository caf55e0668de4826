"""Draws by thresholds and quantiles by brackets, against sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import metrics, sampling


def lot(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("border", [10_000, 40, 1])
def test_first_by_lot(spark, monkeypatch, border):
    monkeypatch.setattr(sampling, "BORDER_ROWS", border)
    r = random.Random(1)
    quota = {"big": 700, "all": 500, "more": 9999, "none": 0, None: 33, "one": 1}
    rows = [(i, s, quota[s], "x") for i, s in enumerate(r.choice(["big"] * 6 + ["all", "more", "none", None, "one"]) for _ in range(3000))]
    quota["all"] = sum(x[1] == "all" for x in rows)
    rows = [(i, s, quota[s], "x") for i, s, _, _ in rows]
    got = sampling.first_by_lot(spark.createDataFrame(rows, "id long, s string, q long, x string"), ["s"], "q", sampling.lot(7, F.col("id")))
    assert got.columns == ["id", "s", "q", "x"]
    want = [i for s, q in quota.items() for i in sorted((x[0] for x in rows if x[1] == s), key=lambda i: lot(7, i))[:q]]
    assert sorted(x["id"] for x in got.collect()) == sorted(want)
    assert sampling.first_by_lot(spark.createDataFrame([], "id long, q long"), ["id"], "q", F.lit("a")).count() == 0


@pytest.mark.parametrize("border", [10_000, 2])
def test_short_oversample_by_hand(spark, monkeypatch, border):
    monkeypatch.setattr(sampling, "BORDER_ROWS", border)
    r = random.Random(3)
    rows = [(i, r.choice("aab") + ("" if i % 3 else "x"), r.choice([1, 2, 9, 9, 9, None])) for i in range(600)] + [(1000 + i, "few short", 1 if i < 2 else 9) for i in range(90)] + [(2000 + i, "few long", 9 if i < 3 else 1) for i in range(90)] + [(3000, "tiny", 1)]
    want = []
    for s in {x[1] for x in rows}:
        order = lambda x: lot(42, x[0])
        few, many = (sorted((x for x in rows if x[1] == s and (x[2] is not None and x[2] < 5) == k), key=order) for k in (True, False))
        first = few[:4] + many[:36]
        rest = sorted(few[4:] + many[36:], key=order)
        want += [x[0] for x in (first + rest)[:40]]
    got = sampling.short_oversample(spark.createDataFrame(rows, "id long, s string, w int"), "id", "s", "w", 40)
    assert sorted(x["id"] for x in got.collect()) == sorted(want) and got.columns == ["id", "s", "w"]


@pytest.mark.parametrize("held", [10_000, 3])
@pytest.mark.parametrize("kind", ["uniform", "ties", "wide", "one"])
def test_quantiles(spark, monkeypatch, kind, held):
    """Few values held and a poor sketch make many rounds; results don't change."""
    monkeypatch.setattr(metrics, "SORTED_VALUES", held)
    if held < 100:
        monkeypatch.setattr(metrics, "ACCURACY", 20)
        monkeypatch.setattr(metrics, "ASIDE", 0.05)
    r = np.random.default_rng(5)
    x = {"uniform": r.random(2000), "ties": r.choice([0.0, 1.0, 1.0, 1.0, 2.5, -3.0], 2000), "wide": r.normal(size=500) * 10.0 ** r.integers(-200, 200, 500), "one": np.full(50, 7.25)}[kind]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    at = [0.0, 0.1, 0.5, 0.501, 0.9, 1.0]
    got = metrics.quantiles(rows, "v", at)
    assert np.allclose(got, np.quantile(x, at), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    assert metrics.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
    with pytest.raises(ValueError, match="from 0 to 1"):
        metrics.quantiles(spark.range(3), "id", [50])
    assert metrics.quantiles(spark.range(5), "id", [0.5, 0.125]) == [2.0, 0.5]
