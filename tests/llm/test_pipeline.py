import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)


def ids_and_texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_by_row(spark):
    r = random.Random(31)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(60))
    a, b, c, d, e, f, g, h = (text() for _ in range(8))
    rows = [(1, a), (None, a), (None, b), (None, c), (2, d), (2, e), (3, d), (0, e + " more"), (None, f), (None, f + " end"), (5, g), (5, g), (6, h), (6, h + " end"), (7, ""), (7, "")]
    got = ids_and_texts(corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), ""))
    one_of = [x for x in got if x[1] in (f, f + " end")], [x for x in got if x[1] in (h, h + " end")]
    assert [len(x) for x in one_of] == [1, 1]
    rest = [x for x in got if x not in one_of[0] + one_of[1]]
    assert rest == sorted([(1, a), (None, b), (None, c), (2, d), (0, e + " more"), (5, g), (7, ""), (7, "")], key=str)


def test_leaks_by_row(spark, tmp_path):
    r = random.Random(32)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    item, a, b, c, d = text(30), text(60), text(60), text(60), text(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, b), (4, f"{c} {item} {c}"), (4, d), (5, item), (6, a)]
    got = corpus_pipeline.drop_benchmark_leaks(spark, table(spark, rows), str(tmp_path))
    assert ids_and_texts(got) == sorted([(None, b), (4, d), (6, a)], key=str)
    assert got.where(F.col("n_chars") != F.length("text")).count() == 0


def test_decontamination_stays_in_the_jvm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = corpus_pipeline.drop_benchmark_leaks(spark, docs, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" in plan and not any(node in plan for node in ("InArrow", "InPandas", "EvalPython"))
