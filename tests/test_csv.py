"""Records put together from splits, against Spark's reader of whole files and Python's csv."""

import csv
import random

import pytest
from pyspark.sql import types as T

from threadloom.sources import io

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("more", T.StringType())])


@pytest.fixture
def small_splits(spark):
    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def content(r, n, end):
    """CSV text of n records whose fields hold breaks of all kinds, doubled quotes, commas, and nothing."""
    def field(of):
        text = "".join(r.choice(of) for _ in range(r.choice([0, 3, 12, 60])))
        quoted = any(c in text for c in '",\n\r') or r.random() < 0.2
        return ('"' + text.replace('"', '""') + '"' if quoted else text), text

    out, rows = ["id,text,more"], []
    for i in range(n):
        a, b = field('ab ,"\n\r\'é'), field('x,"\n')
        out.append(f"{i},{a[0]},{b[0]}")
        rows.append((i, a[1], b[1]))
        if r.random() < 0.1:
            out.append("")
    return end.join(out) + r.choice(["", end]), rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [40, 1500])
def test_same_as_one_task(spark, small_splits, tmp_path, split, end):
    r = random.Random(split + len(end))
    want = []
    for f in range(3):
        text, rows = content(r, 30, end)
        (tmp_path / f"{f}.csv").write_text(text, newline="", encoding="utf-8")
        with open(tmp_path / f"{f}.csv", newline="", encoding="utf-8") as at:
            read = [row for row in csv.reader(at) if row][1:]
        assert [(int(a), b, c) for a, b, c in read] == rows
        want += rows
    small_splits(split)
    got = io.read_csv(spark, str(tmp_path), SCHEMA)
    assert got.rdd.getNumPartitions() > 3
    assert sorted((x["id"], x["text"] or "", x["more"] or "") for x in got.collect()) == sorted(want)
    if end == "\n":  # Spark's reader of whole files takes the ends of records from the first one it sees
        whole = spark.read.csv(str(tmp_path), schema=SCHEMA, header=True, multiLine=True, quote='"', escape='"', lineSep="\n", mode="FAILFAST")
        assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_records_longer_than_splits(spark, small_splits, tmp_path):
    rows = [(1, "a\n" * 500, "x"), (2, "b", '"\n"' * 200), (3, "", "c")]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "te\nxt", "mo\n\nre"])
        w.writerows(rows)
    small_splits(150)
    assert sorted((x["id"], x["text"] or "", x["more"]) for x in io.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()) == rows
    assert io.csv_records(spark, str(tmp_path / "a.csv"), header=False).count() == 4


def test_what_does_not_fit_raises(spark, tmp_path):
    for name, text, match in (("a", 'id,text,more\n1,"open,x\n', "inside quotes"), ("b", "id,text,more\nx,y,z\n", "(?i)malformed"), ("c", "id,text,more\n1,y\n", "(?i)malformed")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=match):
            io.read_csv(spark, str(tmp_path / name), SCHEMA).collect()
    (tmp_path / "d").write_text("id,text,more\n")
    (tmp_path / "e").write_text("")
    assert io.read_csv(spark, [str(tmp_path / "d"), str(tmp_path / "e")], SCHEMA).count() == 0
