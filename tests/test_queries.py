import json
import os

import pytest
from conftest import SF

from threadloom.plans import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def test_conversations_hold_whole_texts(spark):
    said = {(r["conv_id"], r["turn"]): " ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/conversations.parquet").where("text is not null").collect()}
    rows = QUERIES["nested_conversations"](spark, SF).collect()
    assert any(len(x) > 40 for x in said.values())
    for r in rows:
        for t in json.loads(r["turns"]):
            text = " ".join(t["text"].split())
            assert all(said.get((r["conversation_id"], i % 1000), "") in text for i in t["tweet_ids"])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
