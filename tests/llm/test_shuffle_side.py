"""Where a table exceeds the bound of a broadcast, a shuffle join does the same: that side, forced on small tables."""

import pytest

import corpus_pipeline
from tapeloom.llm import common, embedding_dup, line_dedup, mixing, near_dup
from tapeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def shuffled(spark, monkeypatch):
    """A switch to it: tables are handed on unmarked, and the planner broadcasts none by itself; returns what they were."""
    passed = []

    def switch():
        for module in (near_dup, line_dedup, mixing, embedding_dup, corpus_pipeline):
            monkeypatch.setattr(module, "fitting", lambda df: passed.append(df) or common.fitting(df, size=0))
        for name in THRESHOLDS:
            spark.conf.set(name, "-1")
        return passed

    yield switch
    for name in THRESHOLDS:
        spark.conf.unset(name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_minhash_near_dup", "op9_mixing", "op11_embedding_near_dup"])
def test_queries_give_the_same_rows(spark, shuffled, name):
    want = rows(QUERIES[name](spark, SF))
    passed = shuffled()
    got = QUERIES[name](spark, SF)
    assert rows(got) == want and want
    assert passed or name == "op11_embedding_near_dup"  # without crowded buckets it has no such table
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_stage_keeps_the_same_rows(spark, shuffled):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = rows(corpus_pipeline.near_dedup(spark, docs, SF))
    passed = shuffled()
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert rows(got) == want and 0 < len(want) < docs.count()
    assert len(passed) >= 2 and "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
