"""Every query that SQL can express, against DuckDB."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from oracle import connect, rows  # noqa: E402

from abacora.plans.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, con):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_pushdown_and_pruning(spark, sf_dir):
    plan = QUERIES["scan_filter_project"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", ["anti_unseen_pool", "contamination_semi_join", "recommend_core", "topic_progress", "overlap_join_top3", "theta_topic_resolve", "concept_argmax", "near_dup_pairs_jaccard", "source_match_errors"])
def test_no_cartesian_product(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    if name != "contamination_semi_join":  # that one crosses chunks with one row of keys
        assert "BroadcastNestedLoopJoin" not in plan
