"""Searches in blocks of any size, with filters, and the plan that keeps k rows of each task."""

import pytest

from tests.util import assert_same
from threadlake.operators import search
from threadlake.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["a28_retrieval_metrics", "r02_bm25", "r03_search_facts", "r08_nearest", "r10_hybrid"])
def test_small_blocks(spark, sf, duck, monkeypatch, name):
    monkeypatch.setattr(search, "BLOCK", 300)
    assert_same(QUERIES[name](spark, sf), duck.execute(SQL[name]))


def test_each_task_keeps_its_own_best(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS query_id", "id AS item", "rand(1) AS x")
    from pyspark.sql import functions as F

    plan = search.top(rows, 3, F.col("x"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters(spark):
    rows = [(1, "/p/a", "ban", 5), (2, "/p/a", "goal", 9), (3, "/p/a/.worktrees/x", "ban", 9), (4, None, "ban", None)]
    df = spark.createDataFrame(rows, "id int, project_key string, kind string, ts int")
    ids = lambda **f: sorted(r.id for r in search.filtered(df, **f).collect())
    assert ids() == [1, 2, 3, 4]
    assert ids(cwd="/p/a/.worktrees/x") == [1, 2] and ids(cwd="/p/a/.worktrees/x", exact=True) == [3]
    assert ids(kinds=["ban"], since=6) == [3] and ids(since=0) == [1, 2, 3]


def test_merged_keeps_the_first_list(spark):
    lists = [spark.createDataFrame([(1, x, i) for i, x in enumerate(xs)], "query_id int, item int, position int") for xs in ([5, 3], [3, 9, 5, 7])]
    got = search.merged(*lists, "item", 3).orderBy("position").collect()
    assert [(r.item, r.position) for r in got] == [(5, 0), (3, 1), (9, 2)]
