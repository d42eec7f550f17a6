"""Paths of branching sessions, and chains longer than any fixed bound."""

import pytest

from threadlake.operators import graph
from threadlake.session import ensure_checkpoint_dir

BRANCHES = {  # session: (node, parent, ts)
    "deep": [("a", None, 1), ("b", "a", 2), ("c", "b", 3), ("d", "c", 4), ("x", "a", 5), ("y", "x", 6)],
    "roots": [("a", None, 1), ("b", "a", 2), ("c", "gone", 3)],
    "tie": [("a", None, 1), ("b", "a", 2), ("c", "a", 3)],
    "ring": [("a", "b", 1), ("b", "a", 2), ("c", "b", 3)],
}


def linear(df):
    paths = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.position)):
        assert r.position == len(paths.setdefault(r.session_id, "")) + 1
        paths[r.session_id] += r.message_uuid
    return paths


@pytest.fixture
def branches(spark):
    ensure_checkpoint_dir(spark)
    rows = [(s, n, p, ts, k, "user") for s, nodes in BRANCHES.items() for k, (n, p, ts) in enumerate(nodes)]
    return spark.createDataFrame(rows, "session_id string, message_uuid string, parent_uuid string, ts long, seq long, role string")


def test_linearised_branches(spark, branches):
    assert linear(graph.linearised(branches)) == {"deep": "abcd", "roots": "ab", "tie": "ac", "ring": "abc"}
    assert linear(graph.linearised(branches, "latest_ts")) == {"deep": "axy", "roots": "c", "tie": "ac", "ring": "abc"}
    leaves = spark.createDataFrame([("deep", "x"), ("tie", "none")], "session_id string, message_uuid string")
    assert linear(graph.linearised(branches, leaves=leaves)) == {"deep": "ax"}


def test_depths_of_long_chain(spark):
    ensure_checkpoint_dir(spark)
    n = 20_000
    chain = spark.range(n).selectExpr("'s' AS session_id", "string(id) AS message_uuid", "IF(id > 0, string(id - 1), NULL) AS parent_uuid", "id AS ts", "id AS seq", "'user' AS role")
    found = graph.depths(chain)
    assert found.filter("root = '0' AND depth = bigint(node) + 1").count() == n
    assert graph.linearised(chain).filter("position = bigint(message_uuid) + 1").count() == n


def test_graph_without_side_chains_and_with_the_last_record(spark):
    rows = [("s", "a", None, 1, "user", False), ("s", "b", "a", 2, "assistant", False), ("s", "b", "x", 3, "assistant", False), ("s", "c", "b", 4, "user", True), ("s", "d", "c", 5, "user", None)]
    m = spark.createDataFrame([(*r[:3], r[3], *r[3:]) for r in rows], "session_id string, message_uuid string, parent_uuid string, ts long, seq long, role string, is_sidechain boolean")
    got = {r.message_uuid: (r.parent_uuid, r.is_root, r.is_leaf, r.children) for r in graph.edges(m).collect()}
    assert got == {"a": (None, True, True, 0), "b": ("x", True, True, 0), "d": ("c", True, True, 0)}  # d's parent is a side-chain


ABOVE = {  # session: (node, parent, role)
    "branch": [("a", None, "assistant"), ("b", "a", "user"), ("c", "b", "user"), ("d", "a", "user"), ("e", "d", "assistant"), ("f", "e", "user")],
    "far": [("a", None, "assistant"), *((f"n{k}", f"n{k - 1}" if k else "a", "user") for k in range(9))],
    "ring": [("a", "b", "user"), ("b", "a", "user"), ("c", "b", "user")],
    "gone": [("a", "missing", "user")],
}


def test_nearest_ancestor(spark):
    ensure_checkpoint_dir(spark)
    rows = [(s, n, p, k, k, role) for s, nodes in ABOVE.items() for k, (n, p, role) in enumerate(nodes)]
    nodes = spark.createDataFrame(rows, "session_id string, message_uuid string, parent_uuid string, ts long, seq long, role string")
    from pyspark.sql import functions as F

    def found(hops):
        return {(r.session_id, r.node): (r.ancestor, r.hop) for r in graph.nearest_ancestor(nodes, F.col("role") == "assistant", hops).collect()}

    branch = {("branch", n): x for n, x in {"b": ("a", 1), "c": ("a", 2), "d": ("a", 1), "e": ("a", 2), "f": ("e", 1)}.items()}
    assert found(None) == branch | {("far", f"n{k}"): ("a", k + 1) for k in range(9)}
    assert found(6) == branch | {("far", f"n{k}"): ("a", k + 1) for k in range(6)}
    assert found(1) == {k: x for k, x in found(None).items() if x[1] == 1}
