"""Parent pointers of messages, and the nearest message above one that satisfies a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadlake import views as v
from threadlake.session import written


def eligible(messages: DataFrame) -> DataFrame:
    """Messages that are nodes of their session's graph: no side-chains, and of records that repeat a uuid the last."""
    own = messages.filter(F.col("message_uuid").isNotNull() & F.col("role").isin("assistant", "user", "system"))
    if "is_sidechain" in messages.columns:
        own = own.filter(~F.coalesce("is_sidechain", F.lit(False)))
    return last_written(own)


def last_written(messages: DataFrame) -> DataFrame:
    """Of records with the same uuid in a session the one that was written last."""
    order = W.partitionBy("session_id", "message_uuid").orderBy(F.desc("seq"))
    return messages.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def longest(nodes: DataFrame) -> int:
    """Nodes of the largest session: no path has more, so pointers that are left after as many steps are in a cycle."""
    return nodes.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def pointers(nodes: DataFrame, *more: str) -> DataFrame:
    """(session_id, node, up, ...): each node's parent, if that is a node."""
    ids = nodes.select("session_id", F.col("message_uuid").alias("parent_uuid"), F.col("message_uuid").alias("up"))
    return nodes.join(ids, ["session_id", "parent_uuid"], "left").select("session_id", F.col("message_uuid").alias("node"), "up", *more)


def nearest_ancestor(nodes: DataFrame, marked: Column, hops: int | None = None) -> DataFrame:
    """(session_id, node, ancestor, hop): the first node above each one for which `marked` holds, if it is at most `hops` above.

    Pointers double: after k rounds each knows the first marked one of its 2**k nearest ancestors and the node above these. Only nodes
    that have found nothing and have something above them take part in a round; what goes around a cycle is left out in the end.
    """
    state = pointers(nodes.withColumn("_marked", F.coalesce(marked, F.lit(False))), "_marked")
    parents = state.select("session_id", F.col("node").alias("up"), F.col("_marked").alias("hit"))
    state = state.join(parents, ["session_id", "up"], "left").select("session_id", "node", "up", F.when(F.col("hit"), F.col("up")).alias("ancestor"), F.when(F.col("hit"), 1).alias("hop"))
    state = written(state, "ancestors")
    span, most = 1, longest(nodes)
    while span < min(most, hops or most):
        still = F.col("ancestor").isNull() & F.col("up").isNotNull()
        above = state.select("session_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("ancestor").alias("found"), F.col("hop").alias("more"))
        climbed = state.filter(still).join(above, ["session_id", "up"]).select("session_id", "node", F.col("up2").alias("up"), F.col("found").alias("ancestor"), (F.col("more") + span).alias("hop"))
        state = written(state.filter(~still).unionByName(climbed), "ancestors")
        span *= 2
        if not state.filter(still).limit(1).count():
            break
    return state.filter(F.col("ancestor").isNotNull() & (F.col("hop") <= (hops or most))).select("session_id", "node", "ancestor", "hop")


def with_above(rows: DataFrame, nodes: DataFrame, marked: Column, name: str, hops: int | None = None) -> DataFrame:
    """`rows` (session_id, message_uuid, ...) with <name>_uuid and <name>_text of the nearest marked node above; null for none."""
    found = nearest_ancestor(nodes, marked, hops).select("session_id", F.col("node").alias("message_uuid"), F.col("ancestor").alias(f"{name}_uuid"))
    texts = nodes.select("session_id", F.col("message_uuid").alias(f"{name}_uuid"), F.col("text").alias(f"{name}_text"))
    return rows.join(found, ["session_id", "message_uuid"], "left").join(texts, ["session_id", f"{name}_uuid"], "left")


NODES_SQL = f"{v.THREADS_SQL}, nodes AS (SELECT * FROM threads WHERE NOT is_sidechain)"


def recursive(sql: str, *views: str) -> str:
    return v.with_views(sql, *views).replace("WITH", "WITH RECURSIVE", 1)


def above_sql(name: str, start: str, role: str, hops: int | None = None, table: str = "nodes") -> str:
    """`name` (message_uuid, ancestor): the nearest message of a role above those of `start`."""
    far = f" AND hop < {hops}" if hops else ""
    return f"""{name}_walk AS (SELECT message_uuid, parent_uuid AS up, 1 AS hop FROM {table} WHERE {start}
  UNION ALL SELECT w.message_uuid, n.parent_uuid, hop + 1 FROM {name}_walk w JOIN {table} n ON n.message_uuid = w.up WHERE n.role <> '{role}'{far}),
{name} AS (SELECT w.message_uuid, w.up AS ancestor FROM {name}_walk w JOIN {table} n ON n.message_uuid = w.up WHERE n.role = '{role}')"""
