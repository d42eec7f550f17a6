"""Parent-pointer graphs of sessions (E01-E06) and lookups along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadlake import views as v
from threadlake.operators import extract
from threadlake.operators.ancestors import NODES_SQL, above_sql, eligible, longest, nearest_ancestor, pointers, recursive
from threadlake.queries import query
from threadlake.session import written


def edges(messages: DataFrame) -> DataFrame:
    """Nodes with whether they are roots (no parent, or one that isn't there) and leaves (no child)."""
    nodes = eligible(messages).select("session_id", "message_uuid", "parent_uuid", "seq")
    known = nodes.select("session_id", F.col("message_uuid").alias("parent_uuid"), F.lit(True).alias("has_parent"))
    parents = nodes.filter("parent_uuid IS NOT NULL").groupBy("session_id", F.col("parent_uuid").alias("message_uuid")).agg(F.count("*").alias("children"))
    out = nodes.join(known, ["session_id", "parent_uuid"], "left").join(parents, ["session_id", "message_uuid"], "left")
    return out.select(
        "session_id", "message_uuid", "parent_uuid", F.col("has_parent").isNull().alias("is_root"), F.col("children").isNull().alias("is_leaf"), F.coalesce("children", F.lit(0)).alias("children")
    )


@query(
    "e02_dag",
    v.with_views(
        """SELECT m.session_id, m.message_uuid, m.parent_uuid, p.message_uuid IS NULL AS is_root, c.n IS NULL AS is_leaf, coalesce(c.n, 0) AS children
FROM nodes m LEFT JOIN nodes p ON m.session_id = p.session_id AND m.parent_uuid = p.message_uuid
LEFT JOIN (SELECT session_id, parent_uuid, count(*) AS n FROM nodes WHERE parent_uuid IS NOT NULL GROUP BY 1, 2) c ON m.session_id = c.session_id AND m.message_uuid = c.parent_uuid""",
        NODES_SQL,
    ),
)
def e02_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(v.threads(spark, sf_dir))


def depths(messages: DataFrame) -> DataFrame:
    """Each node's number of nodes from its root, which counts 1, and the root.

    After k rounds every pointer skips 2**k nodes. A cycle has no root; its nodes are cut off after as many steps as the
    largest session has nodes, with a null root and depth 0.
    """
    nodes = eligible(messages)
    state = written(pointers(nodes).withColumns({"depth": F.lit(1), "root": F.when(F.col("up").isNull(), F.col("node"))}), "depths")
    span, most = 1, longest(nodes)
    while span < most:
        above = state.select("session_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("root2"))
        climbed = state.filter("up IS NOT NULL").join(above, ["session_id", "up"]).select(
            "session_id", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("root2").alias("root")
        )
        state = written(state.filter("up IS NULL").unionByName(climbed), "depths")
        span *= 2
        if not state.filter("up IS NOT NULL").limit(1).count():
            break
    return state.select("session_id", "node", F.when(F.col("root").isNull(), 0).otherwise(F.col("depth")).alias("depth"), "root")


WALK_SQL = f"""{NODES_SQL}, walk AS (
  SELECT session_id, message_uuid AS node, 1 AS depth, message_uuid AS root, ts, seq FROM nodes WHERE parent_uuid IS NULL OR parent_uuid NOT IN (SELECT message_uuid FROM nodes)
  UNION ALL SELECT m.session_id, m.message_uuid, w.depth + 1, w.root, m.ts, m.seq FROM nodes m JOIN walk w ON m.session_id = w.session_id AND m.parent_uuid = w.node)"""


@query("e04_depths", recursive("SELECT session_id, node, depth, root FROM walk", WALK_SQL))
def e04_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depths(v.threads(spark, sf_dir))


def linearised(messages: DataFrame, policy: str = "deepest", leaves: DataFrame | None = None) -> DataFrame:
    """Each session's path from the root to one leaf, with positions from 1.

    The leaf is the deepest (of equal ones the latest by ts, then seq), by the policy latest_ts the latest, or the one
    that `leaves` (session_id, message_uuid) names; one that isn't there has no path. A leaf above which is a
    cycle counts as depth 0, and its path ends where it would repeat; where no node is a leaf, any may be chosen.
    """
    nodes = eligible(messages).select("session_id", "message_uuid", F.col("message_uuid").alias("node"), "parent_uuid", "ts", "seq", "role")
    if leaves is None:
        found = edges(messages).select("session_id", F.col("message_uuid").alias("node"), "is_leaf")
        late = [F.coalesce("ts", F.lit(0)), F.col("seq")]
        if policy == "deepest":
            found, late = found.join(depths(messages), ["session_id", "node"]), [F.col("depth"), *late]
        chosen = nodes.join(found, ["session_id", "node"]).groupBy("session_id").agg(F.max_by("node", F.struct("is_leaf", *late)).alias("node"))
    else:
        chosen = nodes.select("session_id", "node").join(leaves.toDF("session_id", "node"), ["session_id", "node"], "left_semi")
    state = written(pointers(nodes).join(chosen.withColumn("steps", F.lit(0)), ["session_id", "node"], "left"), "path")
    span, most = 1, longest(nodes)
    while span < most:  # after k rounds the first 2**k nodes from the leaf have their number of steps
        marks = state.filter("steps IS NOT NULL AND up IS NOT NULL").groupBy("session_id", F.col("up").alias("node")).agg((F.min("steps") + span).alias("mark"))
        above = state.select("session_id", F.col("node").alias("up"), F.col("up").alias("up2"))
        state = state.join(above, ["session_id", "up"], "left").join(marks, ["session_id", "node"], "left")
        state = written(state.select("session_id", "node", F.col("up2").alias("up"), F.coalesce("steps", "mark").alias("steps")), "path")
        span *= 2
        if not state.filter("up IS NOT NULL").limit(1).count():
            break
    path = state.filter("steps IS NOT NULL").drop("up")
    last = path.groupBy("session_id").agg(F.max("steps").alias("last"))
    out = path.join(last, "session_id").join(nodes, ["session_id", "node"])
    return out.select("session_id", "message_uuid", (F.col("last") - F.col("steps") + 1).alias("position"), "role")


@query(
    "e05_linearised",
    recursive(
        """SELECT session_id, message_uuid, position, role FROM up JOIN nodes USING (session_id, message_uuid)""",
        WALK_SQL,
        """chosen AS (SELECT session_id, arg_max(node, depth * 1000000000000000 + ts * 100000 + seq % 100000) AS message_uuid FROM walk WHERE node NOT IN (SELECT parent_uuid FROM nodes WHERE parent_uuid IS NOT NULL) GROUP BY 1),
up AS (SELECT w.session_id, w.node AS message_uuid, w.depth AS position FROM walk w JOIN chosen c ON w.session_id = c.session_id AND w.node = c.message_uuid
  UNION ALL SELECT u.session_id, n.parent_uuid, u.position - 1 FROM up u JOIN nodes n ON n.message_uuid = u.message_uuid AND n.session_id = u.session_id WHERE u.position > 1)""",
    ),
)
def e05_linearised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linearised(v.threads(spark, sf_dir))


@query("j08_user_above", recursive("SELECT message_uuid, ancestor FROM a", NODES_SQL, above_sql("a", "role = 'assistant'", "user", 6)))
def j08_user_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each message of the assistant the nearest user's message above it in the graph, within six steps."""
    nodes = eligible(v.threads(spark, sf_dir))
    found = nearest_ancestor(nodes, F.col("role") == "user", 6).withColumnRenamed("node", "message_uuid")
    return found.join(nodes.filter("role = 'assistant'"), ["session_id", "message_uuid"], "left_semi").select("message_uuid", "ancestor")


def _role_before(column: str, role: str) -> Column:
    order = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(F.col("role") == role, F.col(column)), ignorenulls=True).over(order)


def _role_after(column: str, role: str, within: int) -> Column:
    order = W.partitionBy("session_id").orderBy("seq").rowsBetween(1, within)
    return F.first(F.when(F.col("role") == role, F.col(column)), ignorenulls=True).over(order)


@query(
    "j09_correction_context",
    v.with_views(
        f"""SELECT message_uuid, rejected, clarification FROM (SELECT *,
  last_value(CASE WHEN role = 'assistant' THEN message_uuid END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rejected,
  first_value(CASE WHEN role = 'user' THEN message_uuid END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS clarification FROM messages)
WHERE {extract.USER_SQL} AND length(text) < 500 AND {extract.sql_has('text', extract.CORRECTION)}""",
        v.MESSAGES_SQL,
    ),
)
def j09_correction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each correction the assistant's message before it and the user's next one within five."""
    m = v.messages(spark, sf_dir)
    both = m.withColumn("rejected", _role_before("message_uuid", "assistant")).withColumn("clarification", _role_after("message_uuid", "user", 5))
    found = extract.user_texts(both).filter((F.length("text") < 500) & extract.has(F.col("text"), extract.CORRECTION))
    return found.select("message_uuid", "rejected", "clarification")


@query(
    "w02_escalation_chain",
    v.with_views(
        f"""SELECT message_uuid, coalesce(lag(bad) OVER (PARTITION BY session_id ORDER BY seq), false) AS after_correction, length(text) * 2 < lag(length(text)) OVER (PARTITION BY session_id ORDER BY seq) AS shrinking
FROM (SELECT *, length(text) BETWEEN 5 AND 1500 AND {extract.sql_has('text', extract.MODEL_CORRECTION)} AS bad FROM messages WHERE role = 'user')""",
        v.MESSAGES_SQL,
    ),
)
def w02_escalation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the user's message before was a correction, and whether messages shrink by more than half."""
    u = v.messages(spark, sf_dir).filter("role = 'user'")
    order = W.partitionBy("session_id").orderBy("seq")
    bad = F.length("text").between(5, 1500) & extract.has(F.col("text"), extract.MODEL_CORRECTION)
    return u.withColumn("bad", bad).select(
        "message_uuid",
        F.coalesce(F.lag("bad").over(order), F.lit(False)).alias("after_correction"),
        (F.length("text") * 2 < F.lag(F.length("text")).over(order)).alias("shrinking"),
    )


@query(
    "w04_first_prompt",
    v.with_views("SELECT session_id, message_uuid, text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM messages WHERE role = 'user') WHERE n = 1", v.MESSAGES_SQL),
)
def w04_first_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's first user message, without sorting sessions."""
    u = v.messages(spark, sf_dir).filter("role = 'user'")
    return u.groupBy("session_id").agg(F.min_by("message_uuid", "seq").alias("message_uuid"), F.min_by("text", "seq").alias("text"))


@query(
    "w07_outcome_window",
    """SELECT event_id, CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 1 THEN 'useless' ELSE 'useful' END AS outcome
FROM events""",
)
def w07_outcome_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of the next three turns shows a bad sign."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 3)
    bad = F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(order)
    return v.table(spark, sf_dir, "events").select("event_id", F.when(bad == 1, "useless").otherwise("useful").alias("outcome"))


@query(
    "w09_carried_state",
    "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS carried FROM events",
)
def w09_carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that the latest setting event of a stream left in force."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return v.table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(order).alias("carried"))


@query(
    "w10_islands",
    """SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM events)
GROUP BY 1, 2""",
)
def w10_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream cut into islands at header events."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(order).cast("long")
    return v.table(spark, sf_dir, "events").withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "w11_recent_streak",
    """SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS recent_errors FROM events""",
)
def w11_recent_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the last five events of a stream were of one kind."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return v.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(order), F.lit(0)).cast("long").alias("recent_errors"))
