"""Folds fed by the extraction rules, and short answers from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake import views as v
from threadlake.functions import text as t
from threadlake.operators import extract, facts, profiles
from threadlake.operators.ancestors import recursive
from threadlake.queries import query


def projected(found: DataFrame, messages: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Extractions (message_uuid, ...) folded by keys: how often, in how many sessions, first and last time."""
    at = messages.select("message_uuid", "session_id", "project_key", "ts", "seq")
    own = found.join(at, "message_uuid").select("session_id", "ts", *(x.alias(k) for k, x in keys.items()))
    return own.groupBy(*keys).agg(F.count("*").alias("times"), F.countDistinct("session_id").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _projected_sql(found: str, keys: str) -> str:
    return f"SELECT {keys}, count(*) AS times, count(DISTINCT session_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM ({found}) x JOIN messages USING (message_uuid) GROUP BY ALL"


_THING = "trim(rtrim(lower(trim(thing)), '.,;:!?')) AS thing, category, coalesce(clause, '') AS clause"


@query("g14_bans", v.with_views(_projected_sql(extract.bans_sql(), _THING), v.MESSAGES_SQL))
def g14_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bans that messages state, by thing, category and clause."""
    keys = {"thing": t.thing_key(F.col("thing")), "category": F.col("category"), "clause": F.coalesce("clause", F.lit(""))}
    return projected(extract.x09_bans(spark, sf_dir), v.messages(spark, sf_dir), keys)


@query(
    "g14_failed_attempts",
    v.with_views(
        f"""SELECT lower(attempt) AS attempt, project_key, count(*) AS times, min(ts) AS attempted_ts, arg_max(replaced_by, (seq, replaced_by)) FILTER (WHERE replaced_by IS NOT NULL) AS replaced_by,
  arg_max(reason, (seq, reason)) FILTER (WHERE reason IS NOT NULL) AS reason FROM ({extract.failed_sql()}) x JOIN messages USING (message_uuid) GROUP BY 1, 2""",
        v.MESSAGES_SQL,
    ),
)
def g14_failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts by attempt, in any case, and project: the first time, and the latest successor and reason that were given."""
    found = extract.x10_failed_attempts(spark, sf_dir).join(v.messages(spark, sf_dir).select("message_uuid", "project_key", "ts", "seq"), "message_uuid")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c)
    return found.groupBy(F.lower("attempt").alias("attempt"), "project_key").agg(F.count("*").alias("times"), F.min("ts").alias("attempted_ts"), latest("replaced_by"), latest("reason"))


def about(attempts: DataFrame, topic: str) -> DataFrame:
    """attempts whose name or reason holds a topic, in any case."""
    return attempts.filter(F.lower("attempt").contains(topic.lower()) | F.coalesce(F.lower("reason").contains(topic.lower()), F.lit(False)))


@query("f09_attempts_about", v.with_views(f"SELECT message_uuid, attempt, reason FROM ({extract.failed_sql()}) WHERE contains(lower(attempt), 'sql') OR coalesce(contains(lower(reason), 'sql'), false)", v.MESSAGES_SQL))
def f09_attempts_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    return about(extract.x10_failed_attempts(spark, sf_dir), "SQL").select("message_uuid", "attempt", "reason")


def active_goals(goals: DataFrame, now: Column) -> DataFrame:
    """Each project's open goal (active or blocked, once its age is accounted for) that was touched last; of equal ones the later stated."""
    state = facts.goal_status(F.col("status"), F.coalesce("last_progress_ts", "declared_ts"), now)
    open_ = goals.withColumn("state", state).filter(F.col("state").isin("active", "blocked"))
    best = F.struct(F.coalesce("last_progress_ts", "declared_ts"), "declared_ts", "goal")
    return open_.groupBy("project").agg(F.max_by(F.struct("goal", "state", "declared_ts", "last_progress_ts"), best).alias("g")).select("project", "g.*")


@query(
    "g07_active_goals",
    v.with_views(
        """SELECT project, goal, state, declared_ts, last_progress_ts FROM (SELECT *, CASE WHEN status = 'active' AND now - last_progress_ts > 60 * 86400 THEN 'abandoned' WHEN status = 'active' AND now - last_progress_ts > 30 * 86400 THEN 'paused'
  WHEN status = 'blocked' AND now - last_progress_ts <= 30 * 86400 THEN 'active' ELSE status END AS state FROM goals, (SELECT max(ts) AS now FROM messages)) WHERE state IN ('active', 'blocked')
QUALIFY row_number() OVER (PARTITION BY project ORDER BY last_progress_ts DESC, declared_ts DESC, goal DESC) = 1""",
        v.MESSAGES_SQL,
        f"""events AS (SELECT project_key AS project, text AS goal, nullif(status, 'active') AS hint, ts, seq FROM ({extract.GOALS_SQL}) JOIN messages USING (message_uuid)
  UNION ALL SELECT project_key, NULL, NULL, ts, seq FROM (SELECT DISTINCT message_uuid FROM ({extract.PROGRESS_SQL})) JOIN messages USING (message_uuid))""",
        facts.fold_goals_sql("events"),
    ),
)
def g07_active_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's active goal, from the goals that users state and the steps that the assistant reports."""
    m = v.messages(spark, sf_dir)
    at = m.select("message_uuid", F.col("project_key").alias("project"), "ts", "seq", "text")
    stated = extract.x11_goals(spark, sf_dir).join(at, "message_uuid").select("project", F.col("text").alias("goal"), F.nullif("status", F.lit("active")).alias("hint"), "ts", "seq")
    steps = extract.x12_goal_progress(spark, sf_dir).select("message_uuid").distinct().join(at, "message_uuid").select("project", F.lit(None).cast("string").alias("goal"), F.lit(None).cast("string").alias("hint"), "ts", "seq")
    now = m.agg(F.max("ts")).first()[0]
    return active_goals(facts.fold_goals(stated.unionByName(steps)), F.lit(now).cast("long"))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Cells (key, n, last_ts) of a stored table and a batch: counts added, the later time kept."""
    return old.unionByName(new).groupBy(*key).agg(F.sum("n").cast("long").alias("n"), F.max("last_ts").alias("last_ts"))


@query("g12_satisfaction_cells", recursive(f"SELECT reaction, behaviour, count(*) AS n, max(ts) AS last_ts FROM ({profiles.REACTED_SQL}) GROUP BY 1, 2", *profiles.REACTED_VIEWS))
def g12_satisfaction_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the even projects' sessions, then those of the others added to them."""
    own = profiles.reacted(v.threads(spark, sf_dir))
    cells = lambda rows: rows.groupBy("reaction", "behaviour").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    even = F.pmod(F.xxhash64("session_id"), F.lit(2)) == 0
    return upserted(cells(own.filter(even)), cells(own.filter(~even)), ["reaction", "behaviour"])


@query(
    "a09_longest_session",
    v.with_views(
        "SELECT session_id, tokens FROM (SELECT session_id, CAST(sum(input_tokens + cache_creation_tokens + cache_read_tokens + output_tokens) AS BIGINT) AS tokens FROM turns GROUP BY 1) ORDER BY tokens DESC, session_id LIMIT 1",
        v.TURNS_SQL,
    ),
)
def a09_longest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest(v.turns(spark, sf_dir), v.messages(spark, sf_dir)).select("session_id", F.col("size").alias("tokens"))


def longest(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """The session with the most tokens; where no turn has any, the one that took the longest."""
    names = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens")
    total = F.sum(sum((F.col(c) for c in names[1:]), F.col(names[0]))).cast("long")
    tokens = turns.groupBy("session_id").agg(total.alias("size")).filter("size > 0").select("session_id", "size", F.lit(1).alias("leg"))
    wall = messages.groupBy("session_id").agg((F.max("ts") - F.min("ts")).alias("size")).select("session_id", "size", F.lit(0).alias("leg"))
    return tokens.unionByName(wall).orderBy(F.desc("leg"), F.desc("size"), "session_id").limit(1)


# How sure a ban of each strength is, before repetition.
BAN_FLOOR = {"absolute": 0.95, "context": 0.80, "preference": 0.65}


def ban_confidence(strength: Column, times: Column) -> Column:
    """Of a ban: its floor and 0.05 for each repetition, 0.1 at most."""
    floor = F.element_at(F.create_map(*(F.lit(x) for p in BAN_FLOOR.items() for x in p)), strength)
    return F.least(F.lit(1.0), floor + F.least(0.05 * (times - 1), F.lit(0.1)))


def decision_confidence(times: Column, is_reversed: Column) -> Column:
    """Of a decision: 0.7 and 0.05 for each assertion up to 0.95; 0.6 once it is reversed."""
    return F.when(is_reversed, 0.6).otherwise(F.least(F.lit(0.95), 0.7 + 0.05 * times))


def discussed_confidence(times: Column) -> Column:
    """That something was discussed: 0.5 and 0.05 for each mention, up to 0.85."""
    return F.least(F.lit(0.85), 0.5 + 0.05 * times)


def goal_confidence(status: Column) -> Column:
    return F.when(status == "active", 0.9).otherwise(0.7)


@query(
    "m16_confidences",
    v.with_views(
        """SELECT thing, strength, CAST(round(least(1.0, CASE strength WHEN 'absolute' THEN 0.95 WHEN 'context' THEN 0.80 ELSE 0.65 END + least(0.05 * (n - 1), 0.1)), 6) AS DOUBLE) AS as_ban,
  CAST(round(CASE WHEN back THEN 0.6 ELSE least(0.95, 0.7 + 0.05 * n) END, 6) AS DOUBLE) AS as_decision, CAST(round(least(0.85, 0.5 + 0.05 * n), 6) AS DOUBLE) AS as_topic
FROM (SELECT thing, strength, user_id, count(*) AS n, bool_or(reversed) AS back FROM claims GROUP BY 1, 2, 3)""",
        facts.CLAIMS_SQL,
    ),
)
def m16_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure one can be of each user's claims, taken as bans, decisions or mentions."""
    own = facts.claims(spark, sf_dir).groupBy("thing", "strength", "user_id").agg(F.count("*").alias("n"), F.max("reversed").alias("back"))
    n = F.col("n")
    return own.select(
        "thing", "strength", F.round(ban_confidence(F.col("strength"), n), 6).alias("as_ban"), F.round(decision_confidence(n, F.col("back")), 6).alias("as_decision"), F.round(discussed_confidence(n), 6).alias("as_topic")
    )


@query(
    "n31_echoes",
    v.with_views(
        """SELECT message_uuid, contains(lower(before), lower(text)) OR len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.75 AS echo FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(before), '[a-z0-9]+')) AS b
FROM (SELECT *, lag(text) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM messages)) WHERE before IS NOT NULL""",
        v.MESSAGES_SQL,
    ),
)
def n31_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a message only says again what the one before said."""
    from pyspark.sql import Window as W

    m = v.messages(spark, sf_dir).withColumn("before", F.lag("text").over(W.partitionBy("session_id").orderBy("seq"))).filter("before IS NOT NULL")
    return m.select("message_uuid", t.echoes(F.col("text"), F.col("before")).alias("echo"))


# What announces another subject.
PIVOT = r"\b(now|instead|switch(?:ing)?|pivot|actually|let'?s\s+(?:do|work|check|look)|back\s+to|move\s+(?:on\s+)?to|forget\s+that|new\s+topic)\b"
SCOPES = {"storage": ["sqlite", "parquet", "database"], "compute": ["spark", "pandas"], "release": ["ship", "deploy", "build"], "checks": ["test", "mock"]}


def scope_shifts(messages: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """User messages that turn to another scope, with how sure that is.

    Another folder than that of the user's message before is certain, and then the scopes are the folders' names. Else the leading
    scope by keywords must not be that of most of the five messages before. Scopes earlier in `scopes` win ties within a message, those seen earlier win ties among messages.
    """
    from pyspark.sql import Window as W

    low = F.lower("text")
    hits = [sum((F.when(low.contains(k), 1).otherwise(0) for k in words), F.lit(0)) for words in scopes.values()]
    most = F.greatest(*hits) if len(hits) > 1 else hits[0]
    lead = F.coalesce(*(F.when((n == most) & (most > 0), name) for name, n in zip(scopes, hits, strict=True)))
    order = W.partitionBy("session_id").orderBy("seq")
    u = messages.filter("role = 'user'").withColumns({"scope": lead, "hits": most, "folder": F.lag("cwd").over(order)})
    before = F.collect_list("scope").over(order.rowsBetween(-5, -1))
    ranked = F.transform(F.array_distinct("before"), lambda s: F.struct((-F.size(F.filter("before", lambda x: x == s))).alias("n"), F.array_position("before", s).alias("at"), s.alias("scope")))
    u = u.withColumn("before", before).withColumn("recent", F.array_min(ranked)["scope"])
    pivot = low.rlike(PIVOT)
    sure = F.least(F.lit(1.0), 0.6 + F.when(pivot, 0.3).otherwise(0.0) + F.least(0.1 * F.col("hits"), F.lit(0.2)))
    moved = F.coalesce(F.col("cwd") != F.col("folder"), F.lit(False))
    name = lambda c: F.coalesce(F.nullif(t.scope_of(F.col(c)), F.lit("")), F.col(c))
    turned = F.col("scope").isNotNull() & ~F.col("scope").eqNullSafe(F.col("recent"))
    pick = lambda a, b: F.when(moved, a).otherwise(b)
    return u.filter(moved | (turned & (F.round(sure, 6) >= 0.7))).select(
        "message_uuid",
        pick(name("cwd"), F.col("scope")).alias("scope"),
        pick(name("folder"), F.col("recent")).alias("recent"),
        pick(F.lit("cwd"), F.when(pivot, "keyword+pivot").otherwise("keyword")).alias("reason"),
        pick(F.lit(1.0), F.round(sure, 6)).alias("confidence"),
    )


# Some messages of a session come from a folder below its own.
_MOVED = "CASE WHEN seq % 5 = 4 THEN cwd || '/Docs/' ELSE cwd END"


def _scope_sql() -> str:
    hits = {name: "(" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in words) + ")" for name, words in SCOPES.items()}
    most = f"greatest({', '.join(hits.values())})"
    lead = "CASE " + " ".join(f"WHEN {n} = {most} AND {most} > 0 THEN '{name}'" for name, n in hits.items()) + " END"
    pivot = f"regexp_matches(lower(text), {t.quoted(PIVOT)})"
    counted = "list_transform(list_distinct(before), lambda s: {'n': -len(list_filter(before, lambda x: x = s)), 'at': list_position(before, s), 'scope': s})"
    name = lambda c: f"coalesce(nullif(lower(string_split(regexp_replace({c}, '/+$', ''), '/')[-1]), ''), {c})"
    return f"""SELECT message_uuid, CASE WHEN moved THEN {name('cwd')} ELSE scope END AS scope, CASE WHEN moved THEN {name('folder')} ELSE recent END AS recent,
  CASE WHEN moved THEN 'cwd' WHEN turned THEN 'keyword+pivot' ELSE 'keyword' END AS reason, CASE WHEN moved THEN CAST(1 AS DOUBLE) ELSE confidence END AS confidence FROM (SELECT *, coalesce(cwd <> folder, false) AS moved, CAST(round(least(1.0, 0.6 + CASE WHEN turned THEN 0.3 ELSE 0.0 END + least(0.1 * hits, 0.2)), 6) AS DOUBLE) AS confidence
FROM (SELECT *, (list_sort({counted}))[1].scope AS recent FROM (SELECT *, coalesce(list(scope) FILTER (WHERE scope IS NOT NULL) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS before
FROM (SELECT *, {lead} AS scope, {most} AS hits, {pivot} AS turned, lag(cwd) OVER (PARTITION BY session_id ORDER BY seq) AS folder FROM (SELECT * REPLACE ({_MOVED} AS cwd) FROM messages WHERE role = 'user')))))
WHERE moved OR (scope IS NOT NULL AND scope IS DISTINCT FROM recent AND confidence >= 0.7)"""


@query("n33_scope_shifts", v.with_views(_scope_sql(), v.MESSAGES_SQL))
def n33_scope_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_shifts(v.messages(spark, sf_dir).withColumn("cwd", F.expr(_MOVED)), SCOPES)
