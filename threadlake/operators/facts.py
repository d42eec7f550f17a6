"""Keyed facts and their state (G01-G06, G08-G11, G13, G16, U01m, M03, M04), each as one aggregation in processing order (`seq`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadlake import views as v
from threadlake.functions import scoring
from threadlake.queries import query

DAY = 86400


def _first(c: str) -> Column:
    """The first non-null value in processing order."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))


def _latest(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))


def fold_bans(claims: DataFrame) -> DataFrame:
    """By thing, category and clause (null and empty alike): how often, since when, and the latest strength and text."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return claims.groupBy(empty("thing"), empty("category"), empty("clause")).agg(
        F.count("*").alias("times"), F.min("ts").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"), F.max_by("strength", "seq").alias("strength"), F.max_by("text", "seq").alias("text")
    )


CLAIMS_SQL = """claims AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS thing, CASE WHEN user_id % 3 > 0 THEN 'c' || user_id END AS category,
  CASE WHEN event_id % 2 = 0 THEN 'when ' || user_id ELSE '' END AS clause, (['absolute', 'context', 'preference'])[event_id % 3 + 1] AS strength, props AS text, value,
  CASE WHEN event_id % 4 = 0 THEN 'because ' || event_id % 9 END AS reason, event_id % 17 = 0 AS reversed, user_id FROM events)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made of the events by fixed rules (CLAIMS_SQL states the same)."""
    e = v.table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("seq"),
        v.seconds().alias("ts"),
        F.col("event_type").alias("thing"),
        F.when(u % 3 > 0, F.concat(F.lit("c"), u.cast("string"))).alias("category"),
        F.when(i % 2 == 0, F.concat(F.lit("when "), u.cast("string"))).otherwise("").alias("clause"),
        F.get(F.array(F.lit("absolute"), F.lit("context"), F.lit("preference")), (i % 3).cast("int")).alias("strength"),
        F.col("props").alias("text"),
        "value",
        F.when(i % 4 == 0, F.concat(F.lit("because "), (i % 9).cast("string"))).alias("reason"),
        (i % 17 == 0).alias("reversed"),
        "user_id",
    )


@query(
    "g01_bans",
    v.with_views(
        """SELECT coalesce(thing, '') AS thing, coalesce(category, '') AS category, coalesce(clause, '') AS clause, count(*) AS times, min(ts) AS first_ts,
  arg_max(ts, seq) AS last_ts, arg_max(strength, seq) AS strength, arg_max(text, seq) AS text FROM claims GROUP BY 1, 2, 3""",
        CLAIMS_SQL,
    ),
)
def g01_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_bans(claims(spark, sf_dir))


@query(
    "g02_failed_attempts",
    v.with_views(
        "SELECT thing AS attempt, user_id AS project, min_by(ts, seq) AS attempted_ts, max_by(reason, CASE WHEN reason IS NOT NULL THEN seq END) AS reason, count(*) AS times FROM claims GROUP BY 1, 2", CLAIMS_SQL
    ),
)
def g02_failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By attempt and project: the first time, and the latest reason given."""
    return claims(spark, sf_dir).groupBy(F.col("thing").alias("attempt"), F.col("user_id").alias("project")).agg(
        F.min_by("ts", "seq").alias("attempted_ts"), _latest("reason").alias("reason"), F.count("*").alias("times")
    )


def fold_decisions(claims: DataFrame) -> DataFrame:
    """By topic, choice and scope: assertions, latest time, first rationale, money summed, and reversal."""
    return claims.groupBy("topic", "chose", "scope").agg(
        F.count("*").alias("times"),
        F.max("ts").alias("last_ts"),
        _first("reason").alias("rationale"),
        F.round(F.sum("value"), 4).alias("money"),
        F.max("reversed").alias("is_reversed"),
        F.max_by("seq", F.when(F.col("reversed"), F.col("seq"))).alias("reversed_at"),
    )


@query(
    "g03_decisions",
    v.with_views(
        """SELECT thing AS topic, strength AS chose, user_id AS scope, count(*) AS times, max(ts) AS last_ts, arg_min(reason, CASE WHEN reason IS NOT NULL THEN seq END) AS rationale,
  round(sum(value), 4) AS money, bool_or(reversed) AS is_reversed, max(CASE WHEN reversed THEN seq END) AS reversed_at FROM claims GROUP BY 1, 2, 3""",
        CLAIMS_SQL,
    ),
)
def g03_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    return fold_decisions(c.select("seq", "ts", F.col("thing").alias("topic"), F.col("strength").alias("chose"), F.col("user_id").alias("scope"), "reason", "value", "reversed"))


def goal_status(status: Column, seen: Column, now: Column | int) -> Column:
    """60 days without progress abandon a goal, 30 pause it; a blocked one with fresh progress is active again."""
    age = F.lit(now) - seen
    open_ = status.isin("active", "paused")
    return F.when(open_ & (age > 60 * DAY), "abandoned").when((status == "active") & (age > 30 * DAY), "paused").when((status == "blocked") & (age <= 30 * DAY), "active").otherwise(status)


@query(
    "g06_goal_status",
    v.with_views(
        """SELECT id, CASE WHEN status IN ('active', 'paused') AND now - ts > 60 * 86400 THEN 'abandoned' WHEN status = 'active' AND now - ts > 30 * 86400 THEN 'paused'
  WHEN status = 'blocked' AND now - ts <= 30 * 86400 THEN 'active' ELSE status END AS status
FROM (SELECT id, ts, (['active', 'paused', 'blocked', 'done', 'abandoned'])[id % 5 + 1] AS status, (SELECT max(ts) FROM extractions) AS now FROM extractions)""",
        v.EXTRACTIONS_SQL,
    ),
)
def g06_goal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.extractions(spark, sf_dir)
    status = F.get(F.array(*(F.lit(x) for x in ("active", "paused", "blocked", "done", "abandoned"))), (F.col("id") % 5).cast("int"))
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).select("id", goal_status(status, F.col("ts"), F.col("now")).alias("status"))


def fold_goals(events: DataFrame) -> DataFrame:
    """(project, goal, declared_ts, last_progress_ts, status) after all events (project, goal, hint, ts, seq), in the order of ts and seq.

    A row with a goal states it or states it again, and a hint (blocked, done) sets its status from then on; it is active before. A row
    without a goal is progress of the project, and touches those of its goals that are active or blocked at that time. Events without
    a project or time are left out. Between two statements of a goal only the last progress matters, which each statement
    finds by days: the last of its own day before it, else of the days before. So a window holds a project's day, not a project.
    """
    own = events.filter("project IS NOT NULL AND ts IS NOT NULL").withColumn("day", F.floor(F.col("ts") / DAY)).withColumn("at", F.struct("ts", "seq"))
    step = F.when(F.col("goal").isNull(), F.col("at"))
    days = own.groupBy("project", "day").agg(F.max(step).alias("step"))
    earlier = W.partitionBy("project").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("project", "day", F.max("step").over(earlier).alias("carried"))
    today = W.partitionBy("project", "day").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    stated = own.withColumn("step", F.max(step).over(today)).filter("goal IS NOT NULL").join(days, ["project", "day"]).withColumn("before", F.coalesce("step", "carried"))
    last = own.groupBy("project").agg(F.max(step).alias("final"))
    said = W.partitionBy("project", "goal").orderBy("ts", "seq")
    stated = stated.join(last, "project").withColumns(
        {
            "status": F.coalesce(F.last("hint", ignorenulls=True).over(said.rowsBetween(W.unboundedPreceding, 0)), F.lit("active")),
            "until": F.when(F.lead("seq").over(said).isNull(), F.col("final")).otherwise(F.lead("before").over(said)),
        }
    )
    touched = F.when(F.col("status").isin("active", "blocked") & (F.col("until") > F.col("at")), F.col("until.ts"))
    return stated.groupBy("project", "goal").agg(
        F.min("ts").alias("declared_ts"), F.max(F.greatest(F.col("ts"), touched)).alias("last_progress_ts"), F.max_by("status", "at").alias("status")
    )


def fold_goals_sql(events: str) -> str:
    """`goals` over `events`: every progress of the project compared with every statement."""
    later = lambda a, b: f"({a}ts > {b}ts OR {a}ts = {b}ts AND {a}seq > {b}seq)"
    return f"""stated AS (SELECT *, coalesce(last_value(hint IGNORE NULLS) OVER w, 'active') AS status, lead(ts) OVER w AS nextts, lead(seq) OVER w AS nextseq FROM {events} WHERE goal IS NOT NULL
  WINDOW w AS (PARTITION BY project, goal ORDER BY ts, seq)),
touched AS (SELECT g.project, g.goal, g.seq, max(p.ts) AS bump FROM stated g JOIN {events} p ON p.goal IS NULL AND p.project = g.project AND {later('p.', 'g.')}
  AND (nextseq IS NULL OR {later('g.next', 'p.')}) WHERE status IN ('active', 'blocked') GROUP BY 1, 2, 3),
goals AS (SELECT project, goal, min(ts) AS declared_ts, max(greatest(ts, coalesce(bump, ts))) AS last_progress_ts, arg_max(status, ts * 1000000 + seq) AS status
  FROM stated LEFT JOIN touched USING (project, goal, seq) GROUP BY 1, 2)"""


HINTED_SQL = "CASE WHEN kind = 'goal' THEN CASE id // 10 % 7 WHEN 1 THEN 'blocked' WHEN 3 THEN 'done' END END"


@query(
    "g05_goal_progress",
    v.with_views(
        "SELECT project, goal, declared_ts, last_progress_ts, status FROM goals",
        v.EXTRACTIONS_SQL,
        f"events AS (SELECT project_key AS project, CASE WHEN kind = 'goal' THEN 'goal of ' || session_id END AS goal, {HINTED_SQL} AS hint, ts, id AS seq FROM extractions WHERE kind IN ('goal', 'progress'))",
        fold_goals_sql("events"),
    ),
)
def g05_goal_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's goal in each project, stated again by each of its goal rows; some rows say that it is blocked or done."""
    e = v.extractions(spark, sf_dir).filter(F.col("kind").isin("goal", "progress"))
    goal, turn = F.col("kind") == "goal", F.floor(F.col("id") / 10) % 7
    hint = F.when(goal & (turn == 1), "blocked").when(goal & (turn == 3), "done")
    return fold_goals(e.select(F.col("project_key").alias("project"), F.when(goal, F.concat(F.lit("goal of "), F.col("session_id"))).alias("goal"), hint.alias("hint"), "ts", F.col("id").alias("seq")))


STRENGTH = {"absolute": 3, "context": 2, "preference": 1}


@query(
    "g08_top_bans",
    v.with_views(
        """SELECT thing, strength, times, last_ts FROM (SELECT thing, strength, count(*) AS times, max(ts) AS last_ts FROM claims GROUP BY 1, 2)
ORDER BY CASE strength WHEN 'absolute' THEN 3 WHEN 'context' THEN 2 ELSE 1 END DESC, last_ts DESC, times DESC, thing LIMIT 10""",
        CLAIMS_SQL,
    ),
)
def g08_top_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest bans, then the latest, then the most frequent."""
    rank = F.element_at(F.create_map(*(F.lit(x) for p in STRENGTH.items() for x in p)), F.col("strength"))
    own = claims(spark, sf_dir).groupBy("thing", "strength").agg(F.count("*").alias("times"), F.max("ts").alias("last_ts"))
    return own.orderBy(F.desc(rank), F.desc("last_ts"), F.desc("times"), "thing").limit(10)


@query(
    "g09_decision_lookup",
    v.with_views(
        """SELECT topic, scope, chose, times FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE scope WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, times DESC, last_ts DESC, chose) AS n
  FROM (SELECT thing AS topic, user_id AS scope, strength AS chose, count(*) AS times, max(ts) AS last_ts FROM claims GROUP BY 1, 2, 3 HAVING NOT bool_or(reversed))) WHERE n = 1""",
        CLAIMS_SQL,
    ),
)
def g09_decision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each topic the decision of scope 2, else of the global scope 0, else of any; the most asserted one that was never reversed."""
    own = claims(spark, sf_dir).groupBy(F.col("thing").alias("topic"), F.col("user_id").alias("scope"), F.col("strength").alias("chose"))
    own = own.agg(F.count("*").alias("times"), F.max("ts").alias("last_ts"), F.max("reversed").alias("gone")).filter("NOT gone")
    tier = F.when(F.col("scope") == 2, 0).when(F.col("scope") == 0, 1).otherwise(2)
    best = own.groupBy("topic").agg(F.min_by(F.struct("scope", "chose", "times"), F.struct(tier, -F.col("times"), -F.col("last_ts"), F.col("chose"))).alias("b"))
    return best.select("topic", "b.*")


@query(
    "g10_tentative",
    v.with_views(
        """SELECT thing AS key, user_id AS value, count(*) AS evidence, min(ts) AS first_seen, max(ts) AS last_seen, count(*) >= 2 AND max(ts) - min(ts) >= 3600 AND (SELECT max(ts) FROM claims) - max(ts) <= 30 * 86400 AS promoted
FROM claims GROUP BY 1, 2 HAVING (SELECT max(ts) FROM claims) - max(ts) <= 30 * 86400""",
        CLAIMS_SQL,
    ),
)
def g10_tentative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak claims by key and value; promoted with two pieces of evidence an hour apart, dropped after 30 days."""
    c = claims(spark, sf_dir)
    own = c.groupBy(F.col("thing").alias("key"), F.col("user_id").alias("value")).agg(F.count("*").alias("evidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    now = c.agg(F.max("ts").alias("now"))
    good = (F.col("evidence") >= 2) & (F.col("last_seen") - F.col("first_seen") >= 3600) & (F.col("now") - F.col("last_seen") <= 30 * DAY)
    live = own.join(F.broadcast(now)).filter(F.col("now") - F.col("last_seen") <= 30 * DAY)
    return live.select("key", "value", "evidence", "first_seen", "last_seen", good.alias("promoted"))


@query(
    "g11_consolidation",
    v.with_views(
        """SELECT term, sessions, days, CASE WHEN sessions >= 7 AND days >= 14 THEN 2 WHEN sessions >= 3 AND days >= 2 THEN 1 ELSE 0 END AS tier, round(confidence, 6) AS confidence, confidence < 0.2 AS archived, confidence < 0.2 AND age > 30 * 86400 AS pruned
FROM (SELECT thing || ':' || strength || ':' || user_id % 40 AS term, count(DISTINCT user_id) AS sessions, count(DISTINCT ts // 86400) AS days, (SELECT max(ts) FROM claims) - max(ts) AS age,
  least(1.0, greatest(0.0, 0.5 * pow(0.5, ((SELECT max(ts) FROM claims) - max(ts)) / 86400.0 / 90.0) * least(1 + 0.2 * ln(1 + count(*)), 1.5))) AS confidence FROM claims GROUP BY 1)""",
        CLAIMS_SQL,
    ),
)
def g11_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of terms by sessions and days, decayed confidence, what falls below 0.2, and what of that is 30 days old."""
    c = claims(spark, sf_dir)
    term = F.concat_ws(":", "thing", "strength", (F.col("user_id") % 40).cast("string")).alias("term")
    own = c.groupBy(term).agg(F.countDistinct("user_id").alias("sessions"), F.countDistinct(F.floor(F.col("ts") / DAY)).alias("days"), F.max("ts").alias("last"), F.count("*").alias("n"))
    own = own.join(F.broadcast(c.agg(F.max("ts").alias("now"))))
    confidence = scoring.decayed(F.lit(0.5), (F.col("now") - F.col("last")) / float(DAY), F.col("n"))
    tier = F.when((F.col("sessions") >= 7) & (F.col("days") >= 14), 2).when((F.col("sessions") >= 3) & (F.col("days") >= 2), 1).otherwise(0)
    return own.select("term", "sessions", "days", tier.alias("tier"), F.round(confidence, 6).alias("confidence"), (confidence < 0.2).alias("archived"), ((confidence < 0.2) & (F.col("now") - F.col("last") > 30 * DAY)).alias("pruned"))


@query(
    "g13_upsert_machines",
    v.with_views(
        """SELECT coalesce(a.user_id, b.user_id) AS machine, coalesce(b.role, a.role) AS role, least(a.first_seen, b.first_seen) AS first_seen, greatest(a.last_active, b.last_active) AS last_active
FROM (SELECT user_id, arg_max(category, CASE WHEN category IS NOT NULL THEN seq END) AS role, min(ts) AS first_seen, max(ts) AS last_active FROM claims WHERE seq % 3 = 0 GROUP BY 1) a
FULL JOIN (SELECT user_id, arg_max(reason, CASE WHEN reason IS NOT NULL THEN seq END) AS role, min(ts) AS first_seen, max(ts) AS last_active FROM claims WHERE seq % 7 = 1 GROUP BY 1) b ON a.user_id = b.user_id""",
        CLAIMS_SQL,
    ),
)
def g13_upsert_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13, U01m: a stored table merged with new rows: what is new and not null wins, bounds widen."""
    c = claims(spark, sf_dir)
    side = lambda rows, role: rows.groupBy(F.col("user_id").alias("machine")).agg(_latest(role).alias("role"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_active"))
    return merged(side(c.filter("seq % 3 = 0"), "category"), side(c.filter("seq % 7 = 1"), "reason"), "machine")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    fresh = new.withColumnsRenamed({c: f"new_{c}" for c in new.columns if c != key})
    return old.join(fresh, key, "full_outer").select(
        key,
        F.coalesce("new_role", "role").alias("role"),
        F.least("first_seen", "new_first_seen").alias("first_seen"),
        F.greatest("last_active", "new_last_active").alias("last_active"),
    )


@query(
    "m04_conflicts",
    v.with_views(
        """SELECT a.seq, CASE WHEN a.strength <> '' AND b.strength <> '' AND a.strength <> b.strength THEN 'coexist' WHEN b.q < a.q THEN 'keep_old' WHEN b.seq % 3 + 1 < 2 AND b.q <= a.q THEN 'tentative' ELSE 'supersede' END AS outcome
FROM (SELECT *, seq % 4 + 1 AS q FROM claims) a JOIN (SELECT *, seq % 4 + 1 AS q FROM claims) b ON b.seq = a.seq + 1""",
        CLAIMS_SQL,
    ),
)
def m04_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new claim does to the one before it."""
    c = claims(spark, sf_dir).select("seq", "strength", (F.col("seq") % 4 + 1).alias("q"))
    new = c.select((F.col("seq") - 1).alias("seq"), F.col("strength").alias("s2"), F.col("q").alias("q2"), (F.col("seq") % 3 + 1).alias("evidence"))
    outcome = scoring.conflict(F.col("q"), F.col("q2"), F.col("strength"), F.col("s2"), F.col("evidence"))
    return c.join(new, "seq").select("seq", outcome.alias("outcome"))


def merged_claims(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """U01m: a stored profile (key, value, confidence) after new claims (key, value, confidence, evidence).

    An empty claim changes nothing, an empty place takes the claim; the same value, in any case and without spaces around it, adds 0.05 to the confidence; another one replaces the value if it has
    two pieces of evidence or the higher confidence, and else stays tentative.
    """
    fresh = new.select(key, F.col("value").alias("claim"), F.col("confidence").alias("sure"), "evidence")
    both = old.join(fresh, key, "full_outer")
    outcome = (
        F.when(F.coalesce("claim", F.lit("")) == "", "kept")
        .when(F.coalesce("value", F.lit("")) == "", "taken")
        .when(F.lower(F.trim("claim")) == F.lower(F.trim("value")), "confirmed")
        .when((F.col("evidence") >= 2) | (F.col("sure") > F.col("confidence")), "replaced")
        .otherwise("tentative")
    )
    moved = F.col("outcome").isin("taken", "replaced")
    confidence = F.when(moved, F.col("sure")).when(F.col("outcome") == "confirmed", F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence"))
    return both.withColumn("outcome", outcome).select(key, "outcome", F.when(moved, F.col("claim")).otherwise(F.col("value")).alias("value"), confidence.alias("confidence"))


@query(
    "u01_merged_profile",
    v.with_views(
        """SELECT key, outcome, CASE WHEN outcome IN ('taken', 'replaced') THEN claim ELSE value END AS value, CAST(round(CASE WHEN outcome IN ('taken', 'replaced') THEN sure WHEN outcome = 'confirmed' THEN least(1.0, confidence + 0.05) ELSE confidence END, 6) AS DOUBLE) AS confidence
FROM (SELECT *, CASE WHEN coalesce(claim, '') = '' THEN 'kept' WHEN coalesce(value, '') = '' THEN 'taken' WHEN lower(trim(claim)) = lower(trim(value)) THEN 'confirmed' WHEN evidence >= 2 OR sure > confidence THEN 'replaced' ELSE 'tentative' END AS outcome
FROM (SELECT coalesce(a.key, b.key) AS key, value, confidence, claim, sure, evidence FROM
  (SELECT thing || ':' || user_id AS key, arg_max(strength, seq) AS value, 0.3 + 0.1 * (count(*) % 5) AS confidence FROM claims WHERE seq % 2 = 0 GROUP BY 1) a FULL JOIN
  (SELECT thing || ':' || user_id AS key, arg_max(strength, seq) AS claim, 0.3 + 0.1 * (count(*) % 4) AS sure, count(*) AS evidence FROM claims WHERE seq % 2 = 1 GROUP BY 1) b ON a.key = b.key))""",
        CLAIMS_SQL,
    ),
)
def u01_merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01m over claims: those of even numbers are stored, the others come in."""
    c = claims(spark, sf_dir).withColumn("key", F.concat_ws(":", "thing", F.col("user_id").cast("string")))
    side = lambda rest, n: c.filter(F.col("seq") % 2 == rest).groupBy("key").agg(F.max_by("strength", "seq").alias("value"), (0.3 + 0.1 * (F.count("*") % n)).alias("confidence"), F.count("*").alias("evidence"))
    out = merged_claims(side(0, 5).drop("evidence"), side(1, 4), "key")
    return out.withColumn("confidence", F.round("confidence", 6))


# From which risk on a reason is hard or soft, and how many injections a session gets at most.
HARD_RISK, SOFT_RISK, INJECTIONS = 5, 3, 6
RECALL_PHRASES = r"\b(remember when|we (?:already|just)|didn'?t (?:we|you)|like (?:i|you) said|as (?:i|you) (?:mentioned|said)|last time|previously)\b"


def reinject(state: DataFrame) -> DataFrame:
    """Whether to inject context again, and why: never beyond the cap; for a hard reason always; else, unless suppressed, for two soft ones."""
    c = F.col
    hard = (c("risk") >= HARD_RISK) | c("repetition") | (c("post_compact") & c("known")) | F.lower("last_user").rlike(RECALL_PHRASES) | (c("moved") & c("known"))
    fresh = (c("since_seconds") < 300) & (c("since_turns") <= 2)
    steady = (c("streak") >= 4) & (c("risk") <= 1)
    loop = c("tool_heavy") & (c("risk") <= 2)
    signs = (c("risk") >= SOFT_RISK, (c("silence") > 600) & (c("since_turns") > 5), c("since_turns") > 20, (c("draft_words") > 200) & (c("risk") >= 2))
    soft = sum((F.when(x, 1).otherwise(0) for x in signs), F.lit(0))
    reason = (
        F.when(c("injections") >= INJECTIONS, "session_cap")
        .when(hard, "hard")
        .when(fresh, "cache_fresh")
        .when(steady, "steady_state")
        .when(loop, "tool_loop")
        .when(soft >= 2, "soft")
        .otherwise("too_little")
    )
    return state.withColumn("reason", reason).withColumn("inject", F.col("reason").isin("hard", "soft"))


# The state of a turn, by rules from the message's number and text: the given tables hold no such log.
_STATE = {
    "risk": "seq % 7",
    "repetition": "seq % 11 = 0",
    "post_compact": "seq % 5 = 0",
    "moved": "seq % 6 = 0",
    "known": "seq % 3 = 0",
    "since_seconds": "seq % 13 * 60",
    "since_turns": "seq % 29",
    "streak": "seq % 6",
    "tool_heavy": "seq % 4 = 0",
    "silence": "seq % 17 * 60",
    "draft_words": "seq % 300",
    "injections": "seq % 8",
}


@query(
    "g16_reinjection",
    v.with_views(
        f"""SELECT message_uuid, reason, reason IN ('hard', 'soft') AS inject FROM (SELECT message_uuid, CASE WHEN injections >= {INJECTIONS} THEN 'session_cap'
  WHEN risk >= {HARD_RISK} OR repetition OR (post_compact AND known) OR regexp_matches(lower(text), '{RECALL_PHRASES.replace("'", "''")}') OR (moved AND known) THEN 'hard'
  WHEN since_seconds < 300 AND since_turns <= 2 THEN 'cache_fresh' WHEN streak >= 4 AND risk <= 1 THEN 'steady_state' WHEN tool_heavy AND risk <= 2 THEN 'tool_loop'
  WHEN CAST(risk >= {SOFT_RISK} AS INT) + CAST(silence > 600 AND since_turns > 5 AS INT) + CAST(since_turns > 20 AS INT) + CAST(draft_words > 200 AND risk >= 2 AS INT) >= 2 THEN 'soft' ELSE 'too_little' END AS reason
FROM (SELECT *, {", ".join(f"{x} AS {k}" for k, x in _STATE.items())} FROM messages WHERE role = 'user'))""",
        v.MESSAGES_SQL,
    ),
)
def g16_reinjection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16 over the users' messages, with a state derived from their numbers."""
    state = v.messages(spark, sf_dir).filter("role = 'user'").select("message_uuid", F.col("text").alias("last_user"), *(F.expr(x).alias(k) for k, x in _STATE.items()))
    return reinject(state).select("message_uuid", "reason", "inject")
