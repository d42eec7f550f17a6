"""Operational analytics (A01-A19, A26-A28) over messages, turns, extractions and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadlake import views as v
from threadlake.functions import scoring, text
from threadlake.operators import extract
from threadlake.queries import query

TOKENS = ["input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens"]


def _zero(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def summary(messages: DataFrame, turns: DataFrame, since: int = 0) -> DataFrame:
    """Sessions, projects, token totals, active time, cache share and wall hours since a time; one row."""
    m = messages.filter(F.coalesce("ts", F.lit(0)) >= since)
    counts = m.agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("project_key").alias("projects"))
    t = turns.filter(F.coalesce("ts", F.lit(0)) >= since)
    totals = t.agg(*(_zero(c).alias(c) for c in TOKENS), _zero("duration_ms").alias("active_ms"))
    seen = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    totals = totals.withColumn("cache_read_pct", F.when(seen > 0, F.round(100.0 * F.col("cache_read_tokens") / seen, 6)).otherwise(0.0))
    spans = m.groupBy("session_id").agg((F.max("ts") - F.min("ts")).alias("span")).agg(F.round(F.sum("span") / 3600.0, 6).alias("wall_hours"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(counts).join(one(totals), "_one").join(one(spans), "_one").drop("_one")


@query(
    "a01_summary",
    v.with_views(
        """SELECT sessions, projects, input_tokens, cache_creation_tokens, cache_read_tokens, output_tokens, active_ms,
  round(100.0 * cache_read_tokens / (input_tokens + cache_read_tokens + cache_creation_tokens), 6) AS cache_read_pct, wall_hours
FROM (SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT project_key) AS projects FROM messages),
 (SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
   CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(duration_ms) AS BIGINT) AS active_ms FROM turns),
 (SELECT round(sum(span) / 3600.0, 6) AS wall_hours FROM (SELECT max(ts) - min(ts) AS span FROM messages GROUP BY session_id))""",
        v.MESSAGES_SQL,
        v.TURNS_SQL,
    ),
)
def a01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(v.messages(spark, sf_dir), v.turns(spark, sf_dir))


def cost_by_model(turns: DataFrame) -> DataFrame:
    """Tokens and dollars by model; turns without a model are billed at the default rate."""
    sums = turns.groupBy(F.coalesce("model", F.lit("default")).alias("model")).agg(*(_zero(c).alias(c) for c in TOKENS))
    dollars = scoring.cost(F.col("model"), *(F.col(c) for c in ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")))
    return sums.withColumn("cost", F.round(dollars, 6))


@query(
    "a05_cost_by_model",
    v.with_views(
        f"""SELECT * EXCLUDE (whose), round({scoring.COST_SQL}, 6) AS cost FROM (SELECT *, {scoring.PROVIDER_SQL} AS whose FROM (SELECT coalesce(model, 'default') AS model,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in TOKENS)} FROM turns GROUP BY 1))""",
        v.TURNS_SQL,
    ),
)
def a05_cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_by_model(v.turns(spark, sf_dir))


def corrections(messages: DataFrame) -> DataFrame:
    """The corrections of X01, with their paraphrase key."""
    c = F.col("text")
    return extract.user_texts(messages).filter((F.length(c) < 500) & extract.has(c, extract.CORRECTION)).withColumn("key", text.correction_key(c))


CORRECTIONS_SQL = f"""corrections AS (SELECT *, {text.correction_key_sql("text")} AS key FROM messages
  WHERE {extract.USER_SQL} AND length(text) < 500 AND {extract.sql_has("text", extract.CORRECTION)})"""


@query(
    "a07_top_corrections",
    v.with_views(
        """SELECT key, count(*) AS n, max(ts) AS last_ts, arg_max(text, (length(text), -seq)) AS example
FROM corrections GROUP BY key ORDER BY n DESC, last_ts DESC, key LIMIT 3""",
        v.MESSAGES_SQL,
        CORRECTIONS_SQL,
    ),
)
def a07_top_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent corrections by paraphrase, each with its longest example (the first of equal ones)."""
    found = corrections(v.messages(spark, sf_dir)).groupBy("key").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max_by("text", F.struct(F.length("text"), -F.col("seq"))).alias("example")
    )
    return found.orderBy(F.desc("n"), F.desc("last_ts"), "key").limit(3)


@query(
    "a08_projects_by_tokens",
    v.with_views(
        "SELECT cwd, CAST(sum(input_tokens + cache_creation_tokens + cache_read_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS n_turns FROM turns GROUP BY cwd", v.TURNS_SQL
    ),
)
def a08_projects_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each project; a turn that lacks one of the four counts adds nothing."""
    return v.turns(spark, sf_dir).groupBy("cwd").agg(F.sum(sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))).cast("long").alias("tokens"), F.count("*").alias("n_turns"))


def busiest_project(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """The folder with the most tokens, a turn that lacks one of the counts adding nothing; without turns that of the most messages."""
    tokens = F.sum(sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))).cast("long")
    by_turns = turns.groupBy("cwd").agg(tokens.alias("size")).filter("size IS NOT NULL").select("cwd", "size", F.lit(1).alias("leg"))
    by_messages = messages.groupBy("cwd").agg(F.count("*").alias("size")).select("cwd", "size", F.lit(0).alias("leg"))
    return by_turns.unionByName(by_messages).orderBy(F.desc("leg"), F.desc("size"), "cwd").limit(1)


@query(
    "a08_busiest_project",
    v.with_views(
        "SELECT cwd, size FROM (SELECT cwd, CAST(sum(input_tokens + cache_creation_tokens + cache_read_tokens + output_tokens) AS BIGINT) AS size FROM turns GROUP BY cwd) ORDER BY size DESC, cwd LIMIT 1", v.TURNS_SQL
    ),
)
def a08_busiest_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busiest_project(v.turns(spark, sf_dir), v.messages(spark, sf_dir)).select("cwd", "size")


def rank_sessions(messages: DataFrame, turns: DataFrame, found: DataFrame) -> DataFrame:
    """Sessions of messages or turns, with tokens, duration and corrections.

    Sessions known from turns alone are added; corrections of sessions otherwise unknown are not.
    """
    meta = messages.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_messages"))
    tok = turns.groupBy("session_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("long").alias("tokens"), F.count("*").alias("n_turns"))
    corr = found.groupBy("session_id").agg(F.count("*").alias("n_corrections"))
    out = meta.join(tok, "session_id", "full_outer").join(corr, "session_id", "left")
    return out.select(
        "session_id",
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round((F.col("last_ts") - F.col("first_ts")) / 60.0, 2).alias("duration_min"),
        F.coalesce("n_corrections", F.lit(0)).alias("n_corrections"),
    )


@query(
    "a10_sessions",
    v.with_views(
        """SELECT coalesce(a.session_id, t.session_id) AS session_id, coalesce(n_messages, 0) AS n_messages, coalesce(n_turns, 0) AS n_turns, coalesce(tokens, 0) AS tokens,
  round((last_ts - first_ts) / 60.0, 2) AS duration_min, coalesce(n_corrections, 0) AS n_corrections
FROM (SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_messages FROM messages GROUP BY 1) a
FULL JOIN (SELECT session_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS n_turns FROM turns GROUP BY 1) t ON a.session_id = t.session_id
LEFT JOIN (SELECT session_id, count(*) AS n_corrections FROM corrections GROUP BY 1) c ON coalesce(a.session_id, t.session_id) = c.session_id""",
        v.MESSAGES_SQL,
        v.TURNS_SQL,
        CORRECTIONS_SQL,
    ),
)
def a10_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v.messages(spark, sf_dir)
    return rank_sessions(m, v.turns(spark, sf_dir), corrections(m))


def top_sessions(sessions: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """A10: the first sessions by tokens, duration_min or n_corrections; sessions without the figure last."""
    return sessions.orderBy(F.desc_nulls_last(by), "session_id").limit(limit)


@query(
    "a10_top_by_duration",
    v.with_views("SELECT session_id, round((max(ts) - min(ts)) / 60.0, 2) AS duration_min FROM messages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", v.MESSAGES_SQL),
)
def a10_top_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the ten longest sessions."""
    m = v.messages(spark, sf_dir)
    return top_sessions(rank_sessions(m, v.turns(spark, sf_dir), corrections(m)), "duration_min").select("session_id", "duration_min")


def topics(extractions: DataFrame) -> DataFrame:
    """Facts by topic, which is the paraphrase key of corrections and the first six words of others."""
    six = F.array_join(F.slice(F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda w: w != ""), 1, 6), " ")
    key = F.when(F.col("kind") == "correction", text.correction_key(F.col("content"))).otherwise(six)
    return extractions.withColumn("topic", key).groupBy("topic").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min_by("content", "id").alias("example"), F.min("id").alias("first_id")
    )


@query(
    "a11_topics",
    v.with_views(
        f"""SELECT topic, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, arg_min(content, id) AS example
FROM (SELECT *, CASE WHEN kind = 'correction' THEN {text.correction_key_sql("content")}
  ELSE array_to_string((list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: w <> ''))[1:6], ' ') END AS topic FROM extractions) GROUP BY topic""",
        v.EXTRACTIONS_SQL,
    ),
)
def a11_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(v.extractions(spark, sf_dir)).drop("first_id")


@query(
    "a11_top_topics",
    v.with_views(
        f"""SELECT topic, count(*) AS n FROM (SELECT *, CASE WHEN kind = 'correction' THEN {text.correction_key_sql("content")}
  ELSE array_to_string((list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: w <> ''))[1:6], ' ') END AS topic FROM extractions) GROUP BY topic ORDER BY n DESC, min(id) LIMIT 20""",
        v.EXTRACTIONS_SQL,
    ),
)
def a11_top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest topics, of equal ones the earliest."""
    return topics(v.extractions(spark, sf_dir)).orderBy(F.desc("n"), "first_id").limit(20).select("topic", "n")


def health(runs: DataFrame, days: int = 7) -> DataFrame:
    """By event: runs, errors, nearest-rank percentiles of the time they took, and those of the last days."""
    now = runs.agg(F.max("ts").alias("now"))
    seen = runs.join(F.broadcast(now))
    recent = F.col("ts") >= F.col("now") - days * 86400
    return seen.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.sum("errors").cast("long").alias("errors"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY elapsed_ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_ms)").alias("p95_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.count(F.when(recent, 1)).alias("n_recent"),
        F.max("ts").alias("last_ts"),
    )


@query(
    "a12_health",
    v.with_views(
        """SELECT event_type, count(*) AS n, CAST(sum(errors) AS BIGINT) AS errors, quantile_disc(elapsed_ms, 0.5) AS p50_ms, quantile_disc(elapsed_ms, 0.95) AS p95_ms,
  max(elapsed_ms) AS max_ms, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM runs) - 7 * 86400) AS n_recent, max(ts) AS last_ts FROM runs GROUP BY event_type""",
        v.RUNS_SQL,
    ),
)
def a12_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(v.runs(spark, sf_dir))


@query("a14_stats", v.with_views("SELECT kind, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(score), 6) AS mean_score FROM extractions GROUP BY kind", v.EXTRACTIONS_SQL))
def a14_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by kind."""
    return v.extractions(spark, sf_dir).groupBy("kind").agg(
        F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.round(F.avg("score"), 6).alias("mean_score")
    )


@query("a14_top_folders", v.with_views("SELECT cwd, count(*) AS n FROM messages GROUP BY 1 ORDER BY n DESC, cwd LIMIT 10", v.MESSAGES_SQL))
def a14_top_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten folders with the most messages."""
    return v.messages(spark, sf_dir).groupBy("cwd").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwd").limit(10)


@query(
    "a16_top_topics",
    v.with_views(
        """SELECT project_key, content, score, rank FROM (SELECT project_key, content, score, row_number() OVER (PARTITION BY project_key ORDER BY score DESC, ts DESC, content) AS rank
  FROM (SELECT project_key, content, max(score) AS score, max(ts) AS ts FROM extractions GROUP BY 1, 2)) WHERE rank <= 5""",
        v.EXTRACTIONS_SQL,
    ),
)
def a16_top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's five best facts, equal contents taken as one."""
    own = v.extractions(spark, sf_dir).groupBy("project_key", "content").agg(F.max("score").alias("score"), F.max("ts").alias("ts"))
    rank = F.row_number().over(W.partitionBy("project_key").orderBy(F.desc("score"), F.desc("ts"), "content")).alias("rank")
    return own.select("project_key", "content", "score", rank).filter("rank <= 5")


@query("a17_sessions_by_project", v.with_views("SELECT project_key, count(DISTINCT session_id) AS sessions FROM messages GROUP BY 1", v.MESSAGES_SQL))
def a17_sessions_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each project."""
    return v.messages(spark, sf_dir).groupBy("project_key").agg(F.countDistinct("session_id").alias("sessions"))


@query(
    "a18_session_list",
    v.with_views(
        """SELECT session_id, arg_max(cwd, seq) AS cwd, arg_max(project_key, seq) AS project_key, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
  arg_max(text, seq) FILTER (WHERE role = 'user') AS last_prompt, arg_min(text, seq) FILTER (WHERE role = 'user') AS title FROM messages GROUP BY session_id""",
        v.MESSAGES_SQL,
    ),
)
def a18_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's bounds, latest folder, first and last prompt."""
    user = F.when(F.col("role") == "user", F.col("seq"))
    return v.messages(spark, sf_dir).groupBy("session_id").agg(
        F.max_by("cwd", "seq").alias("cwd"),
        F.max_by("project_key", "seq").alias("project_key"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n"),
        F.max_by("text", user).alias("last_prompt"),
        F.min_by("text", user).alias("title"),
    )


@query(
    "a19_session_kinds",
    v.with_views(
        """SELECT session_id, kind, n, rank FROM (SELECT session_id, kind, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, kind) AS rank
  FROM (SELECT session_id, kind, count(*) AS n FROM extractions GROUP BY 1, 2)) WHERE rank <= 5""",
        v.EXTRACTIONS_SQL,
    ),
)
def a19_session_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's five most frequent kinds of fact."""
    own = v.extractions(spark, sf_dir).groupBy("session_id", "kind").agg(F.count("*").alias("n"))
    return own.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("n"), "kind"))).filter("rank <= 5")


def trigger_precision(outcomes: DataFrame, least: int = 50) -> DataFrame:
    """For each trigger the mean of Beta(useful + 1, useless + 1) and what to do about it."""
    own = outcomes.select(F.explode("triggers").alias("trigger"), "outcome").groupBy("trigger")
    sums = own.agg(F.count(F.when(F.col("outcome") == "useful", 1)).alias("useful"), F.count(F.when(F.col("outcome") == "useless", 1)).alias("useless"))
    mean = (F.col("useful") + 1) / (F.col("useful") + F.col("useless") + 2)
    n = F.col("useful") + F.col("useless")
    return sums.withColumn("precision", F.round(mean, 6)).withColumn("advice", F.when((n >= least) & (mean < 0.5), "tighten").when((n >= least) & (mean > 0.95), "loosen").otherwise("keep"))


@query(
    "a26_trigger_precision",
    """SELECT trigger, useful, useless, round((useful + 1) / (useful + useless + 2), 6) AS precision,
  CASE WHEN useful + useless >= 50 AND (useful + 1) / (useful + useless + 2) < 0.5 THEN 'tighten' WHEN useful + useless >= 50 AND (useful + 1) / (useful + useless + 2) > 0.95 THEN 'loosen' ELSE 'keep' END AS advice
FROM (SELECT trigger, count(*) FILTER (WHERE value > 20) AS useful, count(*) FILTER (WHERE value <= 20) AS useless
  FROM (SELECT unnest([event_type, 'user' || user_id % 3]) AS trigger, value FROM events) GROUP BY 1)""",
)
def a26_trigger_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string"))).alias("triggers")
    return trigger_precision(v.table(spark, sf_dir, "events").select(triggers, F.when(F.col("value") > 20, "useful").otherwise("useless").alias("outcome")))
