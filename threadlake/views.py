"""The engine's tables derived from the given ones by fixed rules, in DataFrame form and in SQL.

The given conversations hold no transcript metadata and no phrase that the extraction rules look for, so the
derived tables add metadata computed from the keys and put a fixed phrase, chosen by the keys, before
each message. The rules below are the same in both forms; nothing is written to the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.text import project_key

EPOCH = 1704067200
SOURCES = ["claude_code", "codex", "opencode", "gemini_cli", "cursor", "continue", "cline", "aider", "goose", "grok", "pi"]
USER_PHRASES = [
    "no, use tabs not spaces. ",
    "we never use global state in tests. ",
    "goal: ship the importer. ",
    "i said use parquet not csv. ",
    "perfect, that works. ",
    "don't mock the database again. ",
    "we tried sqlite but it failed. ",
    "stop guessing, you always break the build. ",
    "we chose spark over pandas because it scales. ",
    "why did you delete it? ",
    "deploy it ",
    "[x] parser ~80 %\n[ ] docs\n",
    "",
]
ASSISTANT_PHRASES = [
    "Done. Wired the parser.\n\n",
    "You're right, that was missed.\n\n",
    "We should use spark instead of pandas because it scales. ",
    "Shipped the fix.\n\n",
    "Next: write the tests.\n\n",
    "",
    "",
    "",
    "",
]
MODELS = {"click": "claude-sonnet-4", "view": "claude-opus-4", "purchase": "gpt-5", "signup": "gemini-2.5-pro"}


def seconds() -> Column:
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")  # whatever the session's time zone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: list[str], at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    uuid = lambda t: F.concat_ws("-", conv.cast("string"), t.cast("string"))
    cwd = F.concat(F.lit("/proj/p"), (conv % 7).cast("string"), F.when(conv % 5 == 0, F.concat(F.lit("/.worktrees/w"), (conv % 3).cast("string"))).otherwise(""))
    phrase = F.when(F.col("role") == "user", _choice(USER_PHRASES, (conv * 31 + turn) % len(USER_PHRASES))).when(
        F.col("role") == "assistant", _choice(ASSISTANT_PHRASES, (conv * 31 + turn) % len(ASSISTANT_PHRASES))
    )
    return c.select(
        (conv * 1000 + turn).alias("seq"),
        F.concat(F.lit("s"), conv.cast("string")).alias("session_id"),
        cwd.alias("cwd"),
        project_key(cwd).alias("project_key"),
        "role",
        F.col("role").alias("kind"),
        (F.lit(EPOCH) + conv * 3600 + turn * 60).alias("ts"),
        F.when(turn > 0, uuid(turn - 1)).alias("parent_uuid"),
        uuid(turn).alias("message_uuid"),
        _choice(SOURCES, conv % len(SOURCES)).alias("source"),
        F.concat(F.coalesce(phrase, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as graphs: some hang on the message before the last one, so that sessions branch, and some are side-chains."""
    conv, turn = F.floor(F.col("seq") / 1000).cast("long"), F.col("seq") % 1000
    back = F.concat_ws("-", conv.cast("string"), (turn - 2).cast("string"))
    m = messages(spark, sf_dir)
    return m.withColumns({"parent_uuid": F.when((turn >= 2) & ((conv * 7 + turn) % 5 == 0), back).otherwise(F.col("parent_uuid")), "is_sidechain": (turn > 0) & ((conv + turn) % 9 == 0)})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.create_map(*(F.lit(x) for pair in MODELS.items() for x in pair))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("/proj/p"), (F.col("user_id") % 7).cast("string")).alias("cwd"),
        seconds().alias("ts"),
        F.element_at(model, F.col("event_type")).alias("model"),
        F.floor("value").cast("long").alias("input_tokens"),
        (F.col("event_id") % 13).alias("cache_creation_tokens"),
        (F.col("event_id") % 101).alias("cache_read_tokens"),
        k.alias("output_tokens"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 977).alias("duration_ms"),
        F.col("event_id").cast("string").alias("message_uuid"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest runs and operational events, from the events of two types."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return e.select(
        F.col("event_id").alias("id"),
        seconds().alias("ts"),
        "event_type",
        F.round(F.col("value") * 10, 1).alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("errors"),
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    kinds = ["correction", "decision", "preference", "domain_fact", "progress", "goal", "ban", "model_correction", "away_summary", "truth_assertion"]
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        _choice(kinds, F.col("doc_id") % 10).alias("kind"),
        F.col("text").alias("content"),
        F.concat(F.lit("s"), (F.col("doc_id") % 97).cast("string")).alias("session_id"),
        "source",
        F.concat(F.lit("/proj/"), F.col("source")).alias("project_key"),
        (F.lit(EPOCH) + F.col("doc_id") * 977 % 7776000).alias("ts"),
        (F.coalesce(F.col("quality"), F.lit(0)) * 0.5 + 0.4).cast("double").alias("score"),
    )


def extraction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content) of the extractions, without the join that gives the rest; a document has one row of labels at most."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


MESSAGES_SQL = f"""messages AS (
  SELECT conv_id * 1000 + turn AS seq, 's' || conv_id AS session_id,
    '/proj/p' || conv_id % 7 || CASE WHEN conv_id % 5 = 0 THEN '/.worktrees/w' || conv_id % 3 ELSE '' END AS cwd,
    '/proj/p' || conv_id % 7 AS project_key, role, role AS kind, {EPOCH} + conv_id * 3600 + turn * 60 AS ts,
    CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_uuid, conv_id || '-' || turn AS message_uuid,
    ({_sql_list(SOURCES)})[conv_id % {len(SOURCES)} + 1] AS source,
    coalesce(CASE role WHEN 'user' THEN ({_sql_list(USER_PHRASES)})[(conv_id * 31 + turn) % {len(USER_PHRASES)} + 1]
      WHEN 'assistant' THEN ({_sql_list(ASSISTANT_PHRASES)})[(conv_id * 31 + turn) % {len(ASSISTANT_PHRASES)} + 1] END, '') || coalesce(text, '') AS text
  FROM conversations)"""

THREADS_SQL = f"""{MESSAGES_SQL}, threads AS (
  SELECT seq, session_id, cwd, project_key, role, kind, ts, CASE WHEN seq % 1000 >= 2 AND (seq // 1000 * 7 + seq % 1000) % 5 = 0 THEN (seq // 1000) || '-' || (seq % 1000 - 2) ELSE parent_uuid END AS parent_uuid,
    message_uuid, source, text, seq % 1000 > 0 AND (seq // 1000 + seq % 1000) % 9 = 0 AS is_sidechain FROM messages)"""

TURNS_SQL = """turns AS (
  SELECT 'u' || user_id AS session_id, '/proj/p' || user_id % 7 AS cwd, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
    CASE event_type WHEN 'click' THEN 'claude-sonnet-4' WHEN 'view' THEN 'claude-opus-4' WHEN 'purchase' THEN 'gpt-5' WHEN 'signup' THEN 'gemini-2.5-pro' END AS model,
    CAST(floor(value) AS BIGINT) AS input_tokens, event_id % 13 AS cache_creation_tokens, event_id % 101 AS cache_read_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens,
    CASE WHEN event_id % 4 <> 0 THEN event_id % 977 END AS duration_ms, CAST(event_id AS VARCHAR) AS message_uuid
  FROM events)"""

RUNS_SQL = """runs AS (
  SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type, round(value * 10, 1) AS elapsed_ms,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors
  FROM events WHERE event_type IN ('signup', 'error'))"""

EXTRACTIONS_SQL = f"""extractions AS (
  SELECT d.doc_id AS id, (['correction', 'decision', 'preference', 'domain_fact', 'progress', 'goal', 'ban', 'model_correction', 'away_summary', 'truth_assertion'])[d.doc_id % 10 + 1] AS kind,
    text AS content, 's' || d.doc_id % 97 AS session_id, source, '/proj/' || source AS project_key,
    {EPOCH} + d.doc_id * 977 % 7776000 AS ts, CAST(coalesce(quality, 0) * 0.5 + 0.4 AS DOUBLE) AS score
  FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id)"""


def with_views(sql: str, *views: str) -> str:
    """SQL that may begin with more common tables (`, name AS (...) SELECT ...`) over derived tables."""
    return "WITH " + ", ".join(views) + " " + sql
