"""Sources and sinks applied to the given tables (S01, S16-S18, K01-K03, I03, I07, C02, N-functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake import views as v
from threadlake.functions import text as t
from threadlake.queries import query
from threadlake.sources import records, sinks
from threadlake.streaming import ingest


@query(
    "s01_transcripts",
    v.with_views("SELECT session_id, seq, role, ts, message_uuid AS uuid, parent_uuid, cwd, text FROM messages", v.MESSAGES_SQL),
)
def s01_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcript lines and parsed back."""
    m = v.messages(spark, sf_dir)
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    line = F.to_json(
        F.struct(
            F.col("role").alias("type"),
            F.col("session_id").alias("sessionId"),
            F.col("message_uuid").alias("uuid"),
            F.col("parent_uuid").alias("parentUuid"),
            iso.alias("timestamp"),
            "cwd",
            F.struct("role", F.col("text").alias("content")).alias("message"),
        )
    )
    raw = m.select(F.lit("x.jsonl").alias("file"), "seq", line.alias("line"))
    return records.parse_claude(raw).select("session_id", "seq", "role", "ts", "uuid", "parent_uuid", "cwd", "text")


@query(
    "k01_append",
    "SELECT event_type, user_id AS k, min(event_id) AS event_id FROM events b WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_id % 2 = 0 AND a.event_type = b.event_type AND a.user_id = b.user_id) GROUP BY 1, 2",
)
def k01_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch adds to a table under a unique key."""
    e = v.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("k"))
    return sinks.new_rows(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0"), ["event_type", "k"], "event_id").select("event_type", "k", "event_id")


@query(
    "k02_rotated",
    "SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 AND event_type <> 'error' UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 2 = 1 AND event_type = 'error'",
)
def k02_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotated file's rows replaced."""
    e = v.table(spark, sf_dir, "events").select("event_id", "event_type")
    return sinks.replaced(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1 AND event_type = 'error'"), "event_type").select("event_id", "event_type")


@query("i07_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def i07_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I07 (an extension): hourly counts, with the code the stream uses."""
    out = ingest.windowed_counts(v.table(spark, sf_dir, "events"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "i03_ema",
    """SELECT coalesce(o.user_id, n.user_id) AS user_id, round(coalesce(o.value + least(1.0, k / 50) * (n.value - o.value), o.value, n.value), 6) AS value
FROM (SELECT user_id, avg(value) AS value FROM events WHERE event_id % 10 < 8 GROUP BY 1) o FULL JOIN (SELECT user_id, avg(value) AS value, count(*) AS k FROM events WHERE event_id % 10 >= 8 GROUP BY 1) n ON o.user_id = n.user_id""",
)
def i03_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles moved by a batch."""
    e = v.table(spark, sf_dir, "events")
    old = e.filter("event_id % 10 < 8").groupBy("user_id").agg(F.avg("value").alias("value"))
    return ingest.ema(old, e.filter("event_id % 10 >= 8"), "user_id", "value", 50).select("user_id", F.round("value", 6).alias("value"))


@query(
    "n01_text_keys",
    f"SELECT doc_id, {t.correction_key_sql('text')} AS correction_key, {t.CONTENT_KEY_SQL.format('text')} AS content_key, rtrim(lower(trim(text)), '.,;:!?') AS thing FROM documents",
)
def n01_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys by which corrections, contents and things are told apart."""
    c = F.col("text")
    return v.table(spark, sf_dir, "documents").select(
        "doc_id",
        t.correction_key(c).alias("correction_key"),
        t.content_key(c).alias("content_key"),
        F.rtrim(F.lower(F.trim(c)), F.lit(".,;:!?")).alias("thing"),
    )


@query(
    "f01_project_keys",
    """SELECT cwd, CASE WHEN strpos(bare, '/.claude/worktrees/') > 0 THEN substr(bare, 1, strpos(bare, '/.claude/worktrees/') - 1) WHEN strpos(bare, '/.worktrees/') > 0 THEN substr(bare, 1, strpos(bare, '/.worktrees/') - 1) ELSE bare END AS project_key
FROM (SELECT cwd, CASE WHEN rtrim(cwd, '/') = '' THEN '/' ELSE rtrim(cwd, '/') END AS bare FROM (SELECT DISTINCT (['/', '/p/' || user_id, '/p/' || user_id || '/', '/p/' || user_id || '/.claude/worktrees/w1', '/p/' || user_id || '/.worktrees/w2/x'])[event_id % 5 + 1] AS cwd FROM events))""",
)
def f01_project_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """projects of working folders."""
    u = F.concat(F.lit("/p/"), F.col("user_id").cast("string"))
    forms = F.array(F.lit("/"), u, F.concat(u, F.lit("/")), F.concat(u, F.lit("/.claude/worktrees/w1")), F.concat(u, F.lit("/.worktrees/w2/x")))
    cwds = v.table(spark, sf_dir, "events").select(F.get(forms, (F.col("event_id") % 5).cast("int")).alias("cwd")).distinct()
    return cwds.select("cwd", t.project_key(F.col("cwd")).alias("project_key"))


def codex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, seq, line): the conversations as the second tool's lines: assistants call, all but every fourth call has an output, then tokens are counted."""
    m = v.messages(spark, sf_dir)
    number = F.col("seq").cast("string")
    line = lambda kind, **p: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*(x.alias(k) for k, x in p.items())).alias("payload")))
    bot = F.col("role") == "assistant"
    said = line("response_item", type=F.lit("message"), role=F.col("role"), content=F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))))
    call = line("response_item", type=F.lit("function_call"), name=F.lit("shell"), call_id=F.concat(F.lit("c"), number), arguments=F.to_json(F.struct(F.col("seq").alias("n"))))
    out = line("response_item", type=F.lit("function_call_output"), call_id=F.concat(F.lit("c"), number), output=F.struct(F.col("text").alias("text"), (F.col("seq") % 3 == 0).alias("is_error")))
    count = line("event_msg", type=F.lit("token_count"), info=F.struct((F.col("seq") % 1000 * 50 % 170).alias("input_tokens"), (F.col("seq") % 1000 * 7).alias("output_tokens")))
    lines = F.array_compact(F.array(said, F.when(bot, call), F.when(bot & (F.col("seq") % 4 != 0), out), count))
    return m.select(F.concat(F.lit("rollout-"), F.lpad("session_id", 36, "0"), F.lit(".jsonl")).alias("file"), "seq", F.posexplode(lines).alias("place", "line")).select("file", (F.col("seq") * 10 + F.col("place")).alias("seq"), "line")


@query(
    "s05_codex_calls",
    v.with_views("SELECT lpad(session_id, 36, '0') AS session_id, 'c' || seq AS tool_use_id, 'shell' AS name, '{\"n\":' || seq || '}' AS input, CASE WHEN seq % 4 <> 0 THEN text END AS output, CASE WHEN seq % 4 <> 0 THEN seq % 3 = 0 END AS is_error FROM messages WHERE role = 'assistant'", v.MESSAGES_SQL),
)
def s05_codex_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their outputs."""
    return records.codex_calls(codex_lines(spark, sf_dir)).select("session_id", "tool_use_id", "name", "input", "output", "is_error")


@query(
    "s05_codex_tokens",
    v.with_views(
        """SELECT lpad(session_id, 36, '0') AS session_id, seq, CASE WHEN i >= i0 THEN i - i0 ELSE i END AS input_tokens, CASE WHEN o >= o0 THEN o - o0 ELSE o END AS output_tokens FROM (SELECT *, lag(i, 1, 0) OVER w AS i0, lag(o, 1, 0) OVER w AS o0
FROM (SELECT session_id, seq, seq % 1000 * 50 % 170 AS i, seq % 1000 * 7 AS o FROM messages) WINDOW w AS (PARTITION BY session_id ORDER BY seq))""",
        v.MESSAGES_SQL,
    ),
)
def s05_codex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each count adds to the one before."""
    return records.codex_tokens(codex_lines(spark, sf_dir)).select("session_id", F.floor(F.col("seq") / 10).alias("seq"), "input_tokens", "output_tokens")
