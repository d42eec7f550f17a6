"""What transcripts hold beyond text: turns, compactions, text blocks, tool uses with their results, durations, shapes of sessions
(F03, F04, F06, J10, J11, A04, A15, K03 over parsed lines).

The given conversations become transcript lines by the rules of RULES, are parsed as any other transcript, and the SQL
states the same rules without the detour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake import views as v
from threadlake.queries import query
from threadlake.sources import records
from threadlake.sources.records import field

# Which messages have what, in SQL that both engines read.
RULES = {
    "repeats": "seq % 2 = 0",  # its text block twice
    "uses_tool": "seq % 3 <> 0",
    "has_usage": "seq % 5 <> 0",
    "has_result": "seq % 4 = 0 AND parent_uuid IS NOT NULL",
    "has_two_results": "seq % 12 = 0",
    "has_duration": "role = 'assistant' AND seq % 7 = 0",  # a line of its own after the message's
    "has_compaction": "role = 'assistant' AND seq % 11 = 0",
}
TOOLS = ["Read", "Edit", "Bash"]


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, seq, line): the conversations as transcript lines."""
    m = v.messages(spark, sf_dir)
    when = lambda rule, x: F.when(F.expr(RULES[rule]), x)
    number = F.col("seq").cast("string")
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    blocks_type = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
    block = lambda **c: F.struct(*(c.get(n, F.lit(None)).cast(k).alias(n) for n, k in (x.split(":") for x in blocks_type[13:-2].split(","))))
    said = block(type=F.lit("text"), text=F.col("text"))
    thought = block(type=F.lit("thinking"), text=F.lit("hm"))
    use = block(type=F.lit("tool_use"), id=F.concat(F.lit("tu"), number), name=F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("seq") % 3 + 1).cast("int")), input=F.lit("{}"))
    result = lambda tail: block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("tu"), (F.col("seq") - 1).cast("string")), is_error=F.expr("seq % 8 = 0"), content=F.concat(F.lit("r"), number, F.lit(tail)))
    assistant = F.array_compact(F.array(thought, said, when("repeats", said), when("uses_tool", use)))
    user = F.array_compact(F.array(result("a"), when("has_two_results", result("b"))))
    usage = when("has_usage", F.struct(F.length("text").alias("input_tokens"), (F.col("seq") % 100).alias("output_tokens")))
    head = {
        "type": F.col("role"),
        "sessionId": F.col("session_id"),
        "uuid": F.col("message_uuid"),
        "parentUuid": F.col("parent_uuid"),
        "timestamp": F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "cwd": F.col("cwd"),
    }
    line = lambda **more: F.to_json(F.struct(*(x.alias(k) for k, x in (head | more).items())))
    after = lambda tail, **more: line(type=F.lit("system"), uuid=F.concat("message_uuid", F.lit(tail)), parentUuid=F.col("message_uuid"), **more)
    sizes = F.struct((F.col("seq") % 500 + 1000).alias("preTokens"), (F.col("seq") % 300).alias("postTokens"), F.expr("CASE WHEN seq % 3 = 0 THEN 'manual' ELSE 'auto' END").alias("trigger"))
    own = (
        F.when(F.col("role") == "assistant", line(message=F.struct(F.lit("m").alias("model"), assistant.alias("content"), usage.alias("usage"))))
        .when((F.col("role") == "user") & F.expr(RULES["has_result"]), line(message=F.struct(user.alias("content"))))
        .when(F.col("role") == "user", line(message=F.struct(text["text"].alias("content"))))
        .otherwise(line(subtype=F.lit("away_summary"), content=F.col("text")))
    )
    lines = F.array_compact(
        F.array(
            own,
            when("has_duration", after("-d", subtype=F.lit("turn_duration"), durationMs=F.col("seq") % 977)),
            when("has_compaction", after("-c", subtype=F.lit("compact_boundary"), compactMetadata=sizes)),
        )
    )
    return m.select(F.lit("x.jsonl").alias("file"), "seq", F.posexplode(lines).alias("place", "line")).select("file", (F.col("seq") * 10 + F.col("place")).alias("seq"), "line")


@query("f03_turns", v.with_views(f"SELECT message_uuid, 'm' AS model, length(text) AS input_tokens, seq % 100 AS output_tokens FROM messages WHERE role = 'assistant' AND {RULES['has_usage']}", v.MESSAGES_SQL))
def f03_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the assistant's messages that state their usage."""
    return records.turns(raw_lines(spark, sf_dir)).select("message_uuid", "model", "input_tokens", "output_tokens")


_COMPACTIONS = f"SELECT session_id, message_uuid || '-c' AS message_uuid, ts, seq % 500 + 1000 AS pre_tokens, seq % 300 AS post_tokens, CASE WHEN seq % 3 = 0 THEN 'manual' ELSE 'auto' END AS trigger FROM messages WHERE {RULES['has_compaction']}"


@query("f04_compactions", v.with_views(_COMPACTIONS, v.MESSAGES_SQL))
def f04_compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compaction boundaries with their sizes and trigger."""
    return records.compactions(raw_lines(spark, sf_dir)).select("session_id", "message_uuid", "ts", "pre_tokens", "post_tokens", "trigger")


@query("a04_compactions", v.with_views(f"SELECT trigger, count(*) AS n, CAST(sum(pre_tokens - post_tokens) AS BIGINT) AS freed FROM ({_COMPACTIONS}) GROUP BY 1", v.MESSAGES_SQL))
def a04_compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compactions by trigger, and the tokens they freed."""
    return f04_compactions(spark, sf_dir).groupBy("trigger").agg(F.count("*").alias("n"), F.sum(F.col("pre_tokens") - F.col("post_tokens")).cast("long").alias("freed"))


@query("f06_text_blocks", v.with_views("SELECT message_uuid, text, 1 AS n_blocks FROM messages WHERE role = 'assistant' AND trim(text) <> ''", v.MESSAGES_SQL))
def f06_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the assistant's text blocks, each distinct one once, in order; thinking and tool blocks are none."""
    own = records.text_blocks(raw_lines(spark, sf_dir))
    return own.select("message_uuid", F.array_join("blocks", "\n").alias("text"), F.size("blocks").alias("n_blocks"))


@query(
    "j10_durations",
    v.with_views(
        f"SELECT message_uuid, CASE WHEN {RULES['has_duration']} THEN seq % 977 END AS duration_ms FROM messages WHERE role = 'assistant' AND {RULES['has_usage']}",
        v.MESSAGES_SQL,
    ),
)
def j10_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the duration that a later system record states for them."""
    lines = raw_lines(spark, sf_dir)
    turns = records.turns(lines).withColumn("duration_ms", F.lit(None).cast("long"))
    return records.with_durations(turns, lines).select("message_uuid", "duration_ms")


@query(
    "j11_tool_pairs",
    v.with_views(
        f"""SELECT u.session_id, 'tu' || u.seq AS tool_use_id, (['Read', 'Edit', 'Bash'])[u.seq % 3 + 1] AS name, CASE WHEN r.seq IS NOT NULL THEN 'r' || r.seq || CASE WHEN r.seq % 12 = 0 THEN 'b' ELSE 'a' END END AS result, r.seq % 8 = 0 AS is_error
FROM (SELECT * FROM messages WHERE role = 'assistant' AND {RULES['uses_tool']}) u LEFT JOIN (SELECT * FROM messages WHERE role = 'user' AND {RULES['has_result']}) r ON r.session_id = u.session_id AND r.seq = u.seq + 1""",
        v.MESSAGES_SQL,
    ),
)
def j11_tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use of a tool with its last result; uses without one stay."""
    return records.tool_pairs(raw_lines(spark, sf_dir)).select("session_id", "tool_use_id", "name", "result", "is_error")


@query(
    "a15_inspect",
    v.with_views(
        f"""children AS (SELECT session_id, parent_uuid FROM messages WHERE parent_uuid IS NOT NULL UNION ALL SELECT session_id, message_uuid FROM messages WHERE {RULES['has_duration']}
  UNION ALL SELECT session_id, message_uuid FROM messages WHERE {RULES['has_compaction']}),
forks AS (SELECT session_id, count(*) AS branches FROM (SELECT session_id, parent_uuid FROM children GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT session_id, count(*) + count(*) FILTER (WHERE {RULES['has_duration']}) + count(*) FILTER (WHERE {RULES['has_compaction']}) AS n, count(*) FILTER (WHERE role = 'user') AS n_user,
  count(*) FILTER (WHERE role = 'assistant') AS n_assistant, coalesce(max(branches), 0) AS branches FROM messages LEFT JOIN forks USING (session_id) GROUP BY 1""".replace("children AS", ", children AS", 1),
        v.MESSAGES_SQL,
    ),
)
def a15_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each session by role, and its parents with more than one child."""
    m = records.parse_claude(raw_lines(spark, sf_dir))
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    sizes = m.groupBy("session_id").agg(F.count("*").alias("n"), count("user").alias("n_user"), count("assistant").alias("n_assistant"))
    parents = m.filter("parent_uuid IS NOT NULL").groupBy("session_id", "parent_uuid").agg(F.count("*").alias("k")).filter("k > 1")
    forks = parents.groupBy("session_id").agg(F.count("*").alias("branches"))
    return sizes.join(forks, "session_id", "left").withColumn("branches", F.coalesce("branches", F.lit(0)))
