"""What a session needs to go on after a compaction, and the work that is done again after one.

The given conversations become transcript lines by the rules of RULES; the SQL states the same rules without the detour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake import views as v
from threadlake.functions.text import project_key
from threadlake.queries import query
from threadlake.sources.records import epoch, field

# Tools and the fields of their input, envelopes that are no directive, what marks plans and failures, sizes.
FILE_TOOLS = ["Edit", "Write", "Read", "NotebookEdit", "MultiEdit"]
READING_TOOLS = ["Read", "Bash", "NotebookEdit", "Grep", "Glob"]
PATHS = ["file_path", "path", "notebook_path"]
OTHER_ARGUMENTS = ["pattern", "query", "url", "description"]
ENVELOPES = ["<task-notification>", "<command-message>", "<command-name>", "<local-command-stdout>", "<local-command-stderr>", "<system-reminder>"]
PLAN = r"(?i)(next:|plan:|todo:|remaining)"
FAILURE = "error|traceback|command failed"
PARTS = ["active_goal", "last_user_directive", "files_in_flight", "last_actions", "decisions_this_session", "open_plan", "next_step", "failed_attempts_this_session"]
TAIL, HEAD, BUDGET, FILES, ACTIONS = 400, 80, 2000, 5, 3

_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
_KEY = ["file", "boundary"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _first(json: Column, names: list[str]) -> Column:
    """The first field with a text that isn't blank."""
    return F.coalesce(*(F.nullif(_strip(field(json, f"$.{n}")), F.lit("")) for n in names))


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    both = F.to_json(F.array(c))
    return F.substring(both, F.lit(2), F.length(both) - 2)


def work(raw: DataFrame) -> DataFrame:
    """Lines (file, seq, line) as records: place in the file, texts, tool uses and results. Lines that are no JSON object go."""
    j = "line"
    good = raw.filter(F.trim(j).startswith("{") & field(j, "$").isNotNull()).withColumn("pos", F.row_number().over(W.partitionBy("file").orderBy("seq")))
    content = field(j, "$.message.content")
    blocks = F.when(field(j, "$.message.content[0]").isNotNull(), F.from_json(content, _BLOCKS))
    texts = F.filter(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: _strip(b["text"])), lambda t: t != "")
    listed = lambda c: F.from_json(c, "array<struct<type:string,text:string>>")
    said = lambda c: F.array_join(F.transform(F.filter(listed(c), lambda p: p["type"] == "text"), lambda p: p["text"]), " ")
    flat = lambda c: F.when(c.startswith("[") & listed(c).isNotNull(), said(c)).otherwise(c)
    command = lambda b: F.when(b["name"] == "Bash", F.left(_first(b["input"], ["command"]), F.lit(HEAD)))
    use = lambda b, i: F.struct(
        F.col("pos").alias("pos"),
        i.alias("place"),
        b["id"].alias("id"),
        b["name"].alias("name"),
        _first(b["input"], PATHS).alias("path"),
        command(b).alias("command"),
        F.coalesce(command(b), _first(b["input"], PATHS), F.left(_first(b["input"], OTHER_ARGUMENTS), F.lit(HEAD))).alias("arg"),
        F.array_compact(F.array(command(b), *(F.nullif(_strip(field(b["input"], f"$.{n}")), F.lit("")) for n in PATHS))).alias("targets"),
        F.when(b["name"] == "Bash", command(b)).otherwise(_first(b["input"], [*PATHS, "pattern"])).alias("target"),
        F.when((b["name"] == "TodoWrite") & b["input"].startswith("{"), b["input"]).alias("todo"),
    )
    failed = lambda b: F.coalesce(b["is_error"], F.lit(False)) | F.coalesce(F.lower(flat(b["content"])).rlike(FAILURE), F.lit(False))
    result = lambda b, i: F.struct(F.col("pos").alias("pos"), i.alias("place"), b["tool_use_id"].alias("id"), failed(b).alias("failed"))
    of = lambda kind, make: F.filter(F.transform("blocks", lambda b, i: F.when(b["type"] == kind, make(b, i))), lambda x: x.isNotNull())
    meta = F.coalesce(field(j, "$.isMeta"), F.lit("")).eqNullSafe("true") | F.coalesce(field(j, "$.isCompactSummary"), F.lit("")).eqNullSafe("true")
    own = good.withColumns({"blocks": blocks, "content": content}).withColumn("text", F.when(F.col("blocks").isNotNull(), F.array_join(texts, "\n")).otherwise(_strip("content")))
    own = own.withColumn("text", F.nullif("text", F.lit("")))
    enveloped = reduce(lambda a, b: a | b, (F.col("text").startswith(e) for e in ENVELOPES))
    return own.select(
        "file",
        "pos",
        F.coalesce(field(j, "$.sessionId"), F.regexp_extract("file", "([^/]+)\\.jsonl$", 1)).alias("session_id"),
        field(j, "$.uuid").alias("message_uuid"),
        field(j, "$.cwd").alias("cwd"),
        epoch(field(j, "$.timestamp")).alias("ts"),
        ((field(j, "$.type") == "system") & (field(j, "$.subtype") == "compact_boundary")).eqNullSafe(True).alias("is_boundary"),
        F.when((field(j, "$.type") == "user") & ~meta & ~enveloped, F.col("text")).alias("directive"),
        F.when(field(j, "$.message.role") == "assistant", F.col("text")).alias("answer"),
        of("tool_use", use).alias("uses"),
        of("tool_result", result).alias("results"),
    )


def boundaries(records: DataFrame) -> DataFrame:
    """The compactions: their file and place there, session, id, time and folder."""
    return records.filter("is_boundary").select("file", F.col("pos").alias("boundary"), "session_id", "message_uuid", "ts", "cwd")


def _tails(records: DataFrame, tail: int) -> DataFrame:
    """Each boundary's last `tail` records before it, met by stretches of the file of that length: two for a boundary."""
    at = F.col("boundary")
    stretches = F.array_distinct(F.array(F.floor((at - tail) / tail), F.floor((at - 1) / tail)))
    ends = boundaries(records).select(*_KEY, F.explode(stretches).alias("stretch"))
    own = records.select("file", "pos", "directive", "answer", "uses", "results", F.floor(F.col("pos") / tail).alias("stretch"))
    return ends.join(own, ["file", "stretch"]).filter(F.col("pos").between(at - tail, at - 1))


def _newest(rows: Column, forward: bool) -> Column:
    """Newest record first; within a record in its order or against it."""
    sign = -1 if forward else 1
    keyed = F.transform(rows, lambda r: F.struct(r["pos"].alias("at"), (r["place"] * sign).alias("within"), r.alias("r")))
    return F.transform(F.sort_array(keyed, asc=False), lambda k: k["r"])


def _listed(items: Column) -> Column:
    """A part that lists JSON objects: each with the length that a budget counts."""
    return F.when(F.size(items) > 0, F.transform(items, lambda x: F.struct(x.alias("json"), F.length(x).alias("size"))))


def in_flight(records: DataFrame, tail: int = TAIL) -> DataFrame:
    """For each boundary what was asked last, files in flight, last actions, the plan and the next step.

    A boundary's records are at most `tail`, so what is listed for it is bounded. Boundaries with nothing before are not there.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    plan = F.when(F.col("answer").rlike(PLAN), F.col("pos"))
    own = _tails(records, tail).groupBy(*_KEY).agg(
        last("directive").alias("directive"),
        last("answer").alias("answer"),
        F.max_by("answer", plan).alias("plan"),
        F.flatten(F.collect_list("uses")).alias("uses"),
        F.flatten(F.collect_list("results")).alias("results"),
    )
    own = own.withColumns({"forward": _newest(F.col("uses"), True), "backward": F.slice(_newest(F.col("uses"), False), 1, ACTIONS), "answered": _newest(F.col("results"), False)})
    touched = F.filter("forward", lambda u: u["name"].isin(FILE_TOOLS) & u["path"].isNotNull())
    own = own.withColumn("touched", touched).withColumn("paths", F.slice(F.array_distinct(F.transform("touched", lambda u: u["path"])), 1, FILES))
    of = lambda p: F.filter("touched", lambda u: u["path"] == p)
    file = lambda p: F.to_json(F.struct(p.alias("path"), F.get(of(p), F.lit(0))["name"].alias("verb"), F.size(of(p)).alias("count")))
    ok = lambda u: ~F.coalesce(F.get(F.filter("answered", lambda r: r["id"] == u["id"]), F.lit(0))["failed"], F.lit(False))
    action = lambda u: F.to_json(F.struct(u["name"].alias("tool"), u["arg"].alias("arg"), ok(u).alias("ok")), {"ignoreNullFields": "false"})
    todo = F.get(F.filter(F.transform("forward", lambda u: u["todo"]), lambda t: t.isNotNull()), F.lit(0))
    steps = F.filter(F.transform(F.split("answer", r"(?<=[.!?])\s+"), _strip), lambda s: s != "")
    todos = F.transform(F.from_json(field(F.col("todo"), "$.todos"), "array<string>"), lambda x: F.when(x.startswith("{"), x).otherwise(_quoted(x)))
    return own.withColumn("todo", todo).select(
        *_KEY,
        F.col("directive").alias("last_user_directive"),
        _listed(F.transform("paths", file)).alias("files_in_flight"),
        _listed(F.transform("backward", action)).alias("last_actions"),
        _listed(F.when(field(F.col("todo"), "$.todos").startswith("["), todos)).alias("todos"),
        F.when(F.coalesce(F.size(todos), F.lit(0)) < 1, F.col("todo")).alias("todo"),
        F.col("plan"),
        F.element_at(steps, -1).alias("next_step"),
    )


def known_before(ends: DataFrame, facts: DataFrame, goals: DataFrame) -> DataFrame:
    """Each boundary's goal, decisions and failed attempts, nothing of them later than the boundary.

    The goal is the project's active or blocked one that was touched last, if that was before; else the first line of the
    project's latest summary before. The window over a project holds summaries and boundaries alone.
    """
    ends = ends.withColumn("project_key", project_key(F.col("cwd")))
    touched = F.coalesce("last_progress_ts", "declared_ts")
    active = goals.filter(F.col("status").isin("active", "blocked")).groupBy(F.col("project").alias("project_key"))
    goal = active.agg(F.max_by(F.struct("goal_text", touched.alias("touched")), F.struct(touched, "declared_ts", "goal_text")).alias("g")).select("project_key", "g.*")
    none = lambda kind: F.lit(None).cast(kind)
    line = F.nullif(_strip(F.split_part("content", F.lit("\n"), F.lit(1))), F.lit(""))
    told = facts.filter("kind = 'away_summary' AND ts IS NOT NULL AND project_key IS NOT NULL").groupBy("project_key", "ts").agg(F.max(F.struct(F.lit(True), "content"))["content"].alias("content"))
    both = told.select("project_key", "ts", F.struct(line.alias("line")).alias("told"), none("string").alias("file"), none("int").alias("boundary"))
    both = both.unionByName(ends.filter("ts IS NOT NULL AND project_key IS NOT NULL").select("project_key", "ts", none("struct<line:string>").alias("told"), "file", F.col("boundary").cast("int").alias("boundary")))
    before = W.partitionBy("project_key").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    summary = both.withColumn("summary", F.last("told", True).over(before)["line"]).filter("file IS NOT NULL").select(*_KEY, "summary")
    lists = facts.filter(F.col("kind").isin("standing_decision", "model_correction", "failed_attempt") & (F.col("content") != "")).select(
        "session_id", "kind", "content", F.coalesce("score", F.lit(float("-inf"))).alias("score"), F.col("ts").alias("at")
    )
    met = ends.select(*_KEY, "session_id", "ts").join(lists, "session_id").filter("ts IS NULL OR at IS NULL OR at < ts")
    order = W.partitionBy(*_KEY, F.col("kind") == "failed_attempt").orderBy(F.desc("score"), F.desc("at"), F.desc("content"))
    place = F.row_number().over(order)
    top = met.withColumn("place", place).filter(F.col("place") <= F.when(F.col("kind") == "failed_attempt", 2).otherwise(3))
    quoted = F.struct(F.col("place"), _quoted(F.col("content")).alias("json"), F.length("content").alias("size"))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, quoted))), lambda x: F.struct(x["json"].alias("json"), x["size"].alias("size")))
    failed = F.col("kind") == "failed_attempt"
    lists = top.groupBy(*_KEY).agg(listed(~failed).alias("decisions_this_session"), listed(failed).alias("failed_attempts_this_session"))
    own = ends.join(goal, "project_key", "left").join(summary, _KEY, "left").join(lists, _KEY, "left")
    timely = F.col("ts").isNull() | F.col("touched").isNull() | (F.col("touched") < F.col("ts"))
    return own.select(*_KEY, F.coalesce(F.when(timely, F.nullif("goal_text", F.lit(""))), "summary").alias("active_goal"), "decisions_this_session", "failed_attempts_this_session")


def _cut(text: Column, limit: Column) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.greatest(F.lit(40), limit - 1).cast("int")), F.lit("…"))).otherwise(text)


def _list_json(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["json"]), ","), F.lit("]"))


def _fitting(items: Column, limit: Column) -> Column:
    """The first items whose lengths together are within the limit; one at least."""
    upto = lambda i: F.aggregate(F.slice(items, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x["size"])
    return F.filter(items, lambda x, i: (i == 0) | (upto(i) <= limit))


def within_budget(df: DataFrame, budget: int = BUDGET) -> DataFrame:
    """`packet`, the parts as one JSON object of at most `budget` (200 or more) characters, the least important left out first.

    Takes a column for each of PARTS: texts, or lists of (json, size); a plan is any of `todos`, `todo` and `plan`. If the
    first part alone is too long, it is cut: a text by its end, a list by its last items; an item too long for any budget stays.
    Parts that are null or empty are not there.
    """
    budget = max(200, budget)
    texts = {"active_goal": "active_goal", "last_user_directive": "last_user_directive", "open_plan": "plan", "next_step": "next_step"}
    lists = {p: p for p in PARTS if p not in texts} | {"open_plan": "todos"}

    def part(name: str) -> Column:
        entry = lambda json: F.concat(F.lit(f'"{name}":'), json)
        sizes = F.sequence(F.lit(budget - len(name) - 10), F.lit(1), F.lit(-16))
        choice = lambda made: F.coalesce(F.get(F.filter(F.transform(sizes, made), lambda s: F.length(s) + 2 <= budget), F.lit(0)), made(F.lit((budget - len(name) - 10) % 16 or 16)))
        forms = []
        if name in lists:
            items = F.col(lists[name])
            forms.append(F.when(F.size(items) > 0, F.struct(entry(_list_json(items)).alias("json"), F.when(F.length(entry(_list_json(items))) + 2 > budget, choice(lambda b: entry(_list_json(_fitting(items, b))))).alias("short"))))
        if name == "open_plan":
            raw = entry(F.col("todo"))
            forms.append(F.when(F.col("todo").isNotNull(), F.struct(raw.alias("json"), raw.alias("short"))))
        if name in texts:
            text = F.col(texts[name])
            whole = entry(_quoted(text))
            forms.append(F.when(text != "", F.struct(whole.alias("json"), F.when(F.length(whole) + 2 > budget, choice(lambda b: entry(_quoted(_cut(text, b))))).alias("short"))))
        return F.coalesce(*forms)

    own = df.withColumn("parts", F.array_compact(F.array(*map(part, PARTS))))
    upto = lambda i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(1), lambda a, p: a + F.length(p["json"]) + 1)
    kept = F.filter("parts", lambda p, i: (i == 0) | (upto(i) <= budget))
    first = F.coalesce(F.get("parts", F.lit(0))["short"], F.get("parts", F.lit(0))["json"])
    rest = F.transform(F.slice("kept", F.lit(2), F.greatest(F.size("kept") - 1, F.lit(0))), lambda p: p["json"])
    own = own.withColumn("kept", kept).withColumn("n_parts", F.size("kept"))
    body = F.when(F.size("kept") > 0, F.array_join(F.concat(F.array(first), rest), ",")).otherwise("")
    return own.withColumn("packet", F.concat(F.lit("{"), body, F.lit("}"))).drop("parts", "kept")


def packets(records: DataFrame, facts: DataFrame | None = None, goals: DataFrame | None = None, budget: int = BUDGET, tail: int = TAIL) -> DataFrame:
    """A packet for each boundary from what came before it; without facts and goals from the transcript alone."""
    ends = boundaries(records)
    own = ends.join(in_flight(records, tail), _KEY, "left")
    if facts is not None and goals is not None:
        own = own.join(known_before(ends, facts, goals), _KEY, "left")
    else:
        item = "array<struct<json:string,size:int>>"
        own = own.withColumns({"active_goal": F.lit(None).cast("string"), "decisions_this_session": F.lit(None).cast(item), "failed_attempts_this_session": F.lit(None).cast(item)})
    return within_budget(own, budget)


def rediscoveries(records: DataFrame, packets: DataFrame, window: int, tail: int = TAIL) -> DataFrame:
    """For each boundary how many reads and commands up to `window` records after it, and before the next one, have
    a target that the records before it had, and how many of those its packet holds by path or name."""
    since = F.last(F.when(F.col("is_boundary"), F.col("pos")), True).over(W.partitionBy("file").orderBy("pos"))
    after = records.withColumn("boundary", since).filter(F.col("pos").between(F.col("boundary") + 1, F.col("boundary") + window))
    again = after.select(*_KEY, F.explode("uses").alias("u")).filter(F.col("u.name").isin(READING_TOOLS) & F.col("u.target").isNotNull()).select(*_KEY, F.col("u.target").alias("target"))
    again = again.groupBy(*_KEY, "target").agg(F.count("*").alias("n"))
    targets = F.flatten(F.transform("uses", lambda u: u["targets"]))
    before = _tails(records, tail).select(*_KEY, F.explode(targets).alias("target"))
    seen = again.join(before, [*_KEY, "target"], "left_semi")
    name = F.regexp_extract("target", "([^/]*)$", 1)
    base = F.when(name != "", name).otherwise(F.col("target"))
    held = F.contains("packet", "target") | ((F.length(base) > 3) & F.contains("packet", base))
    both = packets.select(*_KEY, "session_id", "message_uuid", "packet").join(seen, _KEY, "left")
    return both.groupBy(*_KEY, "session_id", "message_uuid").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rediscovered"), F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("preventable")
    )


# Which messages have what, in SQL that both engines read.
RULES = {
    "has_boundary": "seq % 4 = 2",  # a line of its own after the message's
    "is_meta": "seq % 7 = 1",
    "has_result": "seq % 5 = 0",  # instead of the user's text
    "is_error": "seq % 2 = 0",
    "has_todo": "seq % 13 = 0",
}
WINDOW, LIMIT = 60, 700
_TOOLS = ["Read", "Edit", "Bash", "Grep"]


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, seq, line): each assistant message uses two tools, one of them on the session's file, some write a plan; some
    messages of the user are results; sessions are compacted."""
    m = v.messages(spark, sf_dir)
    when = lambda rule, x: F.when(F.expr(RULES[rule]), x)
    number = F.col("seq").cast("string")
    session = F.floor(F.col("seq") / 1000)
    of = {n: F.col("seq") % 4 == i for i, n in enumerate(_TOOLS)}
    kinds = {k: F.lit(None).cast("string") for k in ("type", "text", "id", "name", "tool_use_id", "content")} | {"is_error": F.lit(None).cast("boolean")}
    inputs = {k: F.lit(None).cast("string") for k in ("file_path", "command", "pattern")} | {"todos": F.lit(None).cast("array<struct<content:string,status:string>>")}
    struct = lambda base, made: F.struct(*(x.alias(k) for k, x in (base | made).items()))
    block = lambda arguments=None, **made: struct(kinds | {"input": struct(inputs, arguments or {}) if arguments else F.lit(None).cast("struct<file_path:string,command:string,pattern:string,todos:array<struct<content:string,status:string>>>")}, made)
    own_file = F.concat(F.lit("/src/m"), (session % 5).cast("string"), F.lit(".py"))
    first = block(
        {
            "file_path": F.when(of["Read"] | of["Edit"], own_file),
            "command": F.when(of["Bash"], F.concat(F.lit("make t"), (session % 2).cast("string"))),
            "pattern": F.when(of["Grep"], F.lit("def t")),
        },
        type=F.lit("tool_use"), id=F.concat(F.lit("tu"), number), name=F.get(F.array(*map(F.lit, _TOOLS)), (F.col("seq") % 4).cast("int")),
    )
    second = block({"file_path": F.concat(F.lit("/src/shared"), (F.col("seq") % 2).cast("string"), F.lit(".py"))}, type=F.lit("tool_use"), id=F.concat(F.lit("tv"), number), name=F.lit("Read"))
    todo = block({"todos": F.array(F.struct(F.concat(F.lit("fix m"), number).alias("content"), F.lit("open").alias("status")))}, type=F.lit("tool_use"), id=F.concat(F.lit("tw"), number), name=F.lit("TodoWrite"))
    said = block(type=F.lit("text"), text=F.col("text"))
    result = block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("tu"), (F.col("seq") - 1).cast("string")), is_error=F.expr(RULES["is_error"]), content=F.lit("fine"))
    head = {
        "type": F.col("role"),
        "sessionId": F.col("session_id"),
        "uuid": F.col("message_uuid"),
        "timestamp": F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "cwd": F.col("cwd"),
    }
    line = lambda **more: F.to_json(F.struct(*(x.alias(k) for k, x in (head | more).items())))
    answer = F.struct(F.lit("assistant").alias("role"), F.array_compact(F.array(said, first, second, when("has_todo", todo))).alias("content"))
    own = (
        F.when(F.col("role") == "assistant", line(message=answer))
        .when((F.col("role") == "user") & F.expr(RULES["has_result"]), line(message=F.struct(F.lit("user").alias("role"), F.array(result).alias("content"))))
        .when(F.col("role") == "user", line(isMeta=F.expr(RULES["is_meta"]), message=F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
        .otherwise(line(subtype=F.lit("away_summary"), content=F.col("text")))
    )
    end = when("has_boundary", line(type=F.lit("system"), uuid=F.concat("message_uuid", F.lit("-c")), subtype=F.lit("compact_boundary")))
    lines = F.array_compact(F.array(own, end))
    return m.select(F.concat("session_id", F.lit(".jsonl")).alias("file"), "seq", F.posexplode(lines).alias("place", "line")).select("file", (F.col("seq") * 10 + F.col("place")).alias("seq"), "line")


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts and goals by rule: the users' and systems' messages; every tenth message declares a goal."""
    m = v.messages(spark, sf_dir)
    kind = F.expr("CASE WHEN role = 'system' OR seq % 9 = 4 THEN 'away_summary' WHEN seq % 2 = 0 THEN 'standing_decision' ELSE 'failed_attempt' END")
    facts = m.filter("role <> 'assistant'").select(kind.alias("kind"), F.left("text", F.lit(90)).alias("content"), "session_id", "project_key", "ts", (F.col("seq") % 7 / 10.0).alias("score"))
    goals = m.filter("seq % 10 = 1").select(F.col("project_key").alias("project"), F.concat(F.lit("goal "), "message_uuid").alias("goal_text"), F.when(F.col("seq") % 3 == 0, "done").otherwise("active").alias("status"), F.col("ts").alias("declared_ts"), F.lit(None).cast("long").alias("last_progress_ts"))
    return facts, goals


_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_QUOTE = lambda c: f"CAST(to_json(CAST({c} AS VARCHAR)) AS VARCHAR)"
_TAILS = f"""lines AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) AS pos FROM (
  SELECT *, seq * 10 AS line, false AS ends FROM messages UNION ALL SELECT *, seq * 10 + 1, true FROM messages WHERE {RULES['has_boundary']})),
ends AS (SELECT session_id, pos AS boundary, message_uuid || '-c' AS message_uuid, ts, project_key FROM lines WHERE ends),
uses AS (SELECT session_id, pos, 1 AS place, (['Read', 'Edit', 'Bash', 'Grep'])[seq % 4 + 1] AS name, 'tu' || seq AS id, CASE WHEN seq % 4 < 2 THEN '/src/m' || (seq // 1000) % 5 || '.py' END AS path,
    CASE seq % 4 WHEN 2 THEN 'make t' || (seq // 1000) % 2 WHEN 3 THEN 'def t' END AS other, seq FROM lines WHERE role = 'assistant' AND NOT ends
  UNION ALL SELECT session_id, pos, 2, 'Read', 'tv' || seq, '/src/shared' || seq % 2 || '.py', NULL, seq FROM lines WHERE role = 'assistant' AND NOT ends
  UNION ALL SELECT session_id, pos, 3, 'TodoWrite', 'tw' || seq, NULL, NULL, seq FROM lines WHERE role = 'assistant' AND NOT ends AND {RULES['has_todo']}),
tails AS (SELECT e.boundary, u.* FROM ends e JOIN uses u ON u.session_id = e.session_id AND u.pos BETWEEN e.boundary - {TAIL} AND e.boundary - 1),
said AS (SELECT e.session_id, e.boundary, l.pos, CASE WHEN role = 'user' AND NOT {RULES['has_result']} AND NOT {RULES['is_meta']} THEN nullif({_STRIP('text')}, '') END AS directive,
    CASE WHEN role = 'assistant' THEN nullif({_STRIP('text')}, '') END AS answer FROM ends e JOIN lines l ON l.session_id = e.session_id AND NOT l.ends AND l.pos BETWEEN e.boundary - {TAIL} AND e.boundary - 1),
known AS (SELECT CASE WHEN role = 'system' OR seq % 9 = 4 THEN 'away_summary' WHEN seq % 2 = 0 THEN 'standing_decision' ELSE 'failed_attempt' END AS kind, left(text, 90) AS content, session_id, project_key, ts, seq % 7 / 10.0 AS score FROM messages WHERE role <> 'assistant'),
goals AS (SELECT project_key, max_by('goal ' || message_uuid, (ts, 'goal ' || message_uuid)) AS goal, max(ts) AS touched FROM messages WHERE seq % 10 = 1 AND seq % 3 <> 0 GROUP BY 1),
files AS (SELECT session_id, boundary, path, count(*) AS n, max_by(name, pos * 10 - place) AS verb, max(pos * 10 - place) AS newest FROM tails WHERE name IN ('Read', 'Edit') GROUP BY 1, 2, 3),
results AS (SELECT e.session_id, e.boundary, 'tu' || (l.seq - 1) AS id, {RULES['is_error']} AS failed FROM ends e JOIN lines l ON l.session_id = e.session_id AND NOT l.ends AND role = 'user' AND {RULES['has_result']} AND l.pos BETWEEN e.boundary - {TAIL} AND e.boundary - 1),
actions AS (SELECT t.*, NOT coalesce(failed, false) AS ok, row_number() OVER (PARTITION BY t.session_id, t.boundary ORDER BY pos DESC, place DESC) AS rank FROM tails t LEFT JOIN results r ON r.session_id = t.session_id AND r.boundary = t.boundary AND r.id = t.id),
told AS (SELECT e.session_id, e.boundary, max_by(content, (k.ts, content)) AS content FROM ends e JOIN known k ON k.project_key = e.project_key AND k.kind = 'away_summary' AND k.ts < e.ts GROUP BY 1, 2),
ranked AS (SELECT e.session_id, e.boundary, k.kind, content, row_number() OVER (PARTITION BY e.session_id, e.boundary, kind ORDER BY score DESC, k.ts DESC, content DESC) AS rank FROM ends e JOIN known k ON k.session_id = e.session_id AND k.ts < e.ts AND content <> '' AND kind <> 'away_summary'),
parts AS (
  SELECT session_id, boundary, 1 AS prio, 'active_goal' AS part, {_QUOTE('goal')} AS json, goal AS text FROM (SELECT e.session_id, e.boundary, coalesce(CASE WHEN touched < e.ts THEN goal END, nullif({_STRIP("split_part(content, chr(10), 1)")}, '')) AS goal
    FROM ends e LEFT JOIN goals USING (project_key) LEFT JOIN told ON told.session_id = e.session_id AND told.boundary = e.boundary) WHERE goal IS NOT NULL
  UNION ALL SELECT session_id, boundary, 2, 'last_user_directive', {_QUOTE('d')}, d FROM (SELECT session_id, boundary, max_by(directive, pos) FILTER (WHERE directive IS NOT NULL) AS d FROM said GROUP BY 1, 2) WHERE d IS NOT NULL
  UNION ALL SELECT session_id, boundary, 3, 'files_in_flight', '[' || string_agg('{{"path":"' || path || '","verb":"' || verb || '","count":' || n || '}}', ',' ORDER BY newest DESC) || ']', NULL FROM (SELECT *, row_number() OVER (PARTITION BY session_id, boundary ORDER BY newest DESC) AS rank FROM files) WHERE rank <= {FILES} GROUP BY 1, 2
  UNION ALL SELECT session_id, boundary, 4, 'last_actions', '[' || string_agg('{{"tool":"' || name || '","arg":' || coalesce('"' || coalesce(path, other) || '"', 'null') || ',"ok":' || ok || '}}', ',' ORDER BY rank) || ']', NULL FROM actions WHERE rank <= {ACTIONS} GROUP BY 1, 2
  UNION ALL SELECT session_id, boundary, 5, 'decisions_this_session', '[' || string_agg({_QUOTE('content')}, ',' ORDER BY rank) || ']', NULL FROM ranked WHERE kind = 'standing_decision' AND rank <= 3 GROUP BY 1, 2
  UNION ALL SELECT s.session_id, s.boundary, 6, 'open_plan', coalesce(todo, {_QUOTE('plan')}), NULL FROM (SELECT session_id, boundary, max_by(answer, pos) FILTER (WHERE regexp_matches(answer, '{PLAN}')) AS plan FROM said GROUP BY 1, 2) s
    LEFT JOIN (SELECT session_id, boundary, '[{{"content":"fix m' || max_by(seq, pos) || '","status":"open"}}]' AS todo FROM tails WHERE name = 'TodoWrite' GROUP BY 1, 2) t USING (session_id, boundary) WHERE coalesce(todo, plan) IS NOT NULL
  UNION ALL SELECT session_id, boundary, 7, 'next_step', {_QUOTE('step')}, NULL FROM (SELECT session_id, boundary, string_split(regexp_replace(max_by(answer, pos) FILTER (WHERE answer IS NOT NULL), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[-1] AS step FROM said GROUP BY 1, 2) WHERE step IS NOT NULL
  UNION ALL SELECT session_id, boundary, 8, 'failed_attempts_this_session', '[' || string_agg({_QUOTE('content')}, ',' ORDER BY rank) || ']', NULL FROM ranked WHERE kind = 'failed_attempt' AND rank <= 2 GROUP BY 1, 2),
sized AS (SELECT *, 1 + sum(length(part) + length(json) + 4) OVER (PARTITION BY session_id, boundary ORDER BY prio) AS total, row_number() OVER (PARTITION BY session_id, boundary ORDER BY prio) AS place FROM parts),
short AS (SELECT session_id, boundary, max_by(json, b) AS json FROM (SELECT session_id, boundary, part, b, CASE WHEN length(text) > b THEN {_QUOTE("left(text, greatest(40, b - 1)) || '…'")} ELSE json END AS json
  FROM (SELECT *, unnest(range({LIMIT} - length(part) - 10, 0, -16)) AS b FROM sized WHERE place = 1 AND total > {LIMIT} AND text IS NOT NULL)) WHERE length(part) + length(json) + 5 <= {LIMIT} GROUP BY 1, 2),
kept AS (SELECT s.session_id, s.boundary, prio, '"' || part || '":' || CASE WHEN place = 1 THEN coalesce(h.json, s.json) ELSE s.json END AS entry FROM sized s LEFT JOIN short h ON h.session_id = s.session_id AND h.boundary = s.boundary WHERE place = 1 OR total <= {LIMIT}),
packets AS (SELECT e.session_id, e.boundary, e.message_uuid, '{{' || coalesce(string_agg(entry, ',' ORDER BY prio), '') || '}}' AS packet, count(entry) AS n_parts FROM ends e LEFT JOIN kept k ON k.session_id = e.session_id AND k.boundary = e.boundary GROUP BY 1, 2, 3)"""


def _packets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = work(raw_lines(spark, sf_dir))
    return records, packets(records, *_known(spark, sf_dir), budget=LIMIT)


@query("u08_packets", v.with_views(f", {_TAILS} SELECT session_id, message_uuid, packet, n_parts FROM packets", v.MESSAGES_SQL))
def u08_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet of each compaction."""
    return _packets(spark, sf_dir)[1].select("session_id", "message_uuid", "packet", "n_parts")


@query(
    "a29_rediscovery",
    v.with_views(
        f""", {_TAILS}, before AS (SELECT session_id, boundary, path AS target FROM tails WHERE path IS NOT NULL UNION SELECT session_id, boundary, other FROM tails WHERE name = 'Bash'),
later AS (SELECT u.session_id, e.boundary, coalesce(path, other) AS target FROM ends e JOIN uses u ON u.session_id = e.session_id AND u.pos BETWEEN e.boundary + 1 AND e.boundary + {WINDOW} AND u.name IN ('Read', 'Bash', 'Grep')
  WHERE NOT EXISTS (SELECT 1 FROM ends o WHERE o.session_id = e.session_id AND o.boundary > e.boundary AND o.boundary < u.pos)),
again AS (SELECT * FROM later JOIN before USING (session_id, boundary, target))
SELECT p.session_id, p.message_uuid, count(target) AS rediscovered, count(target) FILTER (WHERE contains(packet, target) OR contains(packet, parse_filename(target))) AS preventable
FROM packets p LEFT JOIN again a ON a.session_id = p.session_id AND a.boundary = p.boundary GROUP BY 1, 2""",
        v.MESSAGES_SQL,
    ),
)
def a29_rediscovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read or run again after each compaction, and how much of it the packet held."""
    records, made = _packets(spark, sf_dir)
    return rediscoveries(records, made, WINDOW).select("session_id", "message_uuid", "rediscovered", "preventable")
