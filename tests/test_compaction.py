"""Packets and rediscoveries of small transcripts."""

import json

from pyspark.sql import functions as F

from threadlake.operators import compaction as c

PRE, AT, LATER = 1746100800, 1746101400, 1746102000
ITEM = "array<struct<json:string,size:int>>"


def line(kind, content=None, ts=PRE, **more):
    message = {} if content is None else {"message": {"role": kind, "content": content}}
    return {"type": kind, "sessionId": "s1", "cwd": "/p", "timestamp": f"2025-05-01T12:{(ts - PRE) // 60:02d}:00Z", **message, **more}


def use(name, arguments, key, **more):
    return line("assistant", [{"type": "tool_use", "name": name, "id": key, "input": arguments}], **more)


def result(key, content, is_error=False):
    return line("user", [{"type": "tool_result", "tool_use_id": key, "is_error": is_error, "content": content}])


END = line("system", ts=AT, subtype="compact_boundary", uuid="b")


def records(spark, *lines):
    raw = [("d/s1.jsonl", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)]
    return c.work(spark.createDataFrame(raw, "file string, seq long, line string"))


def packet(spark, *lines, **more):
    (row,) = c.packets(records(spark, *lines), **more).collect()
    return json.loads(row.packet)


def test_parts_of_a_transcript(spark):
    got = packet(
        spark,
        line("user", "set up the relay"),
        use("Read", {"file_path": "/p/relay.py"}, "t1"),
        result("t1", "contents"),
        use("Edit", {"file_path": " /p/relay.py "}, "t2"),
        result("t2", "applied"),
        line("user", "now run the tests"),
        use("Bash", {"command": "pytest -q && echo done"}, "t3"),
        result("t3", "1 failed", True),
        use("TodoWrite", {"todos": [{"content": "fix it", "status": "open"}]}, "t4"),
        line("assistant", [{"type": "text", "text": "Next: fix the assertion. Let me re-run the suite."}]),
        END,
        line("user", "later"),
    )
    assert got == {
        "last_user_directive": "now run the tests",
        "files_in_flight": [{"path": "/p/relay.py", "verb": "Edit", "count": 2}],
        "last_actions": [
            {"tool": "TodoWrite", "arg": None, "ok": True},
            {"tool": "Bash", "arg": "pytest -q && echo done", "ok": False},
            {"tool": "Edit", "arg": "/p/relay.py", "ok": True},
        ],
        "open_plan": [{"content": "fix it", "status": "open"}],
        "next_step": "Let me re-run the suite.",
    }


def test_envelopes_are_no_directive(spark):
    lines = [line("user", "real"), line("user", "noise", isMeta=True), line("user", "summary", isCompactSummary=True), result("x", "text"), line("user", "<system-reminder>x")]
    assert packet(spark, "", "no json", *lines, END) == {"last_user_directive": "real"}


def test_plan_in_text_and_results(spark):
    got = packet(spark, line("assistant", "Plan: first A, then B."), use("Bash", {"command": "x"}, "t1"), use("Grep", {"pattern": "y"}, "t2"), result("t2", [{"type": "text", "text": "Traceback: boom"}]), END)
    assert got["open_plan"] == "Plan: first A, then B."
    assert got["last_actions"] == [{"tool": "Grep", "arg": "y", "ok": False}, {"tool": "Bash", "arg": "x", "ok": True}]


def test_nothing_before_and_tail(spark):
    assert packet(spark, END, line("user", "later")) == {}
    lines = [use("Read", {"path": f"/f{i}"}, f"t{i}") for i in range(9)]
    assert [f["path"] for f in packet(spark, *lines, END)["files_in_flight"]] == ["/f8", "/f7", "/f6", "/f5", "/f4"]
    assert [f["path"] for f in packet(spark, *lines, END, tail=2)["files_in_flight"]] == ["/f8", "/f7"]


def test_each_boundary_sees_what_came_before_it(spark):
    own = records(spark, line("user", "a"), END, line("user", "b"), END, END)
    assert [json.loads(r.packet)["last_user_directive"] for r in c.packets(own).orderBy("boundary").collect()] == ["a", "b", "b"]


FACTS = "kind string, content string, session_id string, project_key string, ts long, score double"
GOALS = "project string, goal_text string, status string, declared_ts long, last_progress_ts long"


def test_facts_and_goals_only_from_before(spark):
    facts = spark.createDataFrame(
        [
            ("standing_decision", "use y", "s1", "/p", PRE, 0.9),
            ("model_correction", "leave prod", "s1", "/p", None, 0.8),
            ("failed_attempt", "tried x", "s1", "/p", PRE, 0.7),
            ("standing_decision", "leaked", "s1", "/p", LATER, 0.99),
            ("standing_decision", "other", "s2", "/p", PRE, 0.95),
            ("away_summary", "Refactoring.\nMore", "s3", "/p", PRE, 0.5),
            ("away_summary", "leaked", "s3", "/p", AT, 0.5),
        ],
        FACTS,
    )
    goals = spark.createDataFrame([("/p", "ship", "active", PRE, None), ("/p", "old", "blocked", PRE - 9, PRE - 1), ("/p", "done", "done", PRE + 1, None)], GOALS)
    lines = [line("user", "go"), END]
    got = packet(spark, *lines, facts=facts, goals=goals)
    assert got == {"active_goal": "ship", "last_user_directive": "go", "decisions_this_session": ["use y", "leave prod"], "failed_attempts_this_session": ["tried x"]}
    assert packet(spark, *lines, facts=facts, goals=goals.filter("false"))["active_goal"] == "Refactoring."
    late = goals.withColumn("last_progress_ts", F.lit(LATER))
    assert packet(spark, *lines, facts=facts, goals=late)["active_goal"] == "Refactoring."
    assert "active_goal" not in packet(spark, *lines, facts=facts.filter("false"), goals=late)


def budgeted(spark, budget, **parts):
    kinds = {"plan": "string", "todo": "string", "todos": ITEM} | {p: "string" for p in ("active_goal", "last_user_directive", "next_step")} | {p: ITEM for p in ("files_in_flight", "last_actions", "decisions_this_session", "failed_attempts_this_session")}
    row = [parts.get(k) for k in kinds]
    df = spark.createDataFrame([row], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return c.within_budget(df, budget).collect()[0].packet


def test_budget_leaves_out_the_least_important(spark):
    items = [("x" * 98, 100), ("y" * 98, 100)]
    got = budgeted(spark, 200, active_goal="G" * 50, last_user_directive="D" * 50, files_in_flight=[('{"path":"/x"}', 13)], failed_attempts_this_session=[('"f"', 1)], next_step="N" * 200)
    assert list(json.loads(got)) == ["active_goal", "last_user_directive", "files_in_flight"] and len(got) <= 200
    assert budgeted(spark, 200) == "{}"
    assert json.loads(budgeted(spark, 10, active_goal="a" * 150)) == {"active_goal": "a" * 150}
    got = budgeted(spark, 200, files_in_flight=[(f'"{x}"', n) for x, n in items])
    assert json.loads(got) == {"files_in_flight": ["x" * 98]}


def test_budget_cuts_a_huge_part(spark):
    for text in ("Z" * 5000, "ü\"\n" * 900, "x" * 190):
        got = budgeted(spark, 200, active_goal=text)
        value = json.loads(got)["active_goal"]
        assert len(got) <= 200 and value.endswith("…") and text.startswith(value[:-1]), text[:9]


def test_rediscovery(spark):
    own = records(
        spark,
        use("Read", {"file_path": "/proj/alpha.py"}, "t1"),
        use("Bash", {"command": "make"}, "t2"),
        END,
        use("Read", {"file_path": "/proj/alpha.py"}, "t3"),
        use("Read", {"file_path": "/proj/never.py"}, "t4"),
        use("Edit", {"file_path": "/proj/alpha.py"}, "t5"),
        use("Bash", {"command": "make"}, "t6"),
        use("Read", {"file_path": "/proj/alpha.py"}, "t7"),
    )
    one = lambda p, w: [(r.rediscovered, r.preventable) for r in c.rediscoveries(own, p, w).collect()]
    p = c.packets(own)
    assert one(p, 50) == [(3, 3)]
    assert one(p, 4) == [(2, 2)]
    assert one(p.withColumn("packet", F.lit('{"x":"in alpha.py"}')), 50) == [(3, 2)]


def test_rediscovery_ends_at_the_next_boundary(spark):
    own = records(spark, use("Read", {"path": "/a"}, "1"), END, END, use("Grep", {"pattern": "/a"}, "2"))
    got = c.rediscoveries(own, c.packets(own), 50).orderBy("boundary").collect()
    assert [r.rediscovered for r in got] == [0, 1]
