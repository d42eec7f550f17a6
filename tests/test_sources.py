import json

from pyspark.sql import functions as F

from threadlake.sources import records, sinks
from threadlake.streaming import ingest


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_claude_lines(spark, tmp_path):
    blocks = [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t"}, {"type": "text", "text": "b"}]
    write(
        tmp_path / "s1.jsonl",
        [
            {"type": "user", "sessionId": "s1", "uuid": "u1", "timestamp": "2024-01-01T00:00:01Z", "cwd": "/p", "message": {"content": "hello"}},
            {"type": "assistant", "sessionId": "s1", "uuid": "u2", "parentUuid": "u1", "timestamp": "bad", "message": {"model": "m", "content": blocks, "usage": {"input_tokens": 3, "output_tokens": 4}}},
            "",
            "not json",
            '{"type": "user", "unfinished',
            "[1, 2]",
        ],
    )
    got = records.parse_claude(records.lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.uuid, r.role, r.text, r.ts) for r in got] == [("u1", "user", "hello", 1704067201), ("u2", "assistant", "a\nb", None)]
    assert (got[1].input_tokens, got[1].output_tokens, got[1].parent_uuid) == (3, 4, "u1")


def test_codex_carries_state(spark, tmp_path):
    said = lambda t: {"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": t}]}}
    write(
        tmp_path / "rollout-1.jsonl",
        [{"type": "session_meta", "payload": {"id": "x", "cwd": "/a"}}, said("one"), {"type": "turn_context", "payload": {"cwd": "/b", "model": "m"}}, said("two")],
    )
    got = records.parse_codex(records.lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.session_id, r.cwd, r.model, r.text) for r in got] == [("x", "/a", None, "one"), ("x", "/b", "m", "two")]


def test_codex_calls_tokens_and_compactions(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "payload": p}
    count = lambda **c: {"type": "event_msg", "payload": {"type": "token_count", "info": c}}
    key = "0123456789abcdef0123456789abcdef0123"
    write(
        tmp_path / f"rollout-2024-01-01T00-00-00-{key}.jsonl",
        [
            item(type="FunctionCall", name="read", namespace="fs", call_id="c1", arguments='{"path": "/a"}'),
            {"type": "turn_context", "payload": {"model": "m", "cwd": "/w"}},
            {"type": "response_item", "payload": {"FunctionCall": {"name": "sh", "call_id": "c2", "arguments": "ls"}}},
            item(type="LocalShellCall", id="c3", action={"command": ["ls"]}),
            item(type="FunctionCallOutput", call_id="c1", output="old"),
            item(type="FunctionCallOutput", call_id="c1", output={"content_items": [{"text": "x"}, {"content": "y"}, {"text": ""}], "is_error": True}),
            item(type="FunctionCallOutput", call_id="c2", output="plain"),
            count(input_tokens=10, cached_input_tokens=4, output_tokens=1),
            count(total_token_usage={"input_tokens": 25, "cached_input_tokens": 4, "output_tokens": 3, "reasoning_output_tokens": 2}),
            {"type": "event_msg", "payload": {"token_count": {"input_tokens": 5}}},
            item(type="CustomThing", x=1),
            {"type": "compacted", "payload": {"message": "s", "replacement_history": [{"type": "message", "role": "user", "content": "kept"}, 3, {"Message": {"role": "assistant", "content": [{"content": "also"}]}}]}},
            "no json",
        ],
    )
    raw = records.lines(spark, str(tmp_path))
    calls = {r.tool_use_id: r for r in records.codex_calls(raw).collect()}
    assert [(calls[k].name, calls[k].input, calls[k].output, calls[k].is_error, calls[k].model) for k in ("c1", "c2", "c3")] == [
        ("fs.read", '{"path": "/a"}', "x\ny", True, None),
        ("sh", '{"_raw":"ls"}', "plain", False, "m"),
        ("local_shell", '{"command":["ls"]}', None, None, "m"),
    ]
    assert {r.session_id for r in calls.values()} == {key}
    got = records.codex_tokens(raw).orderBy("seq").collect()
    assert [(r.input_tokens, r.cache_read_tokens, r.output_tokens, r.cache_creation_tokens) for r in got] == [(10, 4, 1, 0), (15, 0, 2, 2), (5, 0, 0, 0)]
    events = records.codex_events(raw).orderBy("seq", "place").collect()
    assert [e.kind for e in events][-4:] == ["customthing", "compactboundary", "message", "message"]
    assert [(r.role, r.text) for r in records.parse_codex(raw).collect()] == [("user", "kept"), ("assistant", "also")]


def test_gemini_rewrites_and_rewinds(spark, tmp_path):
    m = lambda i, t: {"id": i, "type": "user", "content": t}
    write(tmp_path / "g.jsonl", [{"sessionId": "g"}, m("a", "1"), m("b", "2"), m("a", "1b"), {"$rewindTo": "b"}, m("c", "3"), m("b", "4")])
    got = records.parse_gemini(records.lines(spark, str(tmp_path))).orderBy("seq").collect()
    # the rewind drops b; a keeps its place before b, and its rewrite; the first line is metadata
    assert [(r.uuid, r.text) for r in got] == [("a", "1b"), ("c", "3"), ("b", "4")]


def test_aider_sessions(spark, tmp_path):
    write(tmp_path / "h.md", ["# aider chat started at 2024-01-01 00:00:00", "#### fix it", "#### now", "Sure.", "Done.", "> tool", "# aider chat started at 2024-01-02 00:00:00", "#### more"])
    got = records.parse_aider(records.lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.session_id[-2:], r.role, r.text) for r in got] == [("#1", "user", "fix it\nnow"), ("#1", "assistant", "Sure.\nDone."), ("#1", "tool", "tool"), ("#2", "user", "more")]


def test_union_and_guess(spark):
    a = spark.createDataFrame([("x", 1)], "source string, seq long")
    b = spark.createDataFrame([("y",)], "source string")
    assert records.union_sources(a, b).count() == 2
    cases = {"/h/.codex/a.jsonl": "codex", "/h/.claude/p/a.jsonl": "claude_code", "/x/rollout-1.jsonl": "codex", "/x/sessions.db": "goose", "/s/goose/rollout-1": "goose", "/x/opencode.db": "opencode", "/opencode/a.jsonl": "claude_code", "a.pi.jsonl": "pi", "/h/.pi/a": "pi", "/h/.grok/a": "grok"}
    paths = spark.createDataFrame(list(cases.items()), "p string, tool string")
    assert all(r[0] == r[1] for r in paths.select(records.guess_source(F.col("p")), "tool").collect())


def test_append_null_keys_pass(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "seq long, k string")
    known = spark.createDataFrame([("b",)], "k string")
    assert sorted(r.seq for r in sinks.new_rows(rows, known, ["k"], "seq").collect()) == [1, 3, 4]


def test_tail_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.json", [{"id": "a", "seq": 1}, {"id": "b", "seq": 2}, {"id": "a", "seq": 3}])
    run = lambda checkpoint: ingest.tail(spark, str(tmp_path / "in"), "id string, seq long", str(tmp_path / "out"), str(tmp_path / checkpoint), ["id"], "seq").awaitTermination()
    run("c")
    write(tmp_path / "in" / "2.json", [{"id": "b", "seq": 4}, {"id": "c", "seq": 5}])
    run("c")
    run("again")  # a lost checkpoint reads everything again
    assert sorted((r.id, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_event_log(spark, tmp_path):
    write(tmp_path / "e.ndjson", [{"ts": "2024-01-02T00:00:00Z", "event": "b"}, {"ts": "2024-01-01T00:00:00Z", "event": "a"}, "junk"])
    assert [r.event for r in records.event_log(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_lines_of_many_splits(spark, tmp_path):
    write(tmp_path / "long.txt", [f"line {k} {'x' * (k % 50)}" for k in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    rows = records.lines(spark, str(tmp_path)).orderBy("seq").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line.split()[1] for r in rows] == [str(k) for k in range(5000)] and len({r.seq for r in rows}) == 5000


def test_gemini_patches_and_lines_without_id(spark, tmp_path):
    write(tmp_path / "g.jsonl", [{"sessionId": "old", "model": "m1"}, {"type": "user", "content": "no id"}, {"$set": {"sessionId": "new"}}, {"id": "x", "type": "gemini", "content": "y", "tokens": {"input": 3, "output": 4, "thoughts": 2}}])
    got = records.parse_gemini(records.lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.session_id, r.role, r.text, r.model, r.output_tokens) for r in got] == [("new", "user", "no id", "m1", None), ("new", "assistant", "y", "m1", 6)]


def test_grok_and_pi(spark, tmp_path):
    folder = tmp_path / "sessions" / "%2Fhome%2Fme" / "s1"
    folder.mkdir(parents=True)
    write(folder / "chat_history.jsonl", [{"type": "user", "content": "hi"}, "junk", {"type": "reasoning", "summary": [{"text": "hm"}]}, {"type": "assistant", "content": "yo"}])
    got = records.parse_grok(records.lines(spark, str(tmp_path / "sessions" / "*" / "*" / "chat_history.jsonl"))).orderBy("seq").collect()
    assert [(r.session_id, r.cwd, r.role, r.text) for r in got] == [("s1", "/home/me", "user", "hi"), ("s1", "/home/me", "assistant", "hm"), ("s1", "/home/me", "assistant", "yo")]
    write(tmp_path / "p.jsonl", [{"type": "message", "id": "1", "message": {"role": "user", "content": "a"}}, {"type": "compaction", "summary": "x"}, {"type": "message", "id": "2", "parentId": "1", "message": {"role": "assistant", "content": [{"type": "text", "text": "b"}]}}])
    got = records.parse_pi(records.lines(spark, str(tmp_path / "p.jsonl"))).orderBy("seq").collect()
    assert [(r.session_id, r.uuid, r.parent_uuid, r.role, r.text) for r in got] == [("p", "1", None, "user", "a"), ("p", "2", "1", "assistant", "b")]


def test_cline_sums_usage(spark, tmp_path):
    for task, used in (("t1", [{"model_id": "m", "input_tokens": 2, "output_tokens": 1}, {"model_id": "n", "input_tokens": 3, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 4}]), ("t2", None)):
        (tmp_path / task).mkdir()
        chat = [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "x"}]}, {"role": "assistant", "content": "b"}]
        (tmp_path / task / "api.json").write_text(json.dumps(chat))
        (tmp_path / task / "meta.json").write_text(json.dumps({"model_usage": used} if used else {}))
    chats, metas = (records.files(spark, str(tmp_path / "*"), f"{n}.json") for n in ("api", "meta"))
    got = records.parse_cline(chats, metas).orderBy("session_id", "seq").collect()
    assert [(r.cache_read_tokens, r.cache_creation_tokens) for r in got if r.input_tokens] == [(7, 4)]
    assert [(r.session_id, r.role, r.text, r.input_tokens, r.output_tokens) for r in got] == [
        ("t1", "user", "q", None, None), ("t1", "assistant", "a", 5, 1), ("t1", "assistant", "b", None, None),
        ("t2", "user", "q", None, None), ("t2", "assistant", "a", None, None), ("t2", "assistant", "b", None, None),
    ]


def test_goose_opencode_cursor(spark):
    sessions = spark.createDataFrame([("s", "/w"), ("empty", "/e")], "id string, working_dir string")
    messages = spark.createDataFrame([(1, "s", "user", '[{"type":"text","text":"hi"},{"type":"image"}]', 5), (2, "gone", "user", "[]", 6)], "id long, session_id string, role string, content_json string, created_timestamp long")
    assert [(r.session_id, r.cwd, r.text, r.ts) for r in records.parse_goose(sessions, messages).collect()] == [("s", "/w", "hi", 5)]
    assert {r.id: r.n_messages for r in records.goose_sessions(sessions, messages).collect()} == {"s": 1, "empty": 0}
    s = spark.createDataFrame([("a", "p", ""), ("b", None, "/own")], "id string, project_id string, directory string")
    p = spark.createDataFrame([("p", "/tree")], "id string, worktree string")
    m = spark.createDataFrame([("m1", "a", "user", 2000, None), ("m2", "a", "assistant", 3000, "x"), ("m3", "b", "user", 1000, None)], "id string, session_id string, role string, time_created long, model string")
    parts = spark.createDataFrame([("2", "m1", "text", "two"), ("1", "m1", "text", "one"), ("3", "m1", "tool", "no")], "id string, message_id string, type string, text string")
    got = records.parse_opencode(s, p, m, parts).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.cwd, r.text, r.ts) for r in got] == [("a", 1, "/tree", "one\ntwo", 2), ("a", 2, "/tree", "", 3), ("b", 1, "/own", "", 1)]
    kv = [("composerData:c", '{"workspace": "/c"}'), ("bubbleId:c:2", '{"type": 2, "text": "yo", "createdAt": "2024-01-01T00:00:02Z"}'), ("bubbleId:c:1", '{"type": 1, "text": "hi", "createdAt": "2024-01-01T00:00:01Z"}'), ("other", "x")]
    got = records.parse_cursor(spark.createDataFrame(kv, "key string, value string")).orderBy("seq").collect()
    assert [(r.session_id, r.cwd, r.role, r.text) for r in got] == [("c", "/c", "user", "hi"), ("c", "/c", "assistant", "yo")]


def test_continue_history(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"sessionId": "c", "workspaceDirectory": "/w", "history": [{"message": {"role": "user", "content": "hi"}}, {"message": {"role": "assistant", "content": "yo"}}]}))
    got = records.parse_continue(records.files(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.session_id, r.cwd, r.role, r.text) for r in got] == [("c", "/w", "user", "hi"), ("c", "/w", "assistant", "yo")]


def test_agents_and_sessions(spark, tmp_path):
    result = lambda agent, use: {"type": "user", "sessionId": "s", "toolUseResult": {"agentId": agent}, "message": {"content": [{"type": "tool_result", "tool_use_id": use}]}}
    name = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    (tmp_path / "-home-me").mkdir()
    write(tmp_path / "-home-me" / f"{name}.jsonl", [result("a", "tu1")])
    write(tmp_path / "-home-me" / "agent-a.jsonl", ["{}"])
    agents = spark.createDataFrame([("s", "a", "x"), ("s", "b", "own"), ("s", "c", None)], "session_id string, agent_id string, own_id string")
    linked = records.linked_agents(agents, records.lines(spark, str(tmp_path / "-home-me"))).collect()
    assert {r.agent_id: r.tool_use_id for r in linked} == {"a": "tu1", "b": "own", "c": "agent:c"}
    found = records.session_files(spark, str(tmp_path)).collect()
    assert [(r.slug, r.session_id) for r in found] == [("-home-me", name)]
    both = spark.range(1).select(records.slug_of(F.lit("/home/u/my.proj_x")), records.cwd_of(F.lit("-home-me"))).first()
    assert tuple(both) == ("-home-u-my.proj_x", "/home/me")


def test_late_values_and_dump(spark, tmp_path):
    t = spark.createDataFrame([("a", None), ("b", 1), ("c", None)], "k string, d int")
    late = spark.createDataFrame([("a", 3), ("a", 5), ("b", 9)], "k string, d int")
    assert {r.k: r.d for r in sinks.filled(t, late, "k", "d").collect()} == {"a": 5, "b": 1, "c": None}
    rows = spark.createDataFrame([(2, 5, "user", "x", "goal"), (1, None, "user", "y", "ban"), (3, 1, "user", "z", "ban")], "seq int, ts int, role string, text string, kind string")
    sinks.dump(rows, str(tmp_path / "d"), kind="ban")
    assert [r.text for r in spark.read.json(str(tmp_path / "d")).orderBy("seq").collect()] == ["y", "z"]
