"""The fold of goals: what states, touches, blocks and ends them, and their age."""

from pyspark.sql import functions as F

from threadlake.operators import extract, facts, targeted

DAY = 86400


def folded(spark, rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "project string, goal string, hint string, ts long, seq long")
    return {(r.project, r.goal): (r.declared_ts, r.last_progress_ts, r.status) for r in facts.fold_goals(df).collect()}


def test_statements_and_progress(spark):
    assert folded(spark, [("p", "a", None, 5)]) == {("p", "a"): (5, 5, "active")}
    # stated again: one goal, first declared then, touched now
    assert folded(spark, [("p", "a", None, 5), ("p", "a", None, 9)]) == {("p", "a"): (5, 9, "active")}
    # progress touches every open goal of the project, also days later, and of no other project
    rows = [("p", "a", None, 5), ("p", "b", "blocked", 6), ("q", "c", None, 7), ("p", None, None, 3 * DAY)]
    assert folded(spark, rows) == {("p", "a"): (5, 3 * DAY, "active"), ("p", "b"): (6, 3 * DAY, "blocked"), ("q", "c"): (7, 7, "active")}
    # not before it is stated, and not once it is done
    rows = [("p", None, None, 1), ("p", "a", None, 5), ("p", None, None, 8), ("p", "a", "done", 9), ("p", None, None, 2 * DAY)]
    assert folded(spark, rows) == {("p", "a"): (5, 9, "done")}
    # a done goal that is stated again stays done; one that is then blocked is open again, as of then
    rows = [("p", "a", "done", 1), ("p", None, None, 2), ("p", "a", None, 3), ("p", None, None, 4), ("p", "a", "blocked", 5), ("p", None, None, DAY + 6)]
    assert folded(spark, rows[:4]) == {("p", "a"): (1, 3, "done")} and folded(spark, rows) == {("p", "a"): (1, DAY + 6, "blocked")}
    assert folded(spark, [(None, "a", None, 1), ("p", "a", None, None), ("p", None, None, 3)]) == {}


def test_age(spark):
    rows = [("p", "new", None, 95 * DAY), ("p", "month", None, 60 * DAY), ("p", "old", None, 5 * DAY), ("q", "ended", "done", 99 * DAY), ("r", "stuck", "blocked", 98 * DAY), ("r", "slow", "blocked", 20 * DAY)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "project string, goal string, hint string, ts long, seq long")
    goals = facts.fold_goals(df)
    state = facts.goal_status(F.col("status"), F.col("last_progress_ts"), F.lit(100 * DAY))
    assert {r.goal: r.s for r in goals.select("goal", state.alias("s")).collect()} == {"new": "active", "month": "paused", "old": "abandoned", "ended": "done", "stuck": "active", "slow": "blocked"}
    assert {r.project: (r.goal, r.state) for r in targeted.active_goals(goals, F.lit(100 * DAY)).collect()} == {"p": ("new", "active"), "r": ("stuck", "active")}


def test_claims_that_say_the_same_or_nothing(spark):
    old = spark.createDataFrame([("a", "Vim ", 0.5), ("b", "tabs", 0.5), ("c", "", 0.0), ("d", "x", 0.6), ("e", "x", 0.6)], "key string, value string, confidence double")
    new = spark.createDataFrame([("a", "vim", 0.9, 1), ("b", "", 0.9, 5), ("c", "y", 0.3, 1), ("d", "z", 0.5, 1), ("e", "z", 0.5, 2), ("f", "w", 0.2, 1)], "key string, value string, confidence double, evidence long")
    got = {r.key: (r.outcome, r.value, round(r.confidence, 6)) for r in facts.merged_claims(old, new, "key").collect()}
    assert got == {
        "a": ("confirmed", "Vim ", 0.55), "b": ("kept", "tabs", 0.5), "c": ("taken", "y", 0.3), "d": ("tentative", "x", 0.6), "e": ("replaced", "z", 0.5), "f": ("taken", "w", 0.2),
    }


def test_openers_are_no_goals(spark):
    texts = ["hi", "okay!!! ... ...", "Good morning!!!!", "continue   \n", "fix it", "goal: x", "Thanks. Now port the parser to the new format", "hold on ........"]
    rows = [(f"s{k}", 2 * k, "user", t) for k, t in enumerate(texts)] + [("s4", 100, "user", "a later message that is long enough")]
    m = spark.createDataFrame(rows, "session_id string, seq long, role string, text string")
    got = {r.text: (r.marked, r.opens) for r in extract.goal_signs(m).collect()}
    assert {t: x for t, x in got.items() if any(x)} == {"goal: x": (True, False), "Thanks. Now port the parser to the new format": (False, True)}


def test_facts_with_a_clitic_or_an_address(spark):
    texts = {"the dog's name": True, "mail bob@example.com now": False, "nothing here": False, "the box is up": True}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", extract.has(F.col("t"), extract.VERB).alias("v")).collect()} == texts
    wide = {r.t for r in df.filter(extract.has(F.col("t"), extract.GLOBAL_SCOPE)).collect()}
    assert wide == {"mail bob@example.com now"}
