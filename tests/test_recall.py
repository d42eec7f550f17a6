import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from threadlake.operators import recall
from threadlake.operators.sets import bounded


def test_chunks():
    assert recall.chunk_text(None) == recall.chunk_text(" \n\n ") == []
    text = " ".join(f"Sentence number {k} says this." for k in range(300))
    parts = recall.chunk_text(text, 400, 50)
    assert all(len(p) <= 400 for p in parts)
    for a, b in zip(parts, parts[1:], strict=False):
        assert b.startswith(a[-50:])
    whole = parts[0] + "".join(p[50:] for p in parts[1:])
    assert whole.replace(" ", "") == text.replace(" ", "")
    hard = recall.chunk_text("x" * 1000, 300, 40)
    assert all(len(p) <= 300 for p in hard) and sum(map(len, hard)) >= 1000


def test_embed():
    a, b, c = recall.embed(pd.Series(["the red fox runs", "the red fox ran", None]))
    assert abs(np.linalg.norm(a) - 1) < 1e-5 and a @ b > 0.3 and not c.any()


def test_rerank_columns(spark):
    df = spark.createDataFrame([("use duckdb", "We use DuckDB here"), ("use duckdb", "near-miss: sqlite")], "q string, c string")
    rows = df.select(recall.exactish(F.col("q"), F.col("c")), recall.legacy_penalty(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(True, 0.0), (False, 0.5)]


def test_budget_keeps_one(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, "y")], "rank long, text string")
    assert [r.rank for r in bounded(df, 10, F.col("rank")).collect()] == [1]


def rank(spark, dense, words, contents, query, limit=3):
    facts = spark.createDataFrame([(k, "decision", x) for k, x in contents.items()], "id long, kind string, content string")
    place = lambda ids, **more: [(1, i, p, *([0.1 * (p + 1)] if more else [])) for p, i in enumerate(ids)]
    d = spark.createDataFrame(place(dense, distance=True), "query_id int, id long, position int, distance double")
    w = spark.createDataFrame(place(words), "query_id int, id long, position int")
    got = recall.dense_first(d, w, facts, spark.createDataFrame([(1, query)], "query_id int, query string"), limit)
    return [r.id for r in got.orderBy("position").collect()]


def test_dense_first(spark):
    contents = {1: "the green house stands by the sea", 2: "a boat on a lake", 3: "near-miss: green house", 4: "set web-01 to green", 5: "green web-01 is legacy and rejected"}
    # a paraphrase keeps the neighbours' order; what only the words find comes after
    assert rank(spark, [2, 1], [4], contents, "small ships afloat") == [2, 1, 4]
    # an identifier that the words' first hit holds and the first neighbour doesn't
    assert rank(spark, [1, 2], [4, 5], contents, "web-01") == [4, 5, 1]
    # both hold it: ranked again, outdated phrasing behind
    assert rank(spark, [5, 4], [4], contents, "web-01") == [4, 5]
    # a near miss among the first makes words matter
    assert rank(spark, [3, 1], [], contents, "green house") == [1, 3]


def test_blend(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    got = one(recall.blended(lit("use web-01"), lit("decision: web-01 first"), lit("decision"), lit(0.2), lit(0), lit(None).cast("int")))
    ident = 0.4 * (1 - 10 / 160) + 0.3 / (1 + 22 / 180) + 0.3
    assert abs(got - (0.26 * 0.8 + 0.24 + 0.14 + 0.12 * ident + 0.08 * 0.12 / 0.14 + 0.06 * 0.35 + 0.06)) < 1e-9
    got = one(recall.blended(lit("quiet mornings"), lit("we sleep late"), lit("other"), lit(0.5), lit(1), lit(3)))
    assert abs(got - (0.55 * 0.5 + 0.12 / 2 + 0.10 * 0.02 / 0.14 + 0.05 / 4)) < 1e-9
    assert [one(recall.exactish(lit(q), lit("Use WEB-01 now"))) for q in ("web-01", "now web-01", "web-02", "the", "")] == [True, True, False, False, False]


def test_backfill_embeds_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None)], "id long, text string")
    known = spark.createDataFrame([(2,)], "id long")
    got = {r.id: r.embedding for r in recall.backfill(rows, known, "id", "text").collect()}
    assert got.keys() == {1, 3} and not any(got[3])
    assert np.allclose(got[1], recall.embed(pd.Series(["a b a"]))[0]) and abs(np.linalg.norm(got[1]) - 1) < 1e-6


def test_rerank_key(spark):
    """What a pair needs of its query and its fact is worked out once for each of these."""
    pair = ("use duckdb for the go-1.23 job, not sql", "near-miss: we ran DuckDB on GO-1.23")
    df = spark.createDataFrame([(*pair, "ban", 0.3), ("", pair[1], "none", 0.3)], "q string, c string, kind string, distance double")
    got = [r.k for r in df.select(recall.dense_key(F.col("distance"), F.col("kind"), recall.weighed_tokens(F.col("q")), F.lower("c"), recall.legacy_penalty(F.col("c"))).alias("k")).collect()]
    tokens = recall.t.query_tokens(F.col("q"))
    near = 0.04 * recall.t.distinctive_coverage(tokens, F.col("c")) + 0.02 * recall.t.coverage(tokens, F.col("c"))
    boost = F.when(F.col("kind") == "ban", recall.scoring.DENSE_BOOST.get("ban", 0.02)).otherwise(0.02)
    want = [r.k for r in df.select((F.col("distance") - boost - near + 0.08 * recall.legacy_penalty(F.col("c"))).alias("k")).collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_backfill_in_pieces(spark, monkeypatch):
    """A task embeds a few rows at a time, not a whole batch."""
    monkeypatch.setattr(recall, "EMBEDDED", 3)
    rows = spark.range(20).selectExpr("id", "concat('word ', id) AS text").coalesce(1)
    out = recall.backfill(rows, spark.createDataFrame([], "id long"), "id", "text")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20
