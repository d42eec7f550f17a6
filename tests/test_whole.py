"""Queries that once took a part of their rows or texts, against the whole job stated in SQL."""

from tests.util import assert_same
from threadlake import views
from threadlake.operators import ingest, profiles


def test_append_against_all_stored_rows(spark, duck):
    larger = "/root/testdata/sf0.01"  # the smallest table with keys that only the batch has
    sql = f"""WITH e AS (SELECT event_id, event_type, user_id AS k FROM '{larger}/events.parquet')
SELECT event_type, k, min(event_id) AS event_id FROM e b WHERE event_id % 2 = 1
AND NOT EXISTS (SELECT 1 FROM e a WHERE a.event_id % 2 = 0 AND a.event_type = b.event_type AND a.k = b.k) GROUP BY 1, 2"""
    assert ingest.k01_append(spark, larger).count() > 0
    assert_same(ingest.k01_append(spark, larger), duck.execute(sql))


def test_mentions_of_names(spark):
    texts = spark.createDataFrame([("p", "Engine, raptor-engine and engines; own p"), ("p", "the engine (c++)"), ("q", "p p P"), ("r", None)], "project string, text string")
    names = spark.createDataFrame([("p", "p"), ("q", "engine"), ("q", "raptor-engine"), ("r", "own")], "project string, name string")
    assert sorted(map(tuple, profiles.mentions(texts, names).collect())) == [("p", "q", 3, 1), ("p", "r", 1, 2), ("q", "p", 3, 1)]
    whole = sorted(map(tuple, profiles.name_counts(texts, names).collect()))
    assert whole == sorted(map(tuple, profiles.name_counts(texts, names, block_bytes=3).collect()))  # names in many blocks
    assert profiles.name_counts(texts, names.limit(0)).count() == 0 and profiles.name_counts(texts.limit(0), names).count() == 0


def test_names_at_word_ends():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for name in ("aa", "a-a", "c++", "né", "x_1"):
        automaton.add_word(name, name)
    automaton.make_automaton()
    for text, want in (("aa aaa aa", ["aa", "aa"]), ("a-a-a", ["a-a"]), ("c++ c++x", ["c++"]), ("x_1 x_12 (x_1)", ["x_1", "x_1"]), ("", [])):
        assert list(profiles.names_in(text, automaton)) == want


def test_extractions_hold_whole_texts(spark, sf, duck):
    got = dict(map(tuple, views.extractions(spark, sf).select("id", "content").collect()))
    assert got == dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
