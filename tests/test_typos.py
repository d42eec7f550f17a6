"""Slips against plain edits, and its cases."""

import itertools
import string

from threadlake.operators import typos


def plain_edits(w):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    out |= {a + c + b[1:] for a, b in cuts if b for c in string.ascii_lowercase} | {a + c + b for a, b in cuts for c in string.ascii_lowercase}
    return out - {w}


def found(spark, counts, dictionary, usable=1):
    c = spark.createDataFrame(list(counts.items()), "word string, n long")
    d = spark.createDataFrame([(w,) for w in dictionary], "word string")
    return {r.word: (r.n, r.meant, r.meant_n) for r in typos.slips(c, d, usable=usable).collect()}


def test_neighbours_are_all_words_one_edit_away(spark):
    words = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in typos.neighbours(df, df).collect()}
    assert got == {(a, b) for a in words for b in plain_edits(a) & set(words)}


def test_all_four_edits(spark):
    assert set(found(spark, {"whatx": 3, "waht": 3, "wht": 3, "whet": 3, "wwhatx": 3, "thaw": 3}, ["what"])) == {"whatx", "waht", "whet"}  # wht is too short


def test_jargon_is_no_slip(spark):
    counts = {"gaudi": 10859, "harvestd": 773, "harvest": 2357, "crashed": 2168, "crash": 50, "running": 1250, "run": 300}
    assert not found(spark, counts, ["gaudy", "cpu", "harvest", "crash", "run"])


def test_slips_are_rare_or_dominated(spark):
    counts = {"them": 8683, "what": 1028, "task": 3204, "error": 3047, "thema": 10, "waht": 5, "taks": 5, "rror": 15, "errors": 16}
    assert found(spark, counts, ["them", "what", "task", "error"]) == {"thema": (10, "them", 8683), "waht": (5, "what", 1028), "taks": (5, "task", 3204), "rror": (15, "error", 3047)}


def test_short_unknown_single_and_absent_words(spark):
    counts = {"hpu": 798, "zzqqxx": 9, "taks": 1, "waht": 2, "cpu": 5000}
    assert found(spark, counts, ["cpu", "cache", "task", "what"]) == {"waht": (2, "what", 0)}


def test_no_dictionary_no_slips(spark):
    assert found(spark, {"waht": 4, "what": 50}, ["what"], usable=2) == {}
    assert found(spark, {}, ["what"]) == {}


def test_signature_adds_known_misspellings(spark):
    texts = spark.createDataFrame([("Teh untill teh",), (None,), ("",), ("waht waht waht ateh",)], "text string")
    c = typos.word_counts(texts, "text")
    d = spark.createDataFrame([("what",)], "word string")
    assert [tuple(r) for r in typos.signature(texts, "text", typos.slips(c, d, usable=1)).collect()] == [("teh", 3), ("waht", 3), ("untill", 1)]
    assert typos.signature(texts, "text", typos.slips(c, d, usable=1), top=1).count() == 1
