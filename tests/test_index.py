"""The search index against plain scoring: words, stems, accents and phrases, pruning, cuts of frequent terms."""

import math
import random
from collections import Counter

import pytest

from threadlake.functions.stem import analysed, phrases, porter
from threadlake.operators import index, search

# the examples of the published algorithm
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
at at b2b b2b größe größe deployments deploy deployment deploy""".split()


def test_stems():
    for word, stem in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert porter(word) == stem, word


def test_analysis():
    assert analysed("Café-Crème, GO-1.23 naïve_x", "folded") == ["cafe", "creme", "go", "1", "23", "naive", "x"]
    assert analysed("Café running", "plain") == ["caf", "running"] and analysed("Café running", "porter") == ["cafe", "run"]
    assert phrases('use go-1.23 "tabs" -- a@b.io', "plain") == ["use", "go 1 23", "tabs", "a b io"]


def plain_search(docs, queries, k, analyser, phrased):
    tokens = {i: None if t is None else analysed(t, analyser) for i, t in docs}
    known = [x for x in tokens.values() if x is not None]
    mean, out = sum(map(len, known)) / len(known), []

    def count(words, term):
        parts = term.split(" ")
        return sum(words[i : i + len(parts)] == parts for i in range(len(words) - len(parts) + 1))

    for q, text in queries:
        score = Counter()
        for term in set((phrases if phrased else analysed)(text or "", analyser)):
            tf = {i: n for i, w in tokens.items() if w and (n := count(w, term))}
            idf = max(1e-6, math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))) if tf else 0
            for i, n in tf.items():
                score[i] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out += [(q, i, s) for s, i in best]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["the"] * 40 + ["café", "Running", "runs", "go-1.23", "go", "1", "23", "deployment", "deployed"] + [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "the " * 500), (403, docs[7][1])]
    queries = [(0, "the w3"), (1, "go-1.23"), (2, "cafe runner deploy the"), (3, None), (4, ""), (5, "nothing-known here"), (6, docs[7][1]), (7, "the"), (8, "23 go-1 w5 w6 w7"), (9, docs[12][1] + " " + docs[40][1])]
    return docs, queries


@pytest.mark.parametrize(("analyser", "phrased", "part"), [("plain", False, 1 << 20), ("plain", True, 20), ("porter", True, 1 << 20), ("folded", False, 20)])
def test_search(spark, texts, monkeypatch, analyser, phrased, part):
    monkeypatch.setattr(index, "PART", part)
    docs, queries = texts
    d, q = spark.createDataFrame(docs, "id long, t string").repartition(3), spark.createDataFrame(queries, "query_id long, query string")
    made = index.build(d, "id", "t", analyser, positional=phrased)
    for k in (1, 5, 1000):
        found = search.top(index.search(made, q, k, phrased), k, search.F.round("rank", 6), search.F.col("doc_id"))
        got, want = sorted((r.query_id, r.doc_id, r["rank"]) for r in found.collect()), plain_search(docs, queries, k, analyser, phrased)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_frequent_terms_are_not_read(spark, texts):
    docs, _ = texts
    made = index.build(spark.createDataFrame(docs, "id long, t string"), "id", "t")
    wanted = made.terms.filter("term IN ('the', 'w3', 'w4')").selectExpr("0 AS query_id", "term", "df", "idf", "idf * top AS most")
    bounds = index._essential(wanted, index._floors(made, wanted, 3), index.SPARE)
    assert {r.term: r.needed for r in bounds.collect()} == {"the": False, "w3": True, "w4": True}
    tops = [(r.term, r.top, max(r.impacts), len(r.docs)) for r in made.blocks.collect()]
    assert all(top == best and n <= index.SIZE for _, top, best, n in tops)
    assert sum(n for t, *_, n in tops if t == "the") == made.terms.filter("term = 'the'").first().df


def test_empty(spark):
    none, ask = spark.createDataFrame([], "id long, t string"), spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert index.search(index.build(none, "id", "t"), ask, 3).count() == 0
    some = index.build(spark.createDataFrame([(1, "a b c")], "id long, t string"), "id", "t")
    assert index.search(some, ask.limit(0), 3, phrased=True).count() == 0
    with pytest.raises(ValueError):
        index.search(index.build(none, "id", "t", positional=False), ask, 3, phrased=True)
