"""Held-out accuracy, round trips and edge cases of the trained operators, and of pseudonyms and mixing."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from threadlake.llm import langid, lm, mixing, pii, quality, toxicity
from threadlake.llm.arrow import documents

ODD = [(1, None), (2, ""), (3, "12 !!"), (4, "\n"), (5, "x" * 200_000), (5, "x" * 200_000), (None, "hello there")]


def held_out(df, sf, spark, column):
    labels = {r.doc_id: r[column] for r in documents(spark, sf, "labels" if column != "lang" else "documents").select("doc_id", column).collect()}
    return [(r, labels[r.doc_id]) for r in df.filter("held_out").collect() if r.doc_id in labels]


def test_language(spark, sf):
    found = langid.op7_language_id(spark, sf)
    pairs = held_out(found, sf, spark, "lang")
    assert np.mean([r.lang_pred == x for r, x in pairs]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.collect())


def test_language_edges(spark, sf):
    model = langid.fit(langid.learnable(documents(spark, sf)))
    df = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, score double")
    got = langid.predict(df, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert langid.predict(df.limit(0), model).count() == 0
    clash = df.selectExpr("doc_id", "text", "1 AS __has_letter", "2 AS rejected")
    assert {r["__has_letter"] for r in langid.predict(clash, model).collect()} == {1}
    none = langid.fit(documents(spark, sf).limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_language_scores_against_plain_sums(spark, sf):
    """Probabilities subword by subword, from the table that training left."""
    texts = [r.text.encode() for r in documents(spark, sf).filter("text IS NOT NULL").select("text").limit(40).collect()]
    model = langid.train(texts, ["ab"[k % 2] for k in range(len(texts))], epochs=2)
    for text, p in zip(texts, model.probabilities(texts), strict=True):
        buckets, _ = langid.subwords([text])
        logits = [(sum(float(model.table[b, k]) for b in buckets) / max(1, len(buckets)) + model.bias[k]) / model.temperature for k in range(2)]
        top = max(logits)
        share = [math.exp(x - top) for x in logits]
        assert np.allclose(p, np.array(share) / sum(share), atol=2e-3)


def test_quality_scores_against_plain_sums():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    views = [rng.normal(0, 1, (200, 7)) + y[:, None] for _ in range(2)]
    model = quality.co_train([v[:80] for v in views], y[:80], [v[80:160] for v in views], growth=20)
    for k in range(160, 200):
        total = model.prior
        for m, v in zip(model.views, views, strict=True):
            logit = sum((v[k][j] - m.mean[j]) / m.scale[j] * m.weight[j] for j in range(7)) + m.bias
            total += 0.75 * (m.slope * logit + m.offset - model.prior)
        assert abs(model.scores([v[k : k + 1] for v in views])[0] - 1 / (1 + math.exp(-total))) < 1e-5


def test_toxicity(spark, sf):
    found = toxicity.op9_toxicity(spark, "/root/testdata/sf0.01" if sf.endswith("sf0.001") else sf)
    rows = found.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    pairs = held_out(found, "/root/testdata/sf0.01" if sf.endswith("sf0.001") else sf, spark, "toxic")
    assert np.mean([r.predicted == x for r, x in pairs]) > 0.9


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["zed"] * a + ["yak"] * b + [f"n{rng.integers(50)}" for _ in range(5)]).encode())
        y.append(int(a and b))
    model = toxicity.train(texts, y)
    s = model.scores([b"zed yak n1", b"zed n1", b"yak n1", b"n1", None])
    assert s[0] > 0.5 and s[1:].max() < 0.5


def plain_scores(model, texts):
    """The machine's scores, term by term and pair by pair."""
    out = []
    for bag in toxicity.bags_of(texts):
        x = [f for f in model.feature[bag] if f >= 0]
        s = sum(model.weight[f] for f in x)
        pairs = sum(float(model.vectors[f] @ model.vectors[g]) for i, f in enumerate(x) for g in x[:i])
        logit = model.bias + s + pairs * toxicity.TERMS / max(toxicity.TERMS, len(x))
        out.append(1 / (1 + math.exp(-(model.slope * logit + model.shift))))
    return out


def drawn(rng, n, chance, first, second, label):
    texts, y = [], []
    for _ in range(n):
        a, b = rng.random() < chance, rng.random() < chance
        words = [f"word{k}" for k in rng.integers(0, 2000, 20)] + [f"{first[rng.integers(len(first))]}"] * a + [f"{second[rng.integers(len(second))]}"] * b
        texts.append(" ".join(rng.permutation(words)).encode())
        y.append(int(label(a, b)))
    return texts, np.array(y)


@pytest.mark.parametrize("case", ["either", "both"])
def test_toxicity_of_pairs_alone(case):
    """Exactly one of two words; one of twenty insults together with one of twenty groups: no term tells by itself."""
    rng = np.random.default_rng(3)
    first, second = (["alpha"], ["omega"]) if case == "either" else ([f"insult{k}" for k in range(20)], [f"group{k}" for k in range(20)])
    chance, label = (0.5, lambda a, b: a != b) if case == "either" else (0.3, lambda a, b: a and b)
    model = toxicity.train(*drawn(rng, 6000 if case == "either" else 8000, chance, first, second, label))
    texts, y = drawn(rng, 1500, chance, first, second, label)
    s = model.scores(texts)
    assert (s[y == 1] >= 0.5).mean() > 0.9 and (s[y == 0] >= 0.5).mean() < 0.15
    assert np.allclose(plain_scores(model, texts[:50]), s[:50])


def test_one_label(spark):
    rows = [(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1)]
    got = toxicity.one_label(spark.createDataFrame(rows, "doc_id long, toxic int"), "toxic").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 0)]


def test_toxicity_edges(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    model = toxicity.train([b"bad"] * 20 + [b"good"] * 20, [1] * 20 + [0] * 20)
    assert toxicity.score(df, model).count() == len(ODD)
    clash = toxicity.score(df.selectExpr("doc_id", "text", "'x' AS score", "doc_id AS label", "text AS feature"), model)
    assert clash.columns == ["doc_id", "text", "label", "feature", "score", "predicted"] and clash.count() == len(ODD)
    assert toxicity.score(df.limit(0), model).count() == 0
    for rows in ([], [b"a"]):
        assert 0 < toxicity.train(rows, [1] * len(rows)).scores([None])[0] < 1


def test_quality(spark, sf):
    at = "/root/testdata/sf0.01" if sf.endswith("sf0.001") else sf
    found = quality.op4_quality_classifier(spark, at)
    pairs = held_out(found, at, spark, "quality")
    assert np.mean([r.predicted == x for r, x in pairs]) > 0.9


def test_quality_edges(spark):
    df = spark.createDataFrame([(*r, None, "en") for r in ODD], "doc_id long, text string, source string, lang string")
    rng = np.random.default_rng(0)
    views = [np.concatenate([rng.normal(0, 1, (40, n)) + 2 * (np.arange(40) % 2)[:, None], np.zeros((0, n))]) for n in (quality.CONTENT, quality.METADATA)]
    for model in (quality.CoTrained(), quality.co_train(views, np.arange(40) % 2, views)):
        got = quality.score(df, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_co_training_uses_both_views():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1200)
    views = [rng.normal(0, 1, (1200, 20)) + y[:, None] * 0.8 for _ in range(2)]
    model = quality.co_train([v[:60] for v in views], y[:60], [v[60:800] for v in views], growth=80)
    assert model.pseudo > 0
    assert ((model.scores([v[800:] for v in views]) >= 0.5) == y[800:]).mean() > 0.9


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_language_model(spark, sf):
    rows = lm.op6_lm_scoring(spark, sf).collect()
    texts = {r.doc_id: r.text for r in documents(spark, sf).select("doc_id", "text").collect()}
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), "\n"] for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, distinct = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + distinct + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0 < r.bits_per_byte < 8


def test_language_model_of_any_partitioning(spark, sf):
    docs = documents(spark, sf).selectExpr("doc_id", "text", "doc_id % 7 = 2 AS held")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n), "held").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(math.isclose(found[0][k], found[1][k], rel_tol=1e-9) for k in found[0])


def test_language_model_is_a_distribution():
    """Probabilities of all first bytes after two given ones add up to 1, and likewise those of the next byte of a word."""
    keys = [b"the", b"then", b"than", b"and"] * 10
    kinds = np.zeros(len(keys), np.int64)
    table = np.zeros((lm.SLOTS, 2), np.float32)
    lm.count_bits(kinds, keys, np.ones(len(keys)), table)
    mixer = lm.learn(table, kinds, keys, np.ones(len(keys)))
    first = mixer.log10(np.ones(256, np.int64), [b"ab" + bytes([k]) for k in range(256)])
    assert abs((10**first).sum() - 1) < 1e-6
    # a one-byte word is that byte and then a space; the other bytes after it share the rest
    c = mixer.log10(np.zeros(2, np.int64), [b"t", b"a"])
    assert (10**c < 1).all()


def test_language_model_learns_from_every_training_word(spark, monkeypatch):
    """Weights and map are the mean over shards that hold each training word and junction once, with its whole count."""
    monkeypatch.setattr(lm, "SHARD_ROWS", 60)
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} the Café\n", i % 5 == 0) for i in range(60)], "doc_id long, text string, held boolean").repartition(4)
    items = lm.listed_items(lm.corpus_counts(docs, "held", "doc_id", "text", 5)).cache()
    rows = items.filter("NOT more").collect()
    words = Counter(w for i in range(60) if i % 5 for w in (f"w{i}", f"w{i % 7}", "the", "café", "\n"))
    assert {bytes(r["item"]).decode(): r.c for r in rows if r.kind == lm.WORD and r.c} == words and len({(r.kind, bytes(r["item"])) for r in rows}) == len(rows)
    assert next(sorted(r.groups) for r in rows if bytes(r["item"]) == b"the") == [0, 1, 2, 3, 4]
    mixer, tokens, distinct, once = lm.train(items)
    assert (tokens, distinct, once) == (sum(words.values()), len(words), sum(c == 1 for c in words.values()))
    table = np.zeros((lm.SLOTS, 2))
    known = sorted((r.shard, r.kind, bytes(r["item"]), r.c) for r in rows if r.c)
    kinds, keys, counts = np.array([k for _, k, _, _ in known]), [x for _, _, x, _ in known], np.array([c for *_, c in known])
    lm.count_bits(kinds, keys, counts, table)
    taught = []
    for shard in sorted({s for s, *_ in known}):
        own = [i for i, r in enumerate(known) if r[0] == shard]
        own = [own[i] for i in np.random.default_rng(1).permutation(len(own))]
        taught.append(lm.learn(table.astype(np.float32), kinds[own], [keys[i] for i in own], counts[own]))
    assert len(taught) > 2
    for name in ("weights", "bias", "apm"):
        assert np.allclose(getattr(mixer, name), np.mean([getattr(m, name) for m in taught], axis=0), atol=1e-6)


def test_language_model_lists_groups_in_runs(monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 2)
    rows = [(7, 0, b"a", 0, 2), (7, 1, b"a", 1, 9), (7, 0, b"b", 1, 1), (7, 0, b"a", 3, 4), (7, 0, b"a", 2, 0)]
    got = lm._listed(pa.table({n: [r[i] for r in rows] for i, n in enumerate(("shard", "kind", "item", "g", "n"))})).to_pylist()
    assert sorted((r["kind"], r["item"], r["c"], r["more"], r["groups"]) for r in got) == [(0, b"a", 6, False, [0, 3]), (0, b"a", 6, True, [2]), (0, b"b", 1, False, [1]), (1, b"a", 9, False, [1])]


def test_language_model_tokens():
    """Tokens and what stands before them, as said word by word."""
    texts = [b"  The a\tCAF\xc3\xa9", None, b"", b"\n x\r\n"]
    t = lm.tokens_of(texts)
    own = [[*(x or b"").lower().split(), b"\n"] for x in texts]
    flat = [w for o in own for w in o]
    before = [b" \n", *((b" " + w)[-2:] for w in flat)]
    assert t.item.to_pylist() == flat and t.doc.tolist() == [i for i, o in enumerate(own) for _ in o] and t.length.tolist() == [len(w) for w in flat]
    assert lm.junction_keys(t.junction).to_pylist() == [a + w[:1] for a, w in zip(before, flat, strict=False)]
    assert len(lm.tokens_of([]).doc) == 0


def test_language_model_counts_every_pair(spark):
    """Of each group's pairs, in the order of their keys, how often training documents have them; over shards that cut between any two."""
    texts = [f"w{i} w{i % 7} the the w{i % 5} Caf\u00e9" for i in range(60)] + ["", None]
    docs = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in enumerate(texts)], "doc_id long, text string, held boolean").repartition(4)
    groups = 5
    counted = lm.corpus_counts(docs, "held", "doc_id", "text", groups).cache()
    sums = {(r.g, r.shard): lm.wide(r.sums) for r in lm.pair_sums(counted).collect()}
    plain, own = Counter(), {}
    dealt = {r.doc_id: r.g for r in docs.select("doc_id", lm._group(groups)).collect()}
    for i, text in enumerate(texts):
        t = lm.tokens_of([(text or "").encode()])
        own.setdefault(dealt[i], set()).update(lm.pair_keys(t).tolist())
        if i % 5:
            words = ["\n", *(text or "").lower().split(), "\n"]
            assert len(lm.pair_keys(t)) == len(words) - 1
            plain.update(lm.pair_keys(t).tolist())
    assert len(own) > 2 and max(plain.values()) > 40
    for g, keys in own.items():
        found = np.concatenate([sums[g, k] for k in range(groups)])
        assert found.tolist() == [plain[k] for k in sorted(keys)]
    x = np.array([0, 1, 255, 256, 1 << 40], np.uint64)
    assert lm.wide(lm.narrow(x)).tolist() == x.tolist() and lm.wide(lm.narrow(x[:0])).tolist() == []


def test_language_model_sorts_places(monkeypatch):
    key = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64)
    by_number = lm.sorted_places(key)
    monkeypatch.setattr(lm, "PLACE_BITS", 8)
    for (a, b), (x, y) in ((by_number, lm.sorted_places(key)),):
        assert np.array_equal(a, x) and np.array_equal(b, y) and np.array_equal(key[y], x)


def test_language_model_knows_followers(spark):
    """What the corpus says after a word counts, not only how often it says each word; a document's own words are no evidence for it."""
    rng = np.random.default_rng(3)
    own = [[f"w{k}" for k in rng.integers(0, 300, 80)] for _ in range(80)]
    rows = [(i, " ".join(w), False) for i, w in enumerate(own)]
    rows += [(100, " ".join(own[0]), True), (101, " ".join(rng.permutation(own[0])), True), (102, " ".join(own[1]), False)]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), "held").collect()}
    once = [got[i] for i in range(2, 80)]
    assert got[100] > 0.6 * got[101] and got[1] == got[102] > 0.6 * max(once)
    assert abs(got[101] - np.mean(once)) < 0.1 * abs(got[101])


def test_language_model_adapts_as_said_word_by_word():
    rng = np.random.default_rng(5)
    doc = np.repeat(np.arange(6), [40, 1, 0, 25, 3, 60])
    word, p = rng.integers(0, 9, len(doc)), rng.uniform(0.001, 0.2, len(doc))
    learned = np.array([True, False, True, True, False, False])
    texts = [word[doc == d].tolist() for d in range(6)]
    firsts, pairs = {}, Counter()  # of a corpus that has the learned texts, and others
    for text in [t for t, x in zip(texts, learned, strict=True) if x] + [rng.integers(0, 9, 30).tolist() for _ in range(3)]:
        for a, b in zip([None, *text[:-1]], text, strict=True) if text else ():
            firsts[a], pairs[a, b] = firsts.get(a, 0) + 1, pairs[a, b] + 1
    last = [None if i == 0 or doc[i] != doc[i - 1] else int(word[i - 1]) for i in range(len(doc))]
    n_first, n_pair = np.array([firsts.get(a, 0) for a in last]), np.array([pairs[a, int(b)] for a, b in zip(last, word, strict=True)])
    got = lm.adapted(doc, word, p, 6, n_pair, n_first, learned[doc])
    for d, text in enumerate(texts):
        total, at = np.zeros(len(lm.CACHES)), np.flatnonzero(doc == d)
        before = [None, *text[:-1]] if text else []
        both, gates, run = list(zip(before, text, strict=True)), {}, 0
        for i, (a, b) in enumerate(both):
            n = firsts.get(a, 0) - learned[d] * before.count(a)
            c = pairs[a, b] - learned[d] * both.count((a, b))
            gate = (min(run, 3), (n > 3) + (n > 100))
            hits, seen = gates.get(gate, (0, 0))
            e = lm.MOST * (hits + lm.FIRST * lm.RUNS[gate[0]]) / (seen + lm.FIRST) if n > 0 else 0.0
            gates[gate], run = (hits + (c > 0), seen + 1), run + 1 if c > 0 else 0
            same = before[:i].count(a)
            for k, (x, y) in enumerate(lm.CACHES):
                x, y = x * (i > 0), y * (same > 0)
                rest = (1 - x - y) * p[at[i]] + x * text[:i].count(b) / max(i, 1) + y * both[:i].count((a, b)) / max(same, 1)
                total[k] += math.log10((1 - e) * rest + e * c / max(n, 1))
        assert math.isclose(got[d], math.log10(np.mean(10**total)), rel_tol=1e-9, abs_tol=1e-12)


def test_language_model_edges(spark):
    df = spark.createDataFrame([(*r, r[0] == 1) for r in ODD], "doc_id long, text string, held boolean")
    got = lm.score_documents(df, "held").collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) for r in got)
    assert lm.score_documents(df.limit(0), "held").count() == 0
    clash = df.selectExpr("doc_id", "text", "held", "1 AS g", "2 AS kind", "3 AS score")
    assert lm.score_documents(clash, "held").count() == len(ODD)
    assert all(r.n_known == 0 for r in lm.score_documents(df.withColumn("held", df.doc_id.isNotNull() | df.doc_id.isNull()), "held").collect())


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pseudonyms(spark):
    cards = [f"{k:015d}" for k in range(400)]
    cards = [c + next(str(d) for d in range(10) if luhn(c + str(d))) for c in cards]
    dates = [f"{1990 + k // 12}-{k % 12 + 1:02d}-28" for k in range(240)]
    octets = [f"10.{k}.{k * 7 % 256}.1" for k in range(200)]
    social = [f"{k:03d}-12-3456" for k in range(1, 400)]
    values = cards + dates + octets + social
    df = spark.createDataFrame([(k, f"see {x}, and {x}.") for k, x in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    new = []
    for k, x in enumerate(values):
        a, b = re.fullmatch("see (.*), and (.*)\\.", got[k].text).groups()
        assert a == b and got[k].n_private == 2
        assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", x) or "." in x
        new.append(a)
    assert len(set(new)) == len(values)  # different values stay apart
    assert all(luhn(x) for x in new[: len(cards)])
    import datetime

    for x in new[len(cards) : len(cards) + len(dates)]:
        datetime.date.fromisoformat(x)
    assert all(all(int(o) < 256 for o in x.split(".")) for x in new[len(cards) + len(dates) : len(cards) + len(dates) + len(octets)])
    assert all(0 < int(x[:3]) < 900 and x[:3] != "666" for x in new[-len(social) :])


def test_pseudonym_edges(spark):
    left = ["9807915762804491", "1.2.3.400", "2023-02-29", "000-12-3456", "plain", "", None, "v1.2.3.4.5", "12345678901234567890"]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(left)], "doc_id long, text string, n_private int")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    for k, t in enumerate(left):
        if t != "9807915762804491" or not luhn(t):
            assert (got[k].text, got[k].n_private) == (t, 0), t
    odd = spark.createDataFrame([(1, "a.B@x.com A.B@x.com +1 (017) 555-7713 " + "ab@" * 3000 + " 9" * 50_000), (1, "a.B@x.com")], "doc_id long, text string")
    a, b = pii.pseudonymise(odd, "k").orderBy("n_private").collect()
    assert a.text in b.text and "555-7713" not in b.text
    assert pii.pseudonymise(odd, key="other").filter("text = 'a.B@x.com'").count() == 0
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def plain_permutation(values, radix, kind, key):
    """The Feistel rounds digit by digit."""
    half, v = len(values) // 2, list(values)
    for r in range(pii.ROUNDS):
        first = r % 2 == 0
        other = v[half:] if first else v[:half]
        digest = hashlib.sha512(":".join((key, kind, str(r), ".".join(map(str, radix)), ",".join(map(str, other)))).encode()).hexdigest()
        v = [(x + int(digest[i % 32 * 4 : i % 32 * 4 + 4], 16)) % radix[i] if (i < half) == first else x for i, x in enumerate(v)]
    return v


def test_permutation_against_plain_rounds(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [([int(rng.integers(0, r)) for r in radix], radix) for radix in ([10] * 15, [256] * 4, [189, 773], [898, 99, 9999], [26, 1, 10, 10, 26]) for _ in range(20)]
    df = spark.createDataFrame(rows, "v array<int>, radix array<int>")
    for r in df.withColumn("out", pii.permute(F.col("v"), F.col("radix"), "card", "secret")).collect():
        assert list(r.out) == plain_permutation(r.v, r.radix, "card", "secret")


def test_pseudonyms_keep_their_format(spark):
    texts = ["9dE4" * 8, "12/25/2024", "+49 30 1234567", "555-123-4567", "555.123.4567"]
    df = spark.createDataFrame([(k, f"<{t}>") for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text[1:-1] for r in pii.pseudonymise(df, "k").collect()}
    assert all(got[k] != t and len(got[k]) == len(t) for k, t in enumerate(texts))
    assert re.fullmatch("[0-9a-fA-F]{32}", got[0]) and re.fullmatch(r"\d\d/\d\d/\d{4}", got[1])
    assert re.fullmatch(r"\+49 \d\d \d{7}", got[2]) and re.fullmatch(r"\d{3}-\d{3}-\d{4}", got[3]) and re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", got[4])


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    df = spark.range(27 * 37).select(F.array((F.col("id") % 27).cast("int"), F.floor(F.col("id") / 27).cast("int")).alias("v"))
    out = df.select(pii.permute(F.col("v"), F.array(F.lit(27), F.lit(37)), "x", "k").alias("p"))
    assert out.distinct().count() == 27 * 37
    assert out.filter("p[0] < 0 OR p[0] >= 27 OR p[1] < 0 OR p[1] >= 37").count() == 0


def test_mixing(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "source")
    want = {"de": 0.3, "en": 0.3, "es": 0.2, "fr": 0.2}
    rows = mixing.mix_sources(docs, mixing.language_labels(documents(spark, sf)), weights=want).collect()
    total = sum(r.n_tokens for r in rows)
    got = defaultdict(float)
    for r in rows:
        assert r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-6 and abs(r.copies - r.rate) <= 1
        for d, p in zip(r.domains, r.posterior, strict=True):
            got[d] += r.rate * r.n_tokens * p / total
    for d, x in want.items():
        assert abs(got[d] - x) < 0.01
    assert len(rows) == docs.count()


def test_mixing_edges(spark, sf):
    df = spark.createDataFrame([(*r, None if r[0] == 1 else "s", "x") for r in ODD], "doc_id long, text string, source string, rate string")
    labels = mixing.language_labels(documents(spark, sf))
    assert mixing.mix_sources(df, labels).count() == len(ODD)
    assert mixing.mix_sources(df, labels.limit(0)).count() == len(ODD)
    assert mixing.mix_sources(df.limit(0), labels).count() == 0
    clash = df.selectExpr("doc_id", "text", "source", "1 AS start", "2 AS __source", "3 AS __words", "4 AS rate", "5 AS __start")
    got = mixing.mix_sources(clash, labels)
    assert got.columns == ["doc_id", "text", "source", "start", "__source", "__words", "__start", *mixing.NEW]
    assert {(r.start, r["__source"], r["__words"], r["__start"]) for r in got.collect()} == {(1, 2, 3, 5)}


def test_mixing_against_plain_descent(spark, sf):
    """Rates and their draw, from the same posteriors, by descent over all documents at once."""
    docs = documents(spark, sf).select("doc_id", "text", "source")
    want = {"de": 0.3, "en": 0.3, "es": 0.2, "fr": 0.2}
    rows = mixing.mix_sources(docs, mixing.language_labels(documents(spark, sf)), weights=want).collect()
    n, p = np.array([float(r.n_tokens) for r in rows]), np.array([r.posterior for r in rows])
    own = defaultdict(float)
    for r in rows:
        own[r.source] += r.n_tokens
    tokens, live = n.sum(), sum(x > 0 for x in own.values())
    start = np.array([tokens / live / own[r.source] if own[r.source] else 1.0 for r in rows])
    gram = (n[:, None] * p).T @ (n[:, None] * p)
    inverse = np.linalg.pinv(gram + np.eye(p.shape[1]) * (1e-9 * gram.trace() + 1e-12))
    goal, rate = tokens * np.array([want[d] for d in rows[0].domains]), start
    for _ in range(mixing.STEPS):
        residual = (rate * n) @ p - goal
        if np.abs(residual).max() / goal.sum() <= mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - n * (p @ (inverse @ residual)))
    assert np.allclose(rate, [r.rate for r in rows], rtol=1e-6, atol=1e-9)
    assert all(r.off_target <= mixing.TOLERANCE for r in rows)


@pytest.mark.parametrize("name", ["op4_quality_classifier", "op5_pii", "op8_mixing", "op9_toxicity"])
def test_one_row_a_document(spark, sf, name):
    from threadlake.llm.queries import QUERIES

    assert QUERIES[name](spark, sf).count() == documents(spark, sf).count()


def test_dates_of_both_readings_stay_apart(spark):
    from pyspark.sql import functions as F

    texts = [f"{a:02d}/{b:02d}/{y}" for y in (1800, 1996, 2199) for a in range(1, 32) for b in range(1, 32)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.pseudonymise(df, "k").collect()
    new = {r.text: r.n_private for r in rows}
    assert len(new) == len(texts)
    moved = [x for x, n in new.items() if n]
    dates = [t for t in texts if _is_date(t[:2], t[3:5], t[6:]) or _is_date(t[3:5], t[:2], t[6:])]
    assert len(dates) - 3 <= len(moved) <= len(dates)  # a value may be its own pseudonym
    assert all(_is_date(x[:2], x[3:5], x[6:]) or _is_date(x[3:5], x[:2], x[6:]) for x in moved)
    # the dates after the 12th are permuted among themselves, over all months
    late = spark.sql("SELECT explode(sequence(date'1800-01-01', date'2199-12-31')) AS d").filter("day(d) > 12")
    out = late.select(pii._late_date(F.col("d"), "k").alias("x"))
    assert out.filter("day(x) > 12").distinct().count() == late.count() == 9 * 9833


def _is_date(day, month, year):
    import datetime

    try:
        return bool(datetime.date(int(year), int(month), int(day)))
    except ValueError:
        return False


def test_key_stays_out_of_the_plan(spark):
    df = spark.createDataFrame([("mail a@b.io", "x", "y", 5)], "text string, __found string, __fresh string, __key int")
    out = pii.pseudonymise(df, "SECRETKEY")
    rows = out.collect()
    assert "SECRETKEY" not in out._jdf.queryExecution().toString()
    assert out.columns == ["text", "__found", "__fresh", "__key", "n_private"]
    assert rows[0][1:] == ("x", "y", 5, 1) and rows[0].text != "mail a@b.io"
    assert pii.key_id("k") == pii.key_id("k") != pii.key_id("l")
