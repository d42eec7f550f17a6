"""op2 and op3 against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.llm import exact, neardup
from threadlake.llm.words import mix


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 9))), max_size=40), st.booleans())
def test_trie(rows, largest):
    trie = exact.Trie(largest)
    want = defaultdict(list)
    for key, owner in rows:
        trie.insert(key, owner)
        want[key].append(owner)
    found = {k: (x.owner, x.rows, x.copies) for k, x in trie.spill()}
    assert trie.held == 0
    for key, owners in want.items():
        ids = [o for o in owners if o is not None]
        best = (max if largest else min)(ids) if ids else None
        assert found.pop(key) == (best, len(owners), owners.count(best))
    assert not found


def test_trie_spills_finished_subtrees():
    trie = exact.Trie()
    keys = sorted({bytes([a, b, c]) for a in range(4) for b in range(4) for c in range(4)})
    out = []
    for k in keys:
        trie.insert(k, 1)
        out += [key for key, _ in trie.spill(k)]
        assert trie.held <= 3
    out += [key for key, _ in trie.spill()]
    assert sorted(out) == keys


def test_exact_cases(spark):
    docs = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é"), (6, "b" * 50_000), (7, "b" * 50_000), (7, "b" * 50_000), (None, "a"), (None, "c"), (None, "c"), (8, "A")]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, kept string")
    for size in (exact.TRIE_BYTES, 10):
        marked = exact.mark_duplicates(df, exact.duplicate_classes(df, trie_bytes=size)).collect()
        groups = defaultdict(list)
        for i, t in docs:
            groups[t or ""].append(i)
        assert len(marked) == len(docs)
        for r in marked:
            ids = groups[r.text or ""]
            known = [i for i in ids if i is not None]
            assert r.keep_id == (max(known) if known else None)
            assert r.group_size == len(ids)
            assert r.kept == (r.doc_id == r.keep_id)
            assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    left = exact.drop_duplicates(df)
    assert left.columns == df.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(dict.fromkeys(groups, 1))
    assert exact.drop_duplicates(df.limit(0)).count() == 0


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, shared in ((40, 36), (1000, 889)):
        agree = []
        for _ in range(30):
            x = mix(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:shared], x[n : 2 * n - shared]]))
            sa, sb = neardup.dart_signatures([a, b])
            agree.append((sa == sb).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.02
    w1, w2 = np.array([1, 2, 3.5, 0.5] * 50), np.array([1, 1, 3.5, 1.5] * 50)
    agree = []
    for _ in range(30):
        e = mix(rng.integers(0, 2**63, 200).astype(np.uint64))
        agree.append((neardup.dart_signature(e, w1) == neardup.dart_signature(e, w2)).mean())
    assert abs(np.mean(agree) - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.02


def test_darts_are_thrown_once(monkeypatch):
    """A signature of 450 values needs some 3,600 darts; each is hashed once, and cells only where a run of darts begins."""
    hashed = []
    monkeypatch.setattr(neardup, "mix", lambda x: hashed.append(x.size) or mix(x))
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, 550).astype(np.uint64) for _ in range(50)]
    one = np.ones(550, np.int64)
    whole = neardup.dart_signatures(sets, [one] * 50)
    assert sum(hashed) < 50 * 9000
    monkeypatch.setattr(neardup, "RUNS", 300)
    assert all(np.array_equal(neardup.dart_signature(s, one), row) for s, row in zip(sets, whole, strict=True))
    assert len(np.unique(whole)) == whole.size


def plain_classes(docs, least=0.8):
    sets = [neardup.units(b).tolist() for b in neardup.shingle_bags([None if t is None else t.encode() for _, t in docs])]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if a and b and len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    out = defaultdict(set)
    for i, (d, _) in enumerate(docs):
        out[find(i)].add(d)
    return sorted(map(sorted, out.values()))


def test_near_cases(spark):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        return w

    docs = []
    template = words(150)
    for _ in range(40):  # a template that takes up most of each text, but not enough for a link
        docs.append(" ".join(template + words(45)))
    base = words(200)
    for k in range(60):
        docs.append(" ".join(edited(base, k % 8)))
    for _ in range(30):
        own = words(rng.randint(1, 120))
        docs += [" ".join(own), " ".join(edited(own, 1)), " ".join(own).upper() + "!"]
    ring = words(160)
    for k in range(60):  # each differs from the next in two words, from those farther on in more
        ring[(k * 2) % 160], ring[(k * 2 + 1) % 160] = f"r{k}", f"s{k}"
        docs.append(" ".join(ring))
    line = " ".join(words(12))
    docs += [" ".join([line] * 9), " ".join([line] * 10), " ".join([line] * 3)]
    docs += [None, "", "...", "one", "One!", "two words", " ".join(words(30_000))]
    docs = list(enumerate(docs))
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, class_id string")
    marked = neardup.mark_near_duplicates(df, neardup.near_classes(df)).collect()
    got = defaultdict(list)
    for r in marked:
        got[r.class_id].append(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    assert sorted(map(sorted, got.values())) == plain_classes(docs)
    assert all(r.class_size == len(got[r.class_id]) for r in marked)
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == len(got)
    twice = df.unionByName(df)
    again = neardup.drop_near_duplicates(twice)
    wordless = 3
    assert again.count() == len(got) + wordless
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_weights_grow_with_counts():
    one, three = neardup.shingle_bags([b"a b c d e", b"a b c d e f a b c d e g a b c d e"])
    assert one[1].tolist() == [1] and sorted(three[1]) == [1] * 10 + [2]
    assert len(neardup.units(three)) == three[1].sum() == 12
    bags = neardup.shingle_bags([b"a b c d e " * 30, b"a b c d e " * 60])
    x, y = (neardup.units(b) for b in bags)
    assert np.array_equal(bags[0][0], bags[1][0]) and 0.8 < neardup.similarity(x, y) < 0.9
    a, b = neardup.dart_signatures([s for s, _ in bags], [c for _, c in bags])
    assert abs((a == b).mean() - neardup.similarity(x, y)) < 0.1


def test_near_recall(spark, sf):
    """Links found over the given table, against all pairs; the bands may miss a few of just 0.8."""
    from threadlake.llm.arrow import documents

    docs = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    found = {r.doc_id: r.class_id for r in neardup.mark_near_duplicates(documents(spark, sf), neardup.near_classes(documents(spark, sf))).collect()}
    sets = [set(neardup.units(b).tolist()) for b in neardup.shingle_bags([None if t is None else t.encode() for _, t in docs])]
    links = [(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    recall = sum(found[a] == found[b] for a, b in links) / max(1, len(links))
    print(f"{len(links)} links, recall {recall:.4f}")
    assert recall >= 0.98


def test_near_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, "a", 1), (None, text + " x", "b", 2), (None, None, "c", 3), (5, text + " y", "d", 4), (5, text + " y", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, set_id string, class_size int")
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (5, text + " y")]
