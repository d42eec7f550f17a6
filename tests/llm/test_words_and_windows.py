"""op1 and op10 against plain versions, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.util import assert_same
from threadlake.llm import contamination, queries, substring
from threadlake.llm.words import FOLDED_RE, hash_words, window_hashes


def lowered(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for folded, split in ((True, lambda t: FOLDED_RE.findall(lowered(t))), (False, lambda t: (t or "").encode().split())):
        words = hash_words([None if t is None else t.encode() for t in texts], folded)
        want = [split(t) for t in texts]
        assert words.counts().tolist() == [len(w) for w in want]
        flat = [w for x in want for w in x]
        assert len(set(zip(flat, words.hashes.tolist()))) == len(set(flat)) == len(set(words.hashes.tolist()))


def test_window_hashes():
    words = hash_words([b"a b c a b c"]).hashes
    h = window_hashes(words, 3)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3
    assert len(window_hashes(words, 7)) == 0


def plain_contamination(docs, items, window=10):
    out = []
    windows = {}
    for i, t in items:
        w = FOLDED_RE.findall(lowered(t))
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i) if i is not None else "")
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, found = FOLDED_RE.findall(lowered(t)), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (x := tuple(w[p : p + k])) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_contamination_cases(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, item(rng.randint(1, 25))) for k in range(6)] + [(6, None), (7, ""), (None, "only w1 here"), (8, "X"), (8, item(12))]
    docs = [(k, f"{item(30)}. {rng.choice(items)[1] or ''} {item(20)}") for k in range(25)] + [(30, None), (31, ""), (32, "x"), (32, "x"), (None, items[0][1]), (33, item(3000))]
    d = spark.createDataFrame([(*r, "kept") for r in docs], "doc_id long, text string, item_ids string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 24, 60):  # one block, and several
        found = contamination.find_matches(d, b, block_bytes=block)
        got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.hit_spans), list(r.item_ids)) for r in found.collect()), key=repr)
        assert got == plain_contamination(docs, items)
    clean = contamination.decontaminate(d, b)
    assert clean.columns == d.columns
    want = sorted((r for r in docs if not [x for x in plain_contamination([r], items)][0][3]), key=repr)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == want
    assert contamination.find_matches(d.limit(0), b).count() == 0
    assert contamination.find_matches(d, b.limit(0)).filter("size(hit_spans) > 0").count() == 0


def test_longest_match(spark):
    item = " ".join(f"a{k}" for k in range(40))
    text = "x y " + " ".join(f"a{k}" for k in range(5, 30)) + " z"
    r = contamination.find_matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r.longest, r.longest_start) == (25, 2)


def plain_repeats(docs, window=20):
    seen, out = set(), []
    order = sorted(docs, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    for d, t in order:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            if x in seen:
                gone |= set(range(p, p + window))
            seen.add(x)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_cases(spark):
    rng = random.Random(5)
    line = lambda n, v=400: " ".join(f"w{rng.randint(0, v)}" for _ in range(n))
    shared, short = line(60), line(24)
    docs = [(k, f"{line(rng.randint(0, 40))}\n{shared if k % 3 == 0 else ''} {line(15)}\t{short if k % 2 == 0 else ''} {line(10)}") for k in range(60)]
    docs += [(100, shared), (101, shared), (102, None), (103, ""), (104, f"{short} {short} {short}"), (105, "der " * 90), (106, line(5000, 3)), (107, line(5000, 3))]
    docs += [(110, shared), (110, shared), (110, line(50)), (None, shared), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"group_bytes": 4000, "hot": 3}, {"minimiser": 3, "group_bytes": 9000}):
        found = substring.remove_repeats(df, **options)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()), key=repr)
        assert got == plain_repeats(docs), options
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_sql(spark, sf, duck):
    for name in ("op1_benchmark_decontamination", "op10_substring_dedup", "op2_exact_dedup"):
        assert_same(queries.QUERIES[name](spark, sf), duck.execute(queries.SQL[name]))
