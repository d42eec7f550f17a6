"""op11 to op13 against plain versions, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.util import assert_same
from threadlake.llm import divergence, manifest, queries, sharding
from threadlake.llm.words import FOLD

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, slot int, at string, part string"


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)] + ["Ä", "É", "BIG", "zzö"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", ".", "7"]) for _ in range(rng.randint(0, 30)))
        rows.append((k, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", None]), len(text), 1, "x", "y"))
    rows += [(5, "again", "en", "a", None, 1, "x", "y")] * 3 + [(None, t, "en", "hot", 2, None, None, None) for t in ("x y", None, "", "x y")]
    rows += [(1000, None, "fr", "only", None, None, None, None), (1001, "Long wä " * 30_000, "it", "a", 1, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(5)


def test_sql(spark, sf, duck):
    for name in ("op11_sharding", "op12_merkle_manifest", "op13_source_divergence"):
        assert_same(queries.QUERIES[name](spark, sf), duck.execute(queries.SQL[name]))


def test_shards_grow_only_into_the_new_one(spark, docs):
    weights = (1.0, 2.0, 1.0, 4.0)
    many = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(many, weights, new_weight=2.0).collect()
    held = Counter(r.shard for r in rows)
    for k, w in enumerate(weights):
        assert abs(held[k] / 20_000 - w / 8) < 0.02
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    assert abs(sum(r.grown_shard == 4 for r in rows) / 20_000 - 0.2) < 0.02
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(many, (*weights, 2.0)).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in rows}
    kept = sharding.assign_shards(docs)
    assert kept.columns == [*docs.columns, "shard", "grown_shard"]
    assert len({(r.doc_id, r.shard) for r in kept.collect()}) == len({r[0] for r in corpus()})
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, (1.0, 0.0))


@pytest.mark.parametrize(("cell", "run"), [(50_000, 10_000), (7, 4)])
def test_slots_have_no_gap(spark, docs, cell, run):
    hot = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "same")] * 150 + [(7, f"t{k}") for k in range(150)], "doc_id long, text string"))
    rows = sharding.number_slots(sharding.assign_shards(hot, (1.0,) * 5), cell=cell, run=run).collect()
    assert len(rows) == hot.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(map(tuple, hot.collect()))
    plain = sharding.number_slots(sharding.assign_shards(hot.repartition(3), (1.0,) * 5)).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, rows))  # neither cells nor partitions show
    assert sharding.number_slots(sharding.assign_shards(hot.limit(0))).count() == 0


def test_shards_on_disk(spark, docs, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/shards", (1.0, 1.0))
    back = spark.read.schema(f"{COLUMNS}, shard int").parquet(f"file://{tmp_path}/shards")
    assert Counter(r[0] for r in back.collect()) == Counter(r[0] for r in corpus())


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fan=8):
    """The root of a sequence and each leaf's siblings by level, as lists of those before and after."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    paths = []
    for k in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = k // fan * fan
            path.append((level[run:k], level[k + 1 : run + fan]))
            k //= fan
        paths.append(path)
    return levels[-1][0], paths


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain_manifest(rows):
    parts = defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        changed = None if text is None else text.encode().translate(FOLD).decode()
        own = plain_leaf(i, source, lang, n, text)
        again = plain_leaf(i, source, lang, n, changed) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else own
        parts[lang].append((i is not None, i or 0, own, again, i))
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {p: plain_tree([r[2] for r in sorted(parts[p], key=lambda r: r[:3])]) for p in order}
    root, tops = plain_tree([trees[p][0] for p in order])
    out = []
    for p, top in zip(order, tops, strict=True):
        for r, path in zip(sorted(parts[p], key=lambda r: r[:3]), trees[p][1], strict=True):
            fold = r[3]
            for left, right in [*path, *top]:
                fold = h(*left, fold, *right)
            proof = h(*(x for left, right in [*path, *top] for x in (*left, *right)))
            out.append((r[4], r[2], trees[p][0], root, proof, fold, fold == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("depth", [manifest.DEPTH, 1, 2])
def test_manifest(docs, depth):
    """Blocks of any size give the one tree: whole parts, parts of several blocks, several rounds."""
    got = [tuple(r) for r in manifest.audited(docs, depth).collect()]
    assert sorted(got, key=repr) == plain_manifest(corpus())


def test_manifest_of_little(spark, docs):
    assert manifest.witnesses(docs.limit(0)).count() == 0
    one = manifest.witnesses(docs.filter("doc_id = 1000")).first()
    assert (one.left, one.right) == ([], []) and one.leaf == one.subroot == one.root


def test_manifest_of_many_parts(spark):
    rows = [(k, f"t{k}", f"l{k % 70}", "s", 1, None, None, None) for k in range(300)]
    for depth in (manifest.DEPTH, 1):
        got = [tuple(r) for r in manifest.audited(spark.createDataFrame(rows, COLUMNS), depth).collect()]
        assert sorted(got, key=repr) == plain_manifest(rows)


def plain_audit(rows, top=200, least=3):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in "".join(c if c.isascii() and c.isalpha() or c >= "\x80" else " " for c in text).split(" ") if w]
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        own = [s for x, s in groups if x == lang]
        table = {s: {w: counts[lang, s][w] for w in kept} for s in own}
        whole = {w: sum(table[s][w] for s in own) for w in kept}
        rate = lambda t: {w: 1 + 10**9 * (n + 1) // (sum(t.values()) + len(kept)) for w, n in t.items()}
        p, q = {s: rate(table[s]) for s in own}, rate(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = sorted(((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode()) for t in own if t != s))
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if table[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, x.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("piece", "held"), [(divergence.PIECE, divergence.HELD), (200, 5)])
def test_audit(docs, piece, held):
    for top in (200, 3):
        assert sorted(map(tuple, divergence.audit(docs, top=top, piece=piece, held=held).collect())) == plain_audit(corpus(), top)


def test_audit_without_kept_terms(spark, docs):
    few = [(1, "a b", "en", "s1", 1, None, None, None), (2, None, "en", "s2", 1, None, None, None)]
    df = spark.createDataFrame(few, COLUMNS)
    assert sorted(map(tuple, divergence.audit(df).collect())) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]
    assert divergence.audit(df.limit(0)).count() == 0


def test_tree_equals_all_pairs():
    rng = random.Random(1)
    rows = sorted(Counter(tuple((p, 50 + 10 * p, rng.randint(1, 2)) for p in range(1, 7) if rng.random() < 0.6) for _ in range(400)).items())
    path, want, v = divergence.Path(), Counter(), 400
    p = lambda size, n: 1 + 10**9 * (n + 1) // (size + v)
    f = lambda a, b: (a - b) * (a - b) // b
    for row, m in rows:
        if row:
            path.insert(list(row), m, v)
        for a, sa, na in row:
            for b, sb, nb in row:
                if a != b:
                    want[a, b] += m * (f(p(sa, na), p(sb, nb)) - f(p(sa, na), p(sb, 0)) - f(p(sa, 0), p(sb, nb)) + f(p(sa, 0), p(sb, 0)))
    path.close()
    a, b, value = path.sums()
    assert {(x, y): z for x, y, z in zip(a.tolist(), b.tolist(), value.tolist(), strict=True)} == dict(want)
