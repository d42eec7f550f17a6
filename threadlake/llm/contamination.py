"""Benchmark decontamination over suffix arrays of the training text.

Each run of about SHARD_BYTES of training text is one shard. A shard's suffix array holds, in
sorted order, the word suffixes that some test suffix could match (those that begin with enough
words of the test vocabulary; no binary search could end at another). Every test suffix is
binary-searched in every shard by its first WINDOW words; matches are followed along to
give the longest verbatim match and its place in the document.

The test set is read in blocks of at most BLOCK_BYTES, each broadcast in turn, so what is sent to
executors doesn't grow with it; the document side is never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.arrow import append_columns, as_bytes, documents
from threadlake.llm.words import hash_words

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPAN),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_start", T.LongType()),
]
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class TestSet:
    """A block of test items: vocabulary, and the distinct windows with where each occurs."""

    window: int
    vocabulary: np.ndarray  # sorted word hashes; word w has id position + 1
    need: np.ndarray  # by word id: fewest words of a window that begins with it
    sizes: np.ndarray  # words in each distinct window
    low: np.ndarray  # its key, filled up with the smallest bytes
    high: np.ndarray  # and with the largest
    next_to: np.ndarray  # whether window j follows window i somewhere, as i * n + j, sorted
    items: list[frozenset[str]]  # by window


def _keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that sort alike."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


def index_items(rows: list[tuple[str, str | None]], window: int = WINDOW) -> TestSet:
    words = hash_words([(t or "").encode() for _, t in rows])
    vocabulary, ids = np.unique(words.hashes, return_inverse=True)
    ids = np.concatenate([ids + 1, np.zeros(window, np.int64)])
    starts, sizes, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
        size = min(window, b - a)
        if size:
            s = np.arange(a, b - size + 1)
            starts.append(s)
            sizes.append(np.full(len(s), size))
            owner.append(np.full(len(s), k))
    start, size, item = (np.concatenate(x) for x in (starts, sizes, owner))
    taken = np.arange(window)[None, :] < size[:, None]
    rows_of_ids = np.where(taken, ids[start[:, None] + np.arange(window)], 0)
    _, first, which = np.unique(_keys(rows_of_ids), return_index=True, return_inverse=True)
    need = np.full(len(vocabulary) + 1, 1 << 30)
    np.minimum.at(need, ids[start], size)
    found: list[set[str]] = [set() for _ in first]
    for w, k in zip(which.tolist(), item.tolist(), strict=True):
        found[w].add(rows[k][0])
    follows = (start[1:] == start[:-1] + 1) & (item[1:] == item[:-1])
    pairs = np.unique(which[:-1][follows] * len(first) + which[1:][follows])
    distinct, n = rows_of_ids[first], size[first]
    filled = np.where(np.arange(window)[None, :] < n[:, None], distinct, (1 << 32) - 1)
    return TestSet(window, vocabulary, need, n, _keys(distinct), _keys(filled), pairs, [frozenset(x) for x in found])


def search(texts: list[bytes | None], tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts of the texts; and text, place and window of each match, in order of place."""
    ids, counts = [], []
    batch: list[bytes | None] = []
    held = 0
    for k, t in enumerate(texts):
        batch.append(t)
        held += len(t or b"")
        if held >= 1 << 20 or k == len(texts) - 1:
            words = hash_words(batch)
            at = np.searchsorted(tests.vocabulary, words.hashes)
            at[at == len(tests.vocabulary)] = 0
            known = tests.vocabulary[at] == words.hashes if len(tests.vocabulary) else np.zeros(len(at), bool)
            # a 0 after each text keeps suffixes within it
            placed = np.zeros(len(at) + len(batch), np.int64)
            placed[np.arange(len(at)) + words.owner()] = np.where(known, at + 1, 0)
            ids.append(placed)
            counts.append(words.counts())
            batch, held = [], 0
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.cumsum(n_words + 1)])
    none = np.zeros(0, np.int64)
    if not ids or not len(tests.sizes):
        return n_words, none, none, none
    word = np.concatenate([*ids, np.zeros(tests.window, np.int64)])
    gaps = np.flatnonzero(word == 0)
    place = np.flatnonzero(word)
    run = gaps[np.searchsorted(gaps, place)] - place
    fits = run >= tests.need[word[place]]
    place, run = place[fits], np.minimum(run[fits], tests.window)
    if not len(place):
        return n_words, none, none, none
    suffix = np.where(np.arange(tests.window)[None, :] < run[:, None], word[place[:, None] + np.arange(tests.window)], 0)
    keys = _keys(suffix)
    order = np.argsort(keys, kind="stable")  # the suffix array
    keys = keys[order]
    low, high = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    width = np.maximum(high - low, 0)
    hit = np.repeat(np.arange(len(width)), width)
    rank = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(len(hit))
    at = place[order[rank]]
    by = np.lexsort((hit, at))
    at, hit = at[by], hit[by]
    text = np.searchsorted(begins, at, "right") - 1
    return n_words, text, at - begins[text], hit


def _longest(at: np.ndarray, hit: np.ndarray, tests: TestSet) -> tuple[int, int]:
    """Words and start of the longest match, following windows that are next to each other in a test item too."""
    best, best_at = 0, -1
    lengths: dict[int, dict[int, int]] = {}
    n = len(tests.sizes)
    for a, w in zip(at.tolist(), hit.tolist(), strict=True):
        chain = int(tests.sizes[w])
        for v, length in lengths.get(a - 1, {}).items():
            k = np.searchsorted(tests.next_to, v * n + w)
            if k < len(tests.next_to) and tests.next_to[k] == v * n + w:
                chain = max(chain, length + 1)
        lengths.setdefault(a, {})[w] = chain
        lengths.pop(a - 2, None)
        if chain > best:
            best, best_at = chain, a + int(tests.sizes[w]) - chain
    return best, best_at


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _match_block(docs: DataFrame, text: str, tests: TestSet, drop: tuple[str, ...], earlier: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        tests = shared.value
        column = batch.schema.get_field_index(text)
        n_words, owner, at, hit = search(as_bytes(batch.column(column)), tests)
        rows = batch.num_rows
        spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        items: list[set[str]] = [set() for _ in range(rows)]
        longest, start = [0] * rows, [-1] * rows
        if earlier:
            for k, (s, i, n, a) in enumerate(zip(*(batch.column(batch.schema.get_field_index(f.name)).to_pylist() for f in FIELDS[1:]), strict=True)):
                spans[k], items[k], longest[k], start[k] = [(x["start"], x["end"]) for x in s], set(i), n, a
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(owner)), strict=False):
            k = int(owner[a])
            spans[k] = _merge(spans[k] + list(zip(at[a:b].tolist(), (at[a:b] + tests.sizes[hit[a:b]]).tolist(), strict=True)))
            items[k] |= frozenset().union(*(tests.items[w] for w in np.unique(hit[a:b])))
            n, s = _longest(at[a:b], hit[a:b], tests)
            if n > longest[k]:
                longest[k], start[k] = n, s
        return [
            pa.array(n_words, pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPAN_ARROW),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array(longest, pa.int64()),
            pa.array(start, pa.int64()),
        ]

    return append_columns(docs, text, FIELDS, compute, drop, SHARD_BYTES)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Each row of `docs` with n_words, hit_spans (word ranges inside a test window), item_ids
    (items with a window there), longest and longest_start (the longest verbatim match; 0 and -1 for none).

    Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters. A window is `window`
    consecutive words of an item; an item of fewer words is one window; one without words has none.
    Null texts have no words; a null item id is written as an empty string. Repeated rows are each
    matched; an empty benchmark matches nothing; columns with the names of new ones are replaced.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        tests = index_items([(r["i"], r["t"]) for r in block.collect()], window)
        out = _match_block(out, text, tests, drop if b == blocks - 1 else (), b > 0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, with their own columns."""
    found = find_matches(docs.withColumnsRenamed({f.name: f"__own_{f.name}" for f in FIELDS}), benchmark, **options)
    clean = found.filter(F.size("hit_spans") == 0).drop(*(f.name for f in FIELDS))
    return clean.withColumnsRenamed({f"__own_{f.name}": f.name for f in FIELDS})


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. A null text has no words; repeated rows are each matched."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_matches(docs, documents(spark, sf_dir, "benchmark"), drop=("text",))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
