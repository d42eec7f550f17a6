"""Removal of repeated passages, windows of WINDOW words, by super-k-mers.

A window's minimiser is the run of MINIMISER words in it with the least hash (the first of equal ones).
Consecutive windows of a document that share a minimiser make a super-k-mer and travel as one string of
text to the minimiser's bucket, where sorting brings equal windows together and all but the earliest of each
are marked for removal.

Three things keep this small and even:
* a first pass counts minimisers; windows whose minimiser is nowhere else in the corpus stay at home;
* documents are dealt to groups of about GROUP_BYTES, and of windows that repeat within a group only the
  first travels (the others are repeats for certain), so a passage costs a string for each group at most;
* windows of a minimiser with more than HOT super-k-mers travel singly to buckets of their own hash.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.arrow import as_bytes, documents
from threadlake.llm.words import Words, hash_words, window_hashes

WINDOW = 20
MINIMISER = 8
GROUP_BYTES = 8 << 20
HOT = 2000
_PIECE = 1 << 20


def super_kmers(words: Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each super-k-mer, as places in all words of the texts."""
    none = np.zeros(0, np.int64)
    span = window - size + 1
    runs = window_hashes(words.hashes, size)
    if len(runs) < span:
        return none, none, none
    least = np.lib.stride_tricks.sliding_window_view(runs, span)
    at = np.arange(len(least)) + least.argmin(axis=1)
    left = np.repeat(words.offsets[1:], words.counts())[: len(least)] - np.arange(len(least))
    inside = left >= window  # windows that end within their text
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    bounds = np.flatnonzero(new | ~inside)
    after = np.append(bounds, len(at))[np.searchsorted(bounds, first) + 1]
    return first, after - first, runs[at[first]].view(np.int64)


def _ordered(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """Rows of a group as (document, copy, text): by id, rows that repeat an id numbered by text; a null id comes first."""
    ids, texts = table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks())
    rows = sorted((-(1 << 63) if i is None else i, t or b"") for i, t in zip(ids, texts, strict=True))
    out, last, copy = [], None, 0
    for i, t in rows:
        copy = copy + 1 if i == last else 0
        last = i
        out.append((i, copy, t))
    return out


def _runs(rows: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    start, held = 0, 0
    for k, r in enumerate(rows):
        held += len(r[2])
        if held >= _PIECE or k == len(rows) - 1:
            yield rows[start : k + 1]
            start, held = k + 1, 0


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _minimisers(window: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        found = [super_kmers(hash_words([t for _, _, t in part], folded=False), window, size)[2] for part in _runs(_ordered(table))]
        key, n = np.unique(np.concatenate(found), return_counts=True)
        return _batch(["minimiser", "g", "n"], [pa.int64()] * 3, [key, np.full(len(key), g), n])

    return run


_TRAVEL = "bucket long, doc_id long, copy long, start long, windows long, passage binary"
_TRAVEL_NAMES = ["bucket", "doc_id", "copy", "start", "windows", "passage"]


def _travel(window: int, size: int, hot_at: int):
    """Strings of windows that may repeat elsewhere; rows without a string are windows already known to repeat."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        repeated = np.asarray(shared.column("minimiser"), np.int64)
        order = np.argsort(repeated)
        repeated, hot = repeated[order], np.asarray(shared.column("total"), np.int64)[order] > hot_at
        kinds = [pa.int64()] * 5 + [pa.binary()]
        if not len(repeated) or not table.num_rows:
            return _batch(_TRAVEL_NAMES, kinds, [[]] * 6)
        parts = []
        for part in _runs(_ordered(table)):
            words = hash_words([t for _, _, t in part], folded=False)
            first, n, key = super_kmers(words, window, size)
            k = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
            known = repeated[k] == key
            first, n, key, k = first[known], n[known], key[known], k[known]
            which = np.repeat(np.arange(len(first)), n)
            start = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            parts.append((part, words, key[which], hot[k][which], start, window_hashes(words.hashes, window)[start] if len(start) else np.zeros(0, np.uint64)))
        base = np.cumsum([0] + [len(p[1].hashes) for p in parts])
        all_words = np.concatenate([p[1].hashes for p in parts])
        start = np.concatenate([p[4] + b for p, b in zip(parts, base, strict=False)])
        h = np.concatenate([p[5] for p in parts])
        # of windows that repeat in this group, the first travels
        by = np.lexsort((start, h))
        new = np.ones(len(by), bool)
        new[1:] = h[by][1:] != h[by][:-1]
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
        copy_of = np.empty(len(by), np.int64)
        copy_of[by] = head
        later = copy_of != np.arange(len(by))
        for j in range(window):
            later[later] = all_words[start[later] + j] == all_words[start[copy_of[later]] + j]
        out: list[list] = [[] for _ in range(6)]
        at = 0
        for (part, words, key, is_hot, place, own_h), _ in zip(parts, base, strict=False):
            stays = later[at : at + len(place)]
            at += len(place)
            if not len(place):
                continue
            text = np.searchsorted(words.offsets, place, "right") - 1
            cut = np.ones(len(place), bool)
            cut[1:] = (place[1:] != place[:-1] + 1) | (text[1:] != text[:-1]) | (stays[1:] != stays[:-1])
            cut[1:] |= ~stays[1:] & ((key[1:] != key[:-1]) | is_hot[1:])
            begins = np.flatnonzero(cut)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(place)], strict=True):
                doc, copy, _ = part[text[a]]
                w = int(place[a])
                for column, value in zip(
                    out,
                    (
                        doc if stays[a] else int(own_h[a : a + 1].view(np.int64)[0]) if is_hot[a] else int(key[a]),
                        doc,
                        copy,
                        w - int(words.offsets[text[a]]),
                        b - a,
                        None if stays[a] else words.data[words.starts[w] : words.ends[w + b - a + window - 2]].tobytes(),
                    ),
                    strict=True,
                ):
                    column.append(value)
        return _batch(_TRAVEL_NAMES, kinds, out)

    return run


_SPANS = "doc_id long, copy long, start long, end long"


def _mark(window: int):
    """Of each bucket's equal windows all but the earliest, as spans of words."""

    def windows_of(rows: list[tuple]) -> Iterator[tuple]:
        words = hash_words([r[5] for r in rows], folded=False)
        n = np.array([r[4] for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        place = words.offsets[:-1][row] + nth
        h = window_hashes(words.hashes, window)[place]
        bucket, doc, copy, start = (np.array([r[j] for r in rows])[row] for j in range(4))
        start = start + nth
        order = np.lexsort((start, copy, doc, h, bucket))
        same = (h[order][1:] == h[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
        differ = same.copy()
        for j in range(window):
            word = words.hashes[place[order] + j]
            differ &= word[1:] == word[:-1]
        if (differ != same).any():  # hashes collide: sort by the words themselves
            columns = [words.hashes[place + j] for j in range(window)]
            order = np.lexsort((start, copy, doc, *columns, bucket))
            same = bucket[order][1:] == bucket[order][:-1]
            for c in columns:
                same &= c[order][1:] == c[order][:-1]
        gone = np.sort(order[1:][same])
        if len(gone):
            new = np.ones(len(gone), bool)
            new[1:] = (gone[1:] != gone[:-1] + 1) | (row[gone[1:]] != row[gone[:-1]])
            a = gone[new]
            b = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
            yield from zip(doc[a].tolist(), copy[a].tolist(), start[a].tolist(), (start[b] + window).tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    yield from zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns), strict=True)

        def spans() -> Iterator[tuple]:
            held: list[tuple] = []
            size = 0
            for _, bucket in itertools.groupby(rows(), key=lambda r: r[0]):
                for r in bucket:
                    if r[5] is None:
                        yield r[1], r[2], r[3], r[3] + r[4] - 1 + window
                    else:
                        held.append(r)
                        size += len(r[5])
                if size > _PIECE // 2:
                    yield from windows_of(held)
                    held, size = [], 0
            if held:
                yield from windows_of(held)

        found = spans()
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["doc_id", "copy", "start", "end"])

    return run


def _cut_out(with_text: bool):
    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, copy, a, b in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "copy", "start", "end")), strict=True):
            gone.setdefault((doc, copy), []).append((a, b))
        out: list[list] = [[] for _ in range(6)]
        for doc, copy, text in _ordered(table) if table.num_rows else []:
            words = text.split()
            keep = np.ones(len(words), bool)
            for a, b in gone.get((doc, copy), ()):
                keep[a:b] = False
            kept = b" ".join(itertools.compress(words, keep.tolist()))
            n_removed = int(len(words) - keep.sum())
            row = (None if doc == -(1 << 63) else doc, copy, len(words), n_removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return _batch(
            ["doc_id", "copy", "n_words", "n_removed", "kept_sha256", "kept_text"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], out
        )

    return run


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    minimiser: int = MINIMISER,
    group_bytes: int = GROUP_BYTES,
    hot: int = HOT,
    with_text: bool = True,
) -> DataFrame:
    """doc_id, copy, n_words, n_removed, kept_sha256 and kept_text for each row of `docs`.

    Words are runs of characters other than space and \\x09-\\x0D. A word is removed if a window of `window`
    words covers it whose words also start earlier: in a document of smaller id, or earlier in the same one.
    Null texts have no words. Rows that repeat an id are told apart by copy, in the order of their texts, of
    which the first counts as earlier; rows of null id come before all others. Whole texts are read; an empty table
    gives none; other columns are not carried on, so none can clash. Rows are dealt out by id: all rows of one id,
    or of none, are one group and meet in one task.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.select(group, "doc_id", "text").groupBy("g")
    counted = dealt.applyInArrow(_minimisers(window, minimiser), "minimiser long, g long, n long")
    total = counted.groupBy("minimiser").agg(F.sum("n").alias("total")).filter("total > 1")
    shared = counted.select("minimiser", "g").join(total, "minimiser").select("g", "minimiser", "total")
    strings = dealt.cogroup(shared.groupBy("g")).applyInArrow(_travel(window, minimiser, hot), _TRAVEL)
    spans = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_mark(window), _SPANS)
    sent = spans.withColumn("g", F.pmod(F.xxhash64(F.when(F.col("doc_id") > F.lit(-(1 << 63)), F.col("doc_id"))), F.lit(groups)))
    out = "doc_id long, copy long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return dealt.cogroup(sent.groupBy("g")).applyInArrow(_cut_out(with_text), out)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the hash of the words that stay."""
    found = remove_repeats(documents(spark, sf_dir), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM p),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS q FROM r WHERE n > 1) GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY q), '') AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) x
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS q FROM g) y WHERE y.doc_id = x.doc_id AND y.q = x.q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
