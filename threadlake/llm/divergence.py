"""How far the sources of each language differ in their terms, by a frequent-pattern tree of term rows.

A term's row is its counts in the sources of one language, without the zeros, in the order of the sources; most terms are rare,
so many share a row, and rows of different terms begin alike. With p the smoothed rate of a count and f(p, q) the divergence of
one term, a pair of sources would need f for every term. But f of two zero counts is one number, f of a count and a zero
depends on that count alone, and only terms that both sources have need more:

    sum f = V f(0, 0) + sum over counts [f(a, 0) - f(0, 0)] + sum over counts [f(0, b) - f(0, 0)]
          + sum over terms in both [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)]

The last sum comes from the tree. Distinct rows, with the number of terms that have them, are inserted in sorted order, so that
a partition's tree is one path at a time: a node (source, count) that the next row does not share is final, and the correction of
it with each of its ancestors counts once, times the terms through the node. Each partition has a tree over a range of rows; sums
add up over trees. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.llm.arrow import as_bytes, documents, pieces, saved
from threadlake.llm.words import LETTERS, hash_words, mix

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
PIECE = 4 << 20
HELD = 1 << 19

_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(limit: int):
    """Occurrences and documents of the terms of each run of texts by (lang, source); an empty term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", limit):
                groups: dict[tuple[str, str], int] = {}
                pairs = zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), strict=True)
                group = np.array([groups.setdefault(x, len(groups)) for x in pairs], np.int64)
                words = hash_words(as_bytes(piece.column("text")), kind=LETTERS)
                doc = words.owner()
                of = group[doc]
                key = words.hashes ^ mix(of.astype(np.uint64) + np.uint64(1))
                order = np.argsort(key, kind="stable")
                if _clash(key[order], of[order], words.hashes[order]):
                    order = np.lexsort((of, words.hashes))
                sorted_of, sorted_hash, sorted_doc = of[order], words.hashes[order], doc[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_of[1:] != sorted_of[:-1])
                first = np.flatnonzero(fresh)
                in_doc = fresh.copy()
                in_doc[1:] |= sorted_doc[1:] != sorted_doc[:-1]
                n = np.diff(np.append(first, len(order)))
                docs = np.add.reduceat(in_doc.astype(np.int64), first) if len(first) else n
                terms = _strings(words.data, words.starts[order[first]], words.ends[order[first]])
                langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
                at = pa.array(sorted_of[first])
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
                none = pa.array([0] * len(groups), pa.int64())
                yield pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * len(groups), pa.string()), none, none], names=["lang", "source", "term", "n", "docs"])

    return run


def _clash(key: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> bool:
    """Whether different (group, word) share a key."""
    return bool(((key[1:] == key[:-1]) & ((of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1]))).any())


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes()))


def rate(n: str, size: str, terms: str) -> Column:
    """The smoothed rate of a count of n among `size`, in billionths."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(38, 0)) * ({n} + 1)) div ({size} + {terms}) AS BIGINT)")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Terms (lang, term, total, row: counts by source) and groups (lang, source, place, size, terms, whole), both saved.

    size is the group's number of kept terms said, terms the language's number of different ones, whole its size; place orders a
    language's sources by how many terms they have. Null lang, source or text count as empty. A list of counts has one entry
    for each source of the language.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))))
    counted = own.mapInArrow(_count(piece), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = saved(counted, "divergence-counts")
    rows = counted.filter("term <> ''").groupBy("lang", "term")
    terms = rows.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    terms = saved(terms.filter(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    sizes = terms.select("lang", F.explode("row").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("size"), F.count("*").alias("had"))
    groups = counted.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").na.fill(0)
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole"))
    order = Window.partitionBy("lang").orderBy(F.desc("had"), "source")
    groups = groups.join(langs, "lang", "left").na.fill(0).withColumn("place", F.row_number().over(order))
    return terms, saved(groups.drop("had"), "divergence-groups")


def _f(p, q):
    return (p - q) * (p - q) // q


class Path:
    """The open path of a tree; what leaves it is final, and is met with its ancestors many nodes at a time."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []
        self.terms: list[int] = []
        self.nodes = np.zeros((3, 8), np.int64)  # place, rate and rate of a zero count, for each item
        self.above: list[np.ndarray] = []
        self.final: list[tuple[int, int, int, int, int]] = []
        self.held = 0

    def insert(self, row: list[tuple[int, int, int]], m: int, v: int) -> None:
        shared = 0
        while shared < min(len(row), len(self.items)) and row[shared] == self.items[shared]:
            shared += 1
        self.close(shared)
        if len(row) > self.nodes.shape[1]:
            self.nodes = np.concatenate([self.nodes, np.zeros((3, len(row)), np.int64)], axis=1)
        for place, size, n in row[shared:]:
            self.nodes[:, len(self.items)] = place, 1 + SCALE * (n + 1) // (size + v), 1 + SCALE // (size + v)
            self.items.append((place, size, n))
            self.terms.append(0)
        self.terms[-1] += m

    def close(self, depth: int = 0) -> None:
        """Nodes below `depth` are final; their terms pass through their parents too."""
        while len(self.items) > depth:
            k = len(self.items) - 1
            m = self.terms.pop()
            self.items.pop()
            if k:
                self.terms[-1] += m
                self.above.append(self.nodes[:, :k].copy())
                self.final.append((k, m, *self.nodes[:, k].tolist()))
                self.held += k

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrections of the final nodes with their ancestors so far, by source and other source."""
        above = np.concatenate(self.above, axis=1) if self.above else np.zeros((3, 0), np.int64)
        k, *rest = (np.array(x, np.int64) for x in zip(*self.final, strict=True)) if self.final else [np.zeros(0, np.int64)] * 5
        m, node, pn, zn = (np.repeat(x, k) for x in rest)
        self.above, self.final, self.held = [], [], 0
        place, p, z = above
        down = _f(p, pn) - _f(p, zn) - _f(z, pn) + _f(z, zn)
        up = _f(pn, p) - _f(pn, z) - _f(zn, p) + _f(zn, z)
        one, other, value = np.concatenate([place, node]), np.concatenate([node, place]), np.concatenate([m * down, m * up])
        order = np.lexsort((other, one))
        one, other, value = one[order], other[order], value[order]
        first = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (other[1:] != other[:-1]))) if len(one) else np.zeros(0, np.int64)
        return one[first], other[first], np.add.reduceat(value, first) if len(first) else value


_SUMS = "lang string, place int, other int, part long"


def _trees(limit: int):
    """Corrections of pairs from rows (lang, terms, row, m) that come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, path = None, Path()

        def emit() -> pa.RecordBatch:
            one, other, value = path.sums()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(one, pa.int32()), pa.array(other, pa.int32()), pa.array(value, pa.int64())], names=["lang", "place", "other", "part"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                langs, sizes, rows, counts = batch.slice(i, 1000).columns
                items = list(zip(*(x.to_pylist() for x in rows.flatten().flatten()), strict=True))
                ends = np.cumsum(rows.value_lengths().to_numpy()).tolist()
                for at, v, a, b, m in zip(langs.to_pylist(), sizes.to_pylist(), [0, *ends[:-1]], ends, counts.to_pylist(), strict=True):
                    if at != lang:
                        path.close()
                        yield emit()
                        lang = at
                    path.insert(items[a:b], m, v)
                    if path.held > limit:
                        yield emit()
        path.close()
        yield emit()

    return run


def source_pairs(terms: DataFrame, groups: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, item (another source of the lang) and value, the divergence of the source from it over all kept terms."""
    said = terms.select("lang", "term", F.explode("row").alias("x")).select("lang", "term", "x.source", "x.n").join(groups, ["lang", "source"])
    rows = said.groupBy("lang", "terms", "term").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "size", "n"))).alias("row"))
    rows = saved(rows.groupBy("lang", "terms", "row").agg(F.count("*").alias("m")), "divergence-rows")
    sorted_rows = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row").select("lang", "terms", "row", "m")
    exact = lambda x: F.sum(F.col(x).cast("decimal(38,0)"))
    both = sorted_rows.mapInArrow(_trees(held), _SUMS).groupBy("lang", "place", "other").agg(exact("part").alias("part"))
    one = groups.select("lang", "source", "place", "size", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("size").alias("other_size"))
    # a count in one source and none in the other
    counts = rows.select("lang", F.explode("row").alias("x"), "m").groupBy("lang", "x.place", "x.n").agg(F.sum("m").alias("m"))
    single = counts.join(one.select("lang", "place", "size", "terms"), ["lang", "place"]).join(other, "lang").filter("place <> other AND terms > 0")
    single = single.withColumns({"p": rate("n", "size", "terms"), "z": rate("0L", "size", "terms"), "q": rate("0L", "other_size", "terms")})
    single = single.withColumns({"from": divergence("p", "q") - divergence("z", "q"), "to": divergence("q", "p") - divergence("q", "z")})
    single = single.groupBy("lang", "place", "other").agg(*(F.sum(F.col(x).cast("decimal(38,0)") * F.col("m")).alias(x) for x in ("from", "to")))
    flipped = single.select("lang", F.col("other").alias("place"), F.col("place").alias("other"), F.col("to").alias("part"))
    parts = both.unionByName(single.select("lang", "place", "other", F.col("from").alias("part"))).unionByName(flipped)
    parts = parts.groupBy("lang", "place", "other").agg(F.sum("part").alias("part"))
    base = one.join(other, "lang").filter("place <> other").join(parts, ["lang", "place", "other"], "left")
    base = base.withColumns({"z": F.when(F.col("terms") > 0, rate("0L", "size", "greatest(terms, 1)")), "q": F.when(F.col("terms") > 0, rate("0L", "other_size", "greatest(terms, 1)"))})
    value = F.col("terms").cast("decimal(38,0)") * divergence("z", "q") + F.coalesce("part", F.lit(0))
    return base.select("lang", "source", "item", F.coalesce(value, F.lit(0)).cast("long").alias("value"))


def telling_terms(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (a term the source says more than its lang), value and rank, up to `top`."""
    said = terms.select("lang", F.col("term").alias("item"), "total", F.explode("row").alias("x")).select("lang", "item", "total", "x.source", "x.n")
    said = said.join(groups, ["lang", "source"]).withColumns({"p": rate("n", "size", "terms"), "q": rate("total", "whole", "terms")}).filter("p > q")
    return _ranked(said.select("lang", "source", "item", divergence("p", "q").alias("value"))).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, piece: int = PIECE, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language how far each other one is (`pair`), and the terms
    it says more than the language (`term`).

    Null texts have no terms, a null language or source is an empty string. Repeated rows count each time; equal values
    rank by the item's bytes. Sources without terms, and languages in which no term is kept, have pairs too; an empty table
    gives no rows, and other columns are not read. Texts are read whole.
    """
    terms, groups = term_counts(docs, text, lang, source, least_docs, piece)
    pairs = _ranked(source_pairs(terms, groups, held)).withColumn("part", F.lit("pair"))
    telling = telling_terms(terms, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(telling).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source and other source, and per source and telling term: lang, source, part, item, value, rank; see audit."""
    return audit(documents(spark, sf_dir).select("text", "lang", "source"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(max(whole), 0) AS whole, CAST(coalesce(sum(n), 0) AS HUGEINT) AS size
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + {SCALE} * (coalesce(n, 0) + 1) // (size + v) AS p, 1 + {SCALE} * (total + 1) // (whole + v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM every UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
