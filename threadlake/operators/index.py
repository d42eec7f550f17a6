"""A positional search index in impact order, and exact top-k search that reads only what can matter.

The forward table has a row for each document: its size, terms, counts and positions. The postings of a term are sorted by their
share of the BM25 weight (the impact) and packed in blocks of SIZE, each with its largest impact; terms of very many documents are
cut by document first, so that no task sorts more than about PART postings of one.

A search first finds a floor under each query's k-th score: the best documents by its rare terms, which together have a small part
(SHARE) of its postings, fully scored. Terms whose largest impacts together stay under a part of the floor cannot lift a document
over it; these are the frequent ones, and their postings are never read. Blocks of the other terms are read if their largest impact could still reach the floor, and documents
whose sum, with all that the unread terms could add, reaches it are scored in full from the forward table. No result is lost: a
bound is only ever used against a floor that k documents have reached.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from threadlake.functions.stem import analysed, phrases
from threadlake.session import shared_folder

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SIZE, PART = 128, 1 << 20
SHARE, SPARE = 0.2, 0.3
NEAR = 1e-5  # scores closer than this may be equal

_FORWARD = "doc_id long, size long, terms array<string>, counts array<int>, positions array<array<int>>"


@dataclass(frozen=True)
class Index:
    forward: DataFrame  # doc_id, size, terms, counts, positions; size is null for a null text
    blocks: DataFrame  # term, top, docs, impacts
    terms: DataFrame  # term, df, idf, top
    n_docs: int
    mean: float
    analyser: str
    positional: bool


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _documents(analyser: str, positional: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                piece = batch.slice(i, 200)
                texts, flat, sizes = piece.column(1).to_pylist(), [], []
                for text in texts:
                    words = analysed(text or "", analyser)
                    flat += words
                    sizes.append(len(words))
                encoded = pa.array(flat, pa.string()).dictionary_encode()
                code, n = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(sizes)
                doc = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((code, doc))
                code, doc, place = code[order], doc[order], place[order]
                first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))[: len(code)])
                ends = np.append(first, len(code))
                runs = pa.array(np.searchsorted(doc[first], np.arange(len(n) + 1)), pa.int32())
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32())) if positional else pa.nulls(len(first), pa.list_(pa.int32()))
                each = (encoded.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends), pa.int32()), positions)
                size = pa.array([None if t is None else k for t, k in zip(texts, sizes, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), size, *(pa.ListArray.from_arrays(runs, x) for x in each)], names=["doc_id", "size", "terms", "counts", "positions"])

    return run


def impact(tf: Column, size: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(mean or 1.0)))


def idf_of(n_docs: int, df: Column) -> Column:
    return F.greatest(F.lit(IDF_FLOOR), F.log((F.lit(n_docs) - df + 0.5) / (df + 0.5)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to SIZE postings of one (term, cut), from rows (term, cut, doc_id, impact) in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts, weights = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (cuts[1:] != cuts[:-1])))
        place = np.arange(len(codes)) - np.repeat(fresh, np.diff(np.append(fresh, len(codes))))
        first = np.flatnonzero(place % SIZE == 0)
        offsets = pa.array(np.append(first, len(codes)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(weights[first]), *lists], names=["term", "top", "docs", "impacts"])


def _blocks(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_id, impact) in blocks: term, top, docs, impacts."""
    hot = terms.filter(F.col("df") > PART).select("term", F.ceil(F.col("df") / PART).alias("cuts"))
    dealt = postings.join(hot, "term", "left").withColumn("cut", F.pmod(F.xxhash64("doc_id"), F.coalesce("cuts", F.lit(1))))
    ordered = dealt.repartition("term", "cut").sortWithinPartitions("term", "cut", F.desc("impact")).select("term", "cut", "doc_id", "impact")
    return ordered.mapInArrow(_pack, "term string, top double, docs array<long>, impacts array<double>")


def _terms(postings: DataFrame, n_docs: int) -> DataFrame:
    found = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    return found.withColumn("idf", idf_of(n_docs, F.col("df")))


def build(docs: DataFrame, doc_id: str, text: str, analyser: str = "plain", path: str | None = None, positional: bool = True) -> Index:
    """The index of a table, written under `path` or else under the shared folder.

    Every row is a document and counts for the statistics; a null text has no terms. Ids are whole numbers, and must not repeat.
    Without positions, which take most of the forward table, phrases can't be searched.
    """
    folder = path or f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    forward = stored(own.mapInArrow(_documents(analyser, positional), _FORWARD), folder, "forward")
    n_docs, mean = forward.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    pairs = forward.select("doc_id", "size", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    postings = pairs.select(F.col("x.terms").alias("term"), "doc_id", impact(F.col("x.counts"), F.col("size"), mean).alias("impact"))
    terms = stored(_terms(postings, n_docs), folder, "terms")
    blocks = stored(_blocks(postings, terms), folder, "blocks")
    return Index(forward, blocks, terms, n_docs, mean, analyser, positional)


def query_terms(queries: DataFrame, analyser: str, phrased: bool) -> DataFrame:
    """(query_id, term): the distinct terms of each query; with `phrased`, tokens that the query writes together are one term."""
    split = phrases if phrased else analysed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                piece = batch.slice(i, 200)
                found = [list(dict.fromkeys(split(x or "", analyser))) for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.string()))], names=["query_id", "terms"])

    own = queries.select("query_id", "query").mapInArrow(run, T.StructType([queries.schema["query_id"], T.StructField("terms", T.ArrayType(T.StringType()))]))
    return own.select("query_id", F.explode("terms").alias("term"))


def with_phrases(index: Index, wanted: DataFrame, folder: str) -> Index:
    """The index with the phrases among `wanted` as terms of their own.

    A phrase is looked for in the documents of its rarest token; it stands where the tokens' positions, each moved back by its
    place in the phrase, meet.
    """
    asked = wanted.filter(F.col("term").contains(" ")).select("term").distinct().select("term", F.split("term", " ").alias("tokens"))
    each = asked.select("term", "tokens", F.explode("tokens").alias("token"))
    rare = each.join(index.terms.select(F.col("term").alias("token"), "df"), "token", "left").groupBy("term", "tokens")
    rare = rare.agg(F.min_by("token", F.coalesce("df", F.lit(0))).alias("token"))
    docs = rare.join(index.blocks.select(F.col("term").alias("token"), F.explode("docs").alias("doc_id")), "token")
    held = docs.join(index.forward, "doc_id")
    places = lambda w: F.get("positions", F.array_position("terms", w).cast("int") - 1)
    moved = F.transform("tokens", lambda w, j: F.transform(F.coalesce(places(w), F.array().cast("array<int>")), lambda x: x - j))
    starts = F.aggregate(F.slice("moved", 2, F.size("moved") - 1), F.get("moved", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    found = held.withColumn("moved", moved).select("term", "doc_id", "size", F.size(starts).alias("tf")).filter("tf > 0")
    found = stored(found, folder, "phrases")
    postings = found.select("term", "doc_id", impact(F.col("tf"), F.col("size"), index.mean).alias("impact"))
    terms = stored(_terms(postings, index.n_docs), folder, "phrase-terms")
    more = found.groupBy("doc_id").agg(F.collect_list("term").alias("t"), F.collect_list("tf").alias("c"))
    forward = index.forward.join(more, "doc_id", "left").withColumns(
        {"terms": F.concat("terms", F.coalesce("t", F.array().cast("array<string>"))), "counts": F.concat("counts", F.coalesce("c", F.array().cast("array<int>")))}
    )
    return replace(index, forward=forward.drop("t", "c"), terms=index.terms.unionByName(terms), blocks=index.blocks.unionByName(_blocks(postings, terms)))


def _scored(index: Index, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of given pairs over `wanted` (query_id, term, idf), from the forward table."""
    own = pairs.join(index.forward.select("doc_id", "size", F.arrays_zip("terms", "counts").alias("x")), "doc_id").select("query_id", "doc_id", "size", F.explode("x").alias("x"))
    hits = own.select("query_id", "doc_id", "size", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf")).join(wanted, ["query_id", "term"])
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * impact(F.col("tf"), F.col("size"), index.mean)).alias("score"))


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def search(index: Index, queries: DataFrame, k: int, phrased: bool = False, spare: float = SPARE) -> DataFrame:
    """(query_id, doc_id, rank): for each query (query_id, query) its k best documents by BM25, and any that come close to the k-th.

    rank is the negated sum over the query's distinct terms; more negative is better. A query without a known term finds nothing,
    and one with fewer than k documents finds all of them.
    """
    folder = f"{shared_folder(queries.sparkSession)}/search-{uuid.uuid4().hex}"
    asked = query_terms(queries, index.analyser, phrased)
    if phrased and not index.positional:
        raise ValueError("an index without positions can't find phrases")
    if phrased:
        asked = stored(asked, folder, "asked")
        index = with_phrases(index, asked, folder)
    wanted = stored(asked.join(index.terms, "term").select("query_id", "term", "df", "idf", (F.col("idf") * F.col("top")).alias("most")), folder, "wanted")
    floor = stored(_floors(index, wanted, k), folder, "floors")
    bounds = stored(_essential(wanted, floor, spare), folder, "bounds")
    needed = bounds.filter("needed").select("query_id", "term", "idf", "floor", "rest", "others")
    read = needed.join(index.blocks, "term").filter(F.col("idf") * F.col("top") + F.col("others") >= F.col("floor"))
    hits = read.select("query_id", "idf", "floor", "rest", F.explode(F.arrays_zip("docs", "impacts")).alias("x"))
    sums = hits.groupBy("query_id", F.col("x.docs").alias("doc_id")).agg(
        F.sum(F.col("idf") * F.col("x.impacts")).alias("part"), F.first("floor").alias("floor"), F.first("rest").alias("rest")
    )
    # where blocks were left unread the sum is not whole, so that all that is kept is scored anew
    kept = sums.filter(F.col("part") + F.col("rest") >= F.col("floor")).select("query_id", "doc_id")
    return _scored(index, kept, wanted.select("query_id", "term", "idf")).select("query_id", "doc_id", (-F.col("score")).alias("rank"))


def _floors(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the k-th best full score among the best documents by the query's rare terms; 0 if these are fewer."""
    query = W.partitionBy("query_id")
    rarest = query.orderBy("df", "term")
    seeds = wanted.withColumns({"_n": F.row_number().over(rarest), "_read": F.sum("df").over(rarest.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("df").over(query)})
    seeds = seeds.filter((F.col("_n") == 1) | (F.col("_read") <= SHARE * F.col("_all"))).select("query_id", "term", "idf")
    hits = seeds.join(index.blocks, "term").select("query_id", "idf", F.explode(F.arrays_zip("docs", "impacts")).alias("x"))
    sums = hits.groupBy("query_id", F.col("x.docs").alias("doc_id")).agg(F.sum(F.col("idf") * F.col("x.impacts")).alias("part"))
    likely = _first(sums, 2 * k, F.desc("part"), F.col("doc_id")).select("query_id", "doc_id")
    scored = _scored(index, likely, wanted.select("query_id", "term", "idf"))
    return _first(scored, k, F.desc("score")).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))


def _essential(wanted: DataFrame, floors: DataFrame, spare: float) -> DataFrame:
    """Each query's terms with floor, rest (what all terms that need not be read can add), others (what all terms but this one can) and needed."""
    own = wanted.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - NEAR)
    query = W.partitionBy("query_id")
    least = F.sum("most").over(query.orderBy("most", "term").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("needed", least > F.lit(spare) * F.col("floor"))
    unread = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))).over(query), F.lit(0.0))
    return own.withColumns({"rest": unread, "others": F.sum("most").over(query) - F.col("most")})
