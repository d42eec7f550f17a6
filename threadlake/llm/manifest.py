"""A Merkle manifest of a dataset, with a witness for every record, by incremental witnesses.

Leaves are appended to a tree in order. Every subtree that still waits for its run of FAN to fill holds a partial witness: the
siblings to its left when it was appended; each sibling that comes later extends it on the right. A full run becomes one
subtree of the next level, which is appended there. A leaf's witness is that of each subtree it lies in, from itself upwards.

Appends are aligned: a group's leaves are cut into blocks of FAN ** depth by their place, and each block is one stream of
appends in one task, whatever the group's size. The blocks' roots are appends of the next round, again in blocks, until one
root stands for a group; the groups' roots are the last sequence. Then the witnesses go down the same way: a block's stream is
run again and the witness of its root, by then complete, is put after those of its leaves. So no task holds more than one block
and no witness of a leaf is ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.llm.arrow import documents, id_crc, saved
from threadlake.llm.sharding import crc_sql

FAN, DEPTH = 8, 4
RECORD = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER = "part string, at long, left array<string>, right array<string>, subroot string, root string"
_WITNESS = [(n, pa.list_(pa.string())) for n in ("left", "right")]


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Subtree:
    __slots__ = ("digest", "left", "parent", "right")

    def __init__(self, digest: str):
        self.digest, self.parent = digest, None
        self.left: list[str] = []
        self.right: list[str] = []

    def witness(self) -> tuple[list[str], list[str]]:
        """The siblings to the left and to the right, joined, for each level from here up."""
        left, right, node = [], [], self
        while node.parent is not None:
            left.append("".join(node.left))
            right.append("".join(node.right))
            node = node.parent
        return left, right


class Appender:
    """A tree that grows by appends. Open runs hold at most FAN subtrees a level."""

    def __init__(self, fan: int = FAN):
        self.fan, self.open, self.count = fan, [], []

    def append(self, node: Subtree, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.count.append(0)
        run = self.open[level]
        node.left = [x.digest for x in run]
        for x in run:
            x.right.append(node.digest)
        run.append(node)
        self.count[level] += 1
        if len(run) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = Subtree(digest_of(x.digest for x in run))
        for x in run:
            x.parent = parent
        self.append(parent, level + 1)

    def close(self, depth: int | None = None) -> Subtree:
        """Completes what is open: up to `depth` levels, or, without it, until one subtree remains."""
        level = 0
        while level < depth if depth is not None else self.count[level] > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0]


def grow(digests: Sequence[str], whole: bool, depth: int) -> tuple[list[Subtree], Subtree]:
    """The leaves of a block and its root; a block that isn't its whole group reaches `depth`."""
    tree, leaves = Appender(), [Subtree(d) for d in digests]
    for x in leaves:
        tree.append(x)
    return leaves, tree.close(None if whole else depth)


def encoded(name: str) -> Column:
    """A dash for null, else the number of bytes, a colon and the value."""
    value = F.col(name).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: Sequence[str | Column]) -> Column:
    return F.sha2(F.concat(*(encoded(f) if isinstance(f, str) else f for f in fields)), 256)


def numbered(rows: DataFrame, order: Sequence[str], block: int) -> DataFrame:
    """Each row with at, its place among those of its `part` from 0, and whole: whether the part fits one block.

    Rows are dealt by ranges of part, order and, for rows alike in these, their place in the input; only the sizes of the
    parts' pieces in each range are gathered, so that a part of any size is numbered by many tasks.
    """
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    ranges = salted.repartitionByRange("part", *order, "__salt").sortWithinPartitions("part", *order, "__salt").drop("__salt")
    placed = saved(ranges.withColumn("__seen", F.monotonically_increasing_id()), "manifest-order").withColumn("__range", F.shiftright("__seen", 33))
    pieces = placed.groupBy("part", "__range").agg(F.min("__seen").alias("__first"), F.count("*").alias("__n"))
    part = Window.partitionBy("part")
    before = F.coalesce(F.sum("__n").over(part.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("part", "__range", (before - F.col("__first")).alias("__shift"), (F.sum("__n").over(part) <= block).alias("whole"))
    return placed.join(pieces, ["part", "__range"]).withColumn("at", F.col("__seen") + F.col("__shift")).drop("__seen", "__range", "__shift")


def _block(block: int) -> Column:
    return F.floor(F.col("at") / block).alias("block")


def roots(nodes: DataFrame, depth: int) -> DataFrame:
    """The root of every block of `nodes` (part, at, whole, digest), as the nodes of the next round."""

    block = FAN**depth

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        top = grow([d.hex() for d in table["digest"].to_pylist()], table["whole"][0].as_py(), depth)[1]
        at = table["at"][0].as_py() // block
        return pa.table({"part": table["part"][:1], "at": pa.array([at], pa.int64()), "digest": pa.array([bytes.fromhex(top.digest)], pa.binary())})

    own = nodes.select("part", "at", "whole", "digest", _block(block))
    tops = own.groupBy("part", "block").applyInArrow(run, "part string, at long, digest binary")
    last = tops.groupBy(F.col("part").alias("p")).agg((F.max("at") < block).alias("whole"))
    return tops.join(last, F.col("part") == F.col("p")).drop("p")


def rounds(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes and the roots of their blocks, of the blocks of these and so on, until each part has one."""
    out = [nodes]
    while True:
        out.append(saved(roots(out[-1], depth), "manifest-roots"))
        if not out[-1].filter("at > 0").limit(1).count():
            return out


def descend(nodes: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """Each node with left and right, its siblings on each level up to the root, and subroot and root.

    `upper` has these for the root of every block, by part and number of the block.
    """
    kept = [f for f in nodes.schema.fields if f.name not in ("whole", "digest")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("digest", T.BinaryType())])
    for name, kind in (("left", T.ArrayType(T.StringType())), ("right", T.ArrayType(T.StringType())), ("subroot", T.StringType()), ("root", T.StringType())):
        schema = schema.add(name, kind)

    def run(mine: pa.Table, over: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({f.name: pa.array([], k) for f, k in zip(schema.fields, kinds, strict=True)})
        mine = mine.sort_by("at")
        leaves, _ = grow([d.hex() for d in mine["digest"].to_pylist()], mine["whole"][0].as_py(), depth)
        left, right = over["left"][0].as_py(), over["right"][0].as_py()
        found = [x.witness() for x in leaves]
        columns = {n: mine[n] for n in [*names, "digest"]}
        columns |= {n: pa.array([w[k] + more for w in found], kind) for k, ((n, kind), more) in enumerate(zip(_WITNESS, (left, right), strict=True))}
        return pa.table(columns | {n: pa.array([over[n][0].as_py()] * len(found), pa.string()) for n in ("subroot", "root")})

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(schema)]
    mine = nodes.withColumn("block", _block(FAN**depth))
    over = upper.select("part", F.col("at").alias("block"), "left", "right", "subroot", "root")
    return mine.groupBy("part", "block").cogroup(over.groupBy("part", "block")).applyInArrow(run, schema)


def _down(levels: list[DataFrame], top: DataFrame, depth: int) -> DataFrame:
    """The upper witnesses of the first round's blocks, from those of each part's root."""
    for nodes in reversed(levels[1:-1]):
        top = saved(descend(nodes, top, depth).drop("digest"), "manifest-upper")
    return top


def witnesses(docs: DataFrame, fields: Sequence[str] = RECORD, part: str = "lang", doc_id: str = "doc_id", extra: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """A row for each of `docs`: its id, leaf, at (its place in its part), left, right, subroot, root and the `extra` columns.

    left and right hold the joined digests of the siblings on each level, from the leaf to the root. A leaf is the hash of
    `fields`, nulls included. Leaves ascend by id in each part, a null id first, rows of one id by their leaf; repeated rows
    are leaves of their own. Parts ascend as UTF-8 bytes, the null part first. An empty table has no leaves and no root.
    Columns other than the fields and `extra` are not carried; texts are hashed whole, in the scan.
    """
    extra = extra or {}
    key = F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit(""))
    own = docs.select(F.col(doc_id).alias("id"), key.alias("part"), F.unhex(leaf(fields)).alias("digest"), *(x.alias(n) for n, x in extra.items()))
    own = saved(own, "manifest-leaves")
    block = FAN**depth
    levels = rounds(saved(numbered(own, ["id", "digest"], block), "manifest-numbered"), depth)
    names = saved(numbered(levels[-1].select(F.lit("").alias("part"), F.col("part").alias("of"), "digest"), ["of"], block), "manifest-parts")
    parts = rounds(names, depth)
    root = parts[-1].first()
    top = docs.sparkSession.createDataFrame([("", 0, [], [], None, root["digest"].hex() if root else None)], _UPPER)
    over = descend(names, _down(parts, top, depth), depth)
    over = over.select(F.col("of").alias("part"), F.lit(0).cast("long").alias("at"), "left", "right", F.lower(F.hex("digest")).alias("subroot"), "root")
    found = descend(levels[0], _down(levels, saved(over, "manifest-upper"), depth), depth)
    return found.select(F.col("id").alias(doc_id), F.lower(F.hex("digest")).alias("leaf"), "at", "left", "right", "subroot", "root", *extra)


def proof_of(left: Column, right: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def folded(digest: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    sides = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(sides, digest, lambda h, s: F.sha2(F.concat(s["a"], h, s["b"]), 256))


def audited(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 3 divides the checksum of the id, the text is tampered with (A-Z lower-cased) and the root folded from the leaf of that.
    A null id is not tampered with.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.col("text").isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length("text").cast("string"), F.lit(":"), F.translate("text", upper, upper.lower()))
    )
    again = F.when(id_crc() % 3 == 0, F.unhex(leaf([*RECORD[:-1], changed])))
    found = witnesses(docs, extra={"again": again}, depth=depth)
    fold = folded(F.coalesce(F.lower(F.hex("again")), F.col("leaf")), F.col("left"), F.col("right"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("left"), F.col("right")).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, as audited says: nulls are hashed as dashes, repeated rows are leaves of their own."""
    return audited(documents(spark, sf_dir))


def _enc(x: str, bytes_of: str | None = None) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({bytes_of or x}) || ':' || {x} END"


def sql(levels: int = 8) -> str:
    """The same in DuckDB SQL, for parts of up to FAN ** levels rows."""
    plain = [f"CAST({c} AS VARCHAR)" for c in RECORD]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    first = " || ".join(_enc(x) for x in plain)
    other = " || ".join(_enc(x) for x in [*plain[:-1], low])
    steps = [
        f"""d AS (SELECT doc_id, lang, sha256({first}) AS leaf,
      CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({other}) END AS again FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
l0 AS (SELECT coalesce('+' || lang, '') AS part, pos, leaf AS h FROM t)"""
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            steps.append(
                f"""{name}{k + 1} AS (SELECT part, pos // {FAN} AS pos, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
      FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {name}{k}) GROUP BY part, pos // {FAN}),
{name}w{k} AS (SELECT a.part, a.pos, n = 1 AS only, array_to_string(hs[1:a.pos % {FAN}], '') AS l, array_to_string(hs[a.pos % {FAN} + 2:], '') AS r
      FROM (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {name}{k}) a
      JOIN (SELECT part, pos // {FAN} AS run, list(h ORDER BY pos) AS hs FROM {name}{k} GROUP BY part, pos // {FAN}) b ON a.part = b.part AND a.pos // {FAN} = b.run)"""
            )

    climb("l")
    steps.append(f"p0 AS (SELECT '' AS part, row_number() OVER (ORDER BY part) - 1 AS pos, h, part AS of FROM l{levels})")
    climb("p")
    joins, proof, fold = [], [], "coalesce(t.again, t.leaf)"
    for name, part in (("l", "coalesce('+' || t.lang, '')"), ("p", "''")):
        for k in range(levels):
            pos = f"{'t.pos' if name == 'l' else 'p0.pos'} // {FAN**k}"
            joins.append(f"JOIN {name}w{k} ON {name}w{k}.part = {part} AND {name}w{k}.pos = {pos}")
            proof.append(f"{name}w{k}.l || {name}w{k}.r")
    body = [f"f0 AS (SELECT t.doc_id, t.leaf, p0.h AS subroot, p{levels}.h AS root, {' || '.join(proof)} AS sides, {fold} AS h0, "]
    sides = [f"{n}w{k}.l AS {n}l{k}, {n}w{k}.r AS {n}r{k}, {n}w{k}.only AS {n}o{k}" for n in "lp" for k in range(levels)]
    body.append(", ".join(sides) + f" FROM t JOIN p0 ON p0.of = coalesce('+' || t.lang, '') JOIN p{levels} ON p{levels}.part = '' " + " ".join(joins) + ")")
    steps.append("".join(body))
    turn = 0
    for n in "lp":
        for k in range(levels):
            steps.append(f"f{turn + 1} AS (SELECT *, CASE WHEN {n}o{k} THEN h{turn} ELSE sha256({n}l{k} || h{turn} || {n}r{k}) END AS h{turn + 1} FROM f{turn})")
            turn += 1
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(sides) AS proof_sha256, h{turn} AS folded_root, h{turn} = root AS verified FROM f{turn}"


SQL = sql(5)
