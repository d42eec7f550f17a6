"""Rendezvous sharding over weighted shards, in DataFrame functions only.

Every shard draws a number from (key, shard) and the key goes to the shard of the highest score: -weight / ln(draw). A new
shard only adds a candidate, so that it takes rows into itself and moves no row between the others; of equal weights, n shards
growing to n + 1 move one row in n + 1. No row needs another to find its shard, and nothing is shuffled for it.

Slots number the rows of a shard without a gap. They follow a hash of the row: its leading bits cut each shard into cells of
about CELL rows, which are ranked apart and joined to the number of rows in the cells before them. Equal rows are counted
before they are ranked, so that neither a hot key nor a group of copies fills a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.llm.arrow import documents, saved

SHARDS = 24
CELL = 50_000
RUN = 10_000
BITS = 52


def draw(*parts: Column) -> Column:
    """A number of BITS bits from a hash of the parts; a null part is a dash."""
    text = F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("-")) for x in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def score(key: Column, shard: Column, weight: Column) -> Column:
    """The highest of all shards' scores wins the key; a shard wins in proportion to its weight."""
    return -weight / F.ln((draw(shard, key) + F.lit(0.5)) / F.lit(float(1 << BITS)))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard's (score, -shard); of equal scores the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    shares = F.array(*(F.lit(float(w)) for w in weights))
    return F.array_max(F.transform(shares, lambda w, k: F.struct(score(key, k, w).alias("score"), (-k).alias("shard"))))


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", new_weight: float = 1.0) -> DataFrame:
    """Each row of `docs` with shard, and grown_shard: its shard once there is one more, of `new_weight`.

    Only the key and the weights decide: rows that repeat a key, whatever their texts, lie in one shard, and a null key is
    one key. Columns named shard or grown_shard are replaced; nothing is shuffled, an empty table stays empty.
    """
    n, own = len(weights), [c for c in docs.columns if c not in ("shard", "grown_shard")]
    base = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns})
    name = F.col(f"__own_{key}")
    found = base.withColumn("__best", _best(name, weights))
    shard = -F.col("__best.shard")
    grown = F.when(score(name, F.lit(n), F.lit(float(new_weight))) > F.col("__best.score"), F.lit(n)).otherwise(shard)
    return found.select(*(F.col(f"__own_{c}").alias(c) for c in own), shard.cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))


def number_slots(rows: DataFrame, shard: str = "shard", cell: int = CELL, run: int = RUN) -> DataFrame:
    """Each row of `rows` with slot: 0, 1, 2 ... in each shard, in the order of a hash of the row's columns, then of these.

    Rows alike in all columns take slots next to each other. A group of them is one row with a count until its slots are
    known, then a row for each `run` copies, dealt to other tasks before the copies are written out.
    """
    own = [c for c in rows.columns if c != "slot"]
    rest = [c for c in own if c != shard]
    groups = saved(rows.select(*own).groupBy(*own).agg(F.count("*").alias("__n")).withColumn("__at", draw(*(F.col(c) for c in rest))), "slots")
    shards = max(1, groups.select(shard).distinct().count())
    bits = max(0, (groups.count() // (shards * cell)).bit_length())
    groups = groups.withColumn("__cell", F.shiftright(F.col("__at"), BITS - bits))
    earlier = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = groups.groupBy(shard, "__cell").agg(F.sum("__n").alias("__held"))
    cells = cells.select(F.col(shard).alias("__shard"), F.col("__cell").alias("__of"), F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(shard, "__cell").orderBy("__at", *rest).rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("__inside", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    placed = ranked.join(cells, (F.col(shard).eqNullSafe(F.col("__shard"))) & (F.col("__cell") == F.col("__of")))
    first = F.col("__before") + F.col("__inside")
    runs = placed.select(*own, first.alias("__first"), "__n", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / run))).alias("__run"))
    runs = runs.select(*own, (F.col("__first") + F.col("__run") * run).cast("long").alias("__start"), F.least(F.lit(run), F.col("__n") - F.col("__run") * run).alias("__n"))
    dealt = runs.repartition(shard, "__start")
    return dealt.select(*own, F.explode(F.sequence("__start", F.col("__start") + F.col("__n") - 1)).alias("slot"))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", new_weight: float = 1.0) -> None:
    """Whole rows as Parquet under path/shard=K. Shards are brought together for few files; large ones are split by their size."""
    sharded = assign_shards(docs, weights, key, new_weight).drop("grown_shard")
    sharded.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the number of shards decide, so equal texts of different ids may lie apart. A null id is one
    key; a null text has no bytes and the checksum of none. Repeated rows have a slot each.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slots = number_slots(assign_shards(docs))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def crc_table() -> list[int]:
    """The 256 remainders of the CRC-32 polynomial, from its rule."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def crc_sql(text: str) -> str:
    """CRC-32 of a string's bytes in DuckDB SQL."""
    table = f"({crc_table()}::BIGINT[])"
    read = f"list_transform(range(1, CAST(length(hex({text})) AS BIGINT), 2), lambda i: ('0x' || substr(hex({text}), CAST(i AS BIGINT), 2))::BIGINT)"
    return f"xor(list_reduce({read}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_DRAW = "('0x' || substr(md5({0}), 1, 13))::BIGINT"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '-') AS k FROM documents),
r AS (SELECT doc_id, k, CAST(strlen(t) + 8 AS BIGINT) AS size, CASE WHEN t = '' THEN 0 ELSE {crc_sql("t")} END AS text_crc32 FROM d),
s AS (SELECT k, i, -1 / ln(({_DRAW.format("i || ':' || k")} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS score
      FROM (SELECT DISTINCT k FROM d), (SELECT unnest(range(0, 25)) AS i)),
a AS (SELECT k, arg_max(i, score) FILTER (i < 24) AS shard, arg_max(i, score) AS grown_shard FROM s GROUP BY k)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY {_DRAW.format("k || ':' || size || ':' || text_crc32 || ':' || grown_shard")},
                          doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM r JOIN a USING (k)
"""
