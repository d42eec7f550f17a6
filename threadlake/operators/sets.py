"""Joins and set operations (J01-J04, J10, U-SET2, U-SET3, U-SET5, T02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadlake import views as v
from threadlake.functions import text as t
from threadlake.queries import query

# Which copy of a message is kept when several tools recorded it; lower is better.
PRIORITY = ["claude_code", "codex", "opencode", "gemini_cli", "continue", "cline", "cursor", "aider", "goose", "grok", "pi"]


def cross_source_dedup(messages: DataFrame) -> DataFrame:
    """U-SET2: of messages equal in folder, minute and first 200 characters, those of the best source.

    Messages without a folder, time or text are never dropped. One aggregation and an equi-join, so that a key of
    many copies is split like any skewed join.
    """
    rank = F.array_position(F.array(*(F.lit(p) for p in PRIORITY)), F.col("source"))
    rank = F.when(rank == 0, len(PRIORITY) + 1).otherwise(rank)
    prefix = F.substring("text", 1, 200)
    whole = F.col("cwd").isNotNull() & F.col("ts").isNotNull() & (F.trim(F.coalesce(prefix, F.lit(""))) != "")
    keyed = messages.withColumn("_rank", rank).withColumn("_key", F.when(whole, F.sha2(F.concat_ws("|", "cwd", F.floor(F.col("ts") / 60).cast("string"), prefix), 256)))
    best = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.min("_rank").alias("_best"))
    return keyed.join(best, "_key", "left").filter("_key IS NULL OR _rank = _best").drop("_key", "_rank", "_best")


@query(
    "uset2_cross_source",
    f"""WITH m AS (SELECT doc_id, 'cwd' || doc_id % 3 AS cwd, doc_id % 7 * 60 AS ts, text, (['pi', 'codex', 'aider', 'claude_code', 'grok'])[doc_id % 5 + 1] AS source FROM documents),
k AS (SELECT *, list_position({v._sql_list(PRIORITY)}, source) AS rank, CASE WHEN trim(substr(text, 1, 200)) <> '' THEN cwd || '|' || ts // 60 || '|' || substr(text, 1, 200) END AS key FROM m)
SELECT doc_id, source FROM (SELECT *, min(rank) OVER (PARTITION BY key) AS best FROM k) WHERE key IS NULL OR rank = best""",
)
def uset2_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.table(spark, sf_dir, "documents")
    source = F.get(F.array(*(F.lit(x) for x in ("pi", "codex", "aider", "claude_code", "grok"))), (F.col("doc_id") % 5).cast("int"))
    m = d.select("doc_id", F.concat(F.lit("cwd"), (F.col("doc_id") % 3).cast("string")).alias("cwd"), (F.col("doc_id") % 7 * 60).alias("ts"), "text", source.alias("source"))
    return cross_source_dedup(m).select("doc_id", "source")


def best_of_equal(hits: DataFrame, key: list[F.Column], order: list[F.Column]) -> DataFrame:
    """U-SET3, U-SET4: of hits equal by key, the first by order; no window, so a key of any size is merged map-side."""
    return hits.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min_by(F.struct(*hits.columns), F.struct(*order)).alias("_best")).select("_best.*")


@query(
    "uset3_hit_dedup",
    v.with_views(
        f"""SELECT id, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY kind, {t.CONTENT_KEY_SQL.format("content")} ORDER BY score DESC, id) AS n FROM extractions) WHERE n = 1""",
        v.EXTRACTIONS_SQL,
    ),
)
def uset3_hit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.extractions(spark, sf_dir)
    return best_of_equal(e, [F.col("kind"), t.content_key(F.col("content"))], [-F.col("score"), F.col("id")]).select("id", "kind", "score")


@query(
    "uset5_scope_delta",
    v.with_views(
        "SELECT DISTINCT content FROM extractions a WHERE source = 'src1' AND kind IN ('decision', 'ban') AND NOT EXISTS (SELECT 1 FROM extractions b WHERE b.source = 'src0' AND b.content = a.content)",
        v.EXTRACTIONS_SQL,
    ),
)
def uset5_scope_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-SET5: what one scope has settled and another hasn't."""
    e = v.extractions(spark, sf_dir)
    to = e.filter(F.col("source").eqNullSafe("src1") & F.col("kind").isin("decision", "ban")).select("content").distinct()
    return to.join(e.filter("source = 'src0'").select("content").distinct(), "content", "left_anti")


@query(
    "j04_unembedded",
    v.with_views("SELECT id, kind FROM extractions e WHERE NOT EXISTS (SELECT 1 FROM embeddings x WHERE x.vec_id = e.id)", v.EXTRACTIONS_SQL),
)
def j04_unembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that have no vector yet."""
    return v.extractions(spark, sf_dir).select("id", "kind").join(v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query(
    "j03_vectors_of_facts",
    v.with_views("SELECT e.id, e.kind, e.score, x.label, len(x.embedding) AS dim FROM extractions e JOIN embeddings x ON x.vec_id = e.id", v.EXTRACTIONS_SQL),
)
def j03_vectors_of_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their vectors."""
    x = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.size("embedding").alias("dim"))
    return v.extractions(spark, sf_dir).select("id", "kind", "score").join(x, "id")


@query(
    "t02_browse",
    v.with_views("SELECT id, kind, ts, score FROM extractions ORDER BY ts DESC NULLS LAST, score DESC, id LIMIT 50", v.EXTRACTIONS_SQL),
)
def t02_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest facts, without a query."""
    return v.extractions(spark, sf_dir).select("id", "kind", "ts", "score").orderBy(F.desc_nulls_last("ts"), F.desc("score"), "id").limit(50)


def bounded(rows: DataFrame, budget: int, *order: F.Column) -> DataFrame:
    """Rows by rank as long as their JSON fits a byte budget; the first always stays.

    A row's JSON has two bytes at least, so more than half as many rows as bytes can't fit: only those meet in one task.
    """
    rows = rows.orderBy(*order).limit(budget // 2 + 1)
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    before = F.coalesce(F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("_sum", before).withColumn("_n", F.row_number().over(W.orderBy(*order))).filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")
