"""Corpus-level profiles (U02-U06, A20-A25): per-session aggregates that are aggregated again."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadlake import views as v
from threadlake.functions import scoring
from threadlake.functions import text as t
from threadlake.operators.ancestors import above_sql, last_written, recursive, with_above
from threadlake.queries import query


REACTED_VIEWS = (v.THREADS_SQL, above_sql("prior", "role = 'user' AND NOT is_sidechain", "assistant", table="threads"))
REACTED_SQL = f"""SELECT {t.REACTION_SQL.format("u.text")} AS reaction, {t.BEHAVIOUR_SQL.format("a.text")} AS behaviour, u.session_id, u.ts
  FROM threads u JOIN prior p ON p.message_uuid = u.message_uuid JOIN threads a ON a.message_uuid = p.ancestor WHERE reaction IS NOT NULL AND behaviour IS NOT NULL"""


def reacted(messages: DataFrame) -> DataFrame:
    """users' reactions with what the nearest message of the assistant above them looked like; side-chains don't react."""
    nodes = last_written(messages.filter("message_uuid IS NOT NULL"))
    own = nodes.filter("role = 'user' AND NOT coalesce(is_sidechain, false)").withColumn("reaction", t.reaction(F.col("text"))).filter("reaction IS NOT NULL")
    found = with_above(own, nodes, F.col("role") == "assistant", "prior").withColumn("behaviour", t.behaviour(F.col("prior_text")))
    return found.filter("prior_uuid IS NOT NULL AND behaviour IS NOT NULL")


@query("a20_satisfaction", recursive(f"SELECT reaction, behaviour, count(*) AS n FROM ({REACTED_SQL}) GROUP BY 1, 2", *REACTED_VIEWS))
def a20_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactions by the assistant's behaviour before them."""
    return reacted(v.threads(spark, sf_dir)).groupBy("reaction", "behaviour").agg(F.count("*").alias("n"))


@query(
    "u06_best_and_worst",
    recursive(
        f"""SELECT mood, behaviour, n FROM (SELECT CASE WHEN starts_with(reaction, 'praise') THEN 'praise' ELSE 'frustration' END AS mood, behaviour, count(*) AS n FROM ({REACTED_SQL})
WHERE starts_with(reaction, 'praise') OR starts_with(reaction, 'frustration') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY mood ORDER BY n DESC, behaviour) = 1""",
        *REACTED_VIEWS,
    ),
)
def u06_best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The behaviour that praise follows most, and the one that frustration does."""
    mood = F.when(F.col("reaction").startswith("praise"), "praise").when(F.col("reaction").startswith("frustration"), "frustration")
    n = reacted(v.threads(spark, sf_dir)).groupBy(mood.alias("mood"), "behaviour").agg(F.count("*").alias("n")).filter("mood IS NOT NULL")
    return n.groupBy("mood").agg(F.min_by(F.struct("behaviour", "n"), F.struct(-F.col("n"), F.col("behaviour"))).alias("b")).select("mood", "b.*")


@query(
    "a21_voice",
    v.with_views(
        """SELECT count(*) AS turns, round(avg(length(text)), 6) AS mean_chars, quantile_disc(length(text), 0.1) AS p10_chars, quantile_disc(length(text), 0.5) AS p50_chars, quantile_disc(length(text), 0.9) AS p90_chars,
  round(avg(CASE WHEN regexp_matches(text, '^[a-z]') THEN 1.0 ELSE 0.0 END), 6) AS lower_start, round(avg(CASE WHEN rtrim(text) LIKE '%?' THEN 1.0 ELSE 0.0 END), 6) AS questions,
  CAST(sum(len(regexp_extract_all(lower(text), '(^|[^a-z])we([^a-z]|$)'))) AS BIGINT) AS we, CAST(sum(len(regexp_extract_all(lower(text), '(^|[^a-z])i([^a-z]|$)'))) AS BIGINT) AS i
FROM (SELECT trim(text) AS text FROM messages WHERE role = 'user') WHERE text <> '' AND NOT starts_with(text, '<') AND length(text) < 400""",
        v.MESSAGES_SQL,
    ),
)
def a21_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the user writes, over natural turns; one pass, one row."""
    own = v.messages(spark, sf_dir).filter("role = 'user'").select(F.trim("text").alias("text"))
    own = own.filter((F.col("text") != "") & ~F.col("text").startswith("<") & (F.length("text") < 400)).withColumn("n", F.length("text"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    quantile = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)").cast("long")
    word = lambda w: F.sum(F.regexp_count(F.lower("text"), F.lit(f"(^|[^a-z]){w}([^a-z]|$)"))).cast("long").alias(w)
    return own.agg(
        F.count("*").alias("turns"),
        F.round(F.avg("n"), 6).alias("mean_chars"),
        quantile(0.1).alias("p10_chars"),
        quantile(0.5).alias("p50_chars"),
        quantile(0.9).alias("p90_chars"),
        share(F.col("text").rlike("^[a-z]")).alias("lower_start"),
        share(F.rtrim("text").endswith("?")).alias("questions"),
        word("we"),
        word("i"),
    )


@query(
    "u02_first_words",
    v.with_views(
        """SELECT word, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_split_to_array(trim(text), '\\s+')[1]), '[^a-z0-9'']', '', 'g') AS word FROM messages WHERE role = 'user') WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 15""",
        v.MESSAGES_SQL,
    ),
)
def u02_first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words messages most often begin with."""
    own = v.messages(spark, sf_dir).filter("role = 'user'").select(t.first_word(F.col("text")).alias("word")).filter("word <> ''")
    return own.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


OPS_BURST, MARATHON = 10, 200


def session_shapes(messages: DataFrame, by: str) -> DataFrame:
    """For each value of `by` its sessions, their median of user messages and the shape they make.

    Sessions are counted by size before they are put together, so a project of any number of sessions is a few rows.
    """
    sizes = messages.filter("role = 'user'").groupBy(by, "session_id").agg(F.count("*").alias("n")).groupBy(by, "n").agg(F.count("*").alias("k"))
    share = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0)) / F.sum("k")
    order = W.partitionBy(by).orderBy("n")
    placed = sizes.withColumn("upto", F.sum("k").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(W.partitionBy(by)))
    first, second = (F.min(F.when(F.col("upto") >= at, F.col("n"))) for at in (F.ceil(F.col("all") / 2), F.floor(F.col("all") / 2) + 1))
    p = placed.groupBy(by).agg(
        F.sum("k").cast("long").alias("sessions"),
        ((first + second) / 2).alias("median_messages"),
        share(F.col("n") <= OPS_BURST).alias("ops"),
        share(F.col("n") >= MARATHON).alias("marathon"),
        share((F.col("n") > OPS_BURST) & (F.col("n") < MARATHON)).alias("middle"),
    )
    return p.select(by, "sessions", "median_messages", scoring.work_shape(F.col("ops"), F.col("marathon"), F.col("middle")).alias("shape"))


@query(
    "a22_workflow",
    v.with_views(
        f"""SELECT project_key, count(*) AS sessions, median(n) AS median_messages, CASE WHEN avg(CAST(n <= {OPS_BURST} AS INT)) >= 0.5 THEN 'ops_burst' WHEN avg(CAST(n >= {MARATHON} AS INT)) >= 0.5 THEN 'marathon'
  WHEN avg(CAST(n <= {OPS_BURST} AS INT)) >= 0.2 AND avg(CAST(n >= {MARATHON} AS INT)) >= 0.2 THEN 'bimodal' WHEN avg(CAST(n BETWEEN {OPS_BURST + 1} AND {MARATHON - 1} AS INT)) >= 0.5 THEN 'focused' ELSE 'mixed' END AS shape
FROM (SELECT project_key, session_id, count(*) AS n FROM messages WHERE role = 'user' GROUP BY 1, 2) GROUP BY 1""",
        v.MESSAGES_SQL,
    ),
)
def a22_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of each project's sessions."""
    return session_shapes(v.messages(spark, sf_dir), "project_key")


@query(
    "d06_peak_hours",
    "SELECT hour(ts) AS hour, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1",
)
def d06_peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by hour of the day (UTC)."""
    e = v.table(spark, sf_dir, "events")
    by = e.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(e.agg(F.count("*").alias("all")))).select("hour", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(
    "a23_ngrams",
    """WITH w AS (SELECT conv_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, t[i] || ' ' || t[i + 1] AS gram FROM (SELECT conv_id, t, unnest(range(1, len(t))) AS i FROM w)),
s AS (SELECT conv_id, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT gram, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1 ORDER BY sessions DESC, n DESC, gram LIMIT 20""",
)
def a23_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words that sessions repeat, by how many sessions do."""
    c = v.table(spark, sf_dir, "conversations").filter("role = 'user'")
    g = c.select("conv_id", F.explode(t.ngrams(t.words(F.col("text"), "[a-z']+"), 2)).alias("gram"))
    s = g.groupBy("conv_id", "gram").agg(F.count("*").alias("n")).filter("n >= 2")
    return s.groupBy("gram").agg(F.count("*").alias("sessions"), F.sum("n").cast("long").alias("n")).orderBy(F.desc("sessions"), F.desc("n"), "gram").limit(20)


@query(
    "a24_vocabulary",
    """SELECT term, count(DISTINCT conv_id) AS sessions, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations)
WHERE length(term) >= 5 GROUP BY 1 HAVING count(DISTINCT conv_id) >= 2 AND count(*) >= 4""",
)
def a24_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at least two sessions and four uses; counted by session first, so nothing distinct is shuffled twice."""
    c = v.table(spark, sf_dir, "conversations")
    by = c.select("conv_id", F.explode(t.words(F.col("text"), "[a-z0-9]+")).alias("term")).filter(F.length("term") >= 5).groupBy("term", "conv_id").agg(F.count("*").alias("k"))
    return by.groupBy("term").agg(F.count("*").alias("sessions"), F.sum("k").cast("long").alias("n")).filter("sessions >= 2 AND n >= 4")


NAMES_BYTES = 8 << 20
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def name_counts(texts: DataFrame, names: DataFrame, block_bytes: int = NAMES_BYTES) -> DataFrame:
    """(project, name, n): how often each project of `texts` (project, text) says each of `names` (name), as whole words in any case.

    All names of a block are one automaton, so that a text is read once however many there are. Names go to the tasks in
    blocks of at most about `block_bytes`; tasks add up their own counts before anything is shuffled. Word characters are a-z, 0-9 and
    the underscore; matches of one name do not overlap. Null or empty texts and names match nothing.
    """
    own = names.select(F.lower("name").alias("key")).filter("key <> ''").distinct()
    size = own.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    schema, out = "project string, key string, n long", None
    for k in range(blocks):
        block = own.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)
        keys = [r["key"] for r in block.collect()]
        if not keys:
            continue
        shared = texts.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for name in shared.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            counts: Counter[tuple[str | None, str]] = Counter()
            for batch in batches:
                for project, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for name in names_in((text or "").lower(), automaton):
                        counts[project, name] += 1
                if len(counts) > 1 << 17:
                    yield _counted(counts)
                    counts.clear()
            yield _counted(counts)

        found = texts.select("project", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.sparkSession.createDataFrame([], schema)
    return out.groupBy("project", F.col("key").alias("name")).agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    columns = ([p for p, _ in counts], [k for _, k in counts], list(counts.values()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["project", "key", "n"])


def names_in(text: str, automaton) -> Iterator[str]:
    """The names at whose ends in lower-cased `text` a word begins or ends, one for each match."""
    ends: dict[str, int] = {}
    word = lambda i: 0 <= i < len(text) and text[i] in _WORD
    for last, name in automaton.iter(text):
        start = last + 1 - len(name)
        if start >= ends.get(name, 0) and word(start - 1) != word(start) and word(last) != word(last + 1):
            ends[name] = last + 1
            yield name


def mentions(texts: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """For each project of `texts` (project, text) the others of `names` (project, name) that it mentions most.

    Of a project's names the one with the most matches counts. A project's own names, and names that two projects
    share, count for the others that have them.
    """
    own = names.select(F.col("project").alias("b"), F.lower("name").alias("name")).distinct()
    counts = name_counts(texts, names).withColumnRenamed("project", "a").join(own, "name").filter("a <> b")
    n = counts.groupBy("a", "b").agg(F.max("n").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "b"))).filter(F.col("rank") <= most)


NAMED_SQL = """names AS (SELECT 'src' || n_nationkey % 20 AS project, n_name AS name FROM nation UNION ALL SELECT 'src' || s_suppkey % 20, s_name FROM supplier),
named AS (SELECT source AS project, coalesce(text, '') || ' See NATION_' || doc_id * 7 % 25 || ', (Supplier#' || lpad(CAST(doc_id * 13 % 10 AS VARCHAR), 9, '0') || ') nation_' || doc_id * doc_id % 25 || '.' AS text FROM documents)"""


@query(
    "a25_co_mentions",
    f"""WITH {NAMED_SQL}, c AS (SELECT d.project AS a, n.project AS b, name, sum(len(regexp_extract_all(lower(text), '\\b' || lower(name) || '\\b'))) AS n FROM named d, names n WHERE d.project <> n.project GROUP BY 1, 2, 3)
SELECT a, b, CAST(n AS BIGINT) AS n, rank FROM (SELECT a, b, max(n) AS n, row_number() OVER (PARTITION BY a ORDER BY max(n) DESC, b) AS rank FROM c WHERE n > 0 GROUP BY 1, 2) WHERE rank <= 5""",
)
def a25_co_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the five others whose names (of nations and suppliers, dealt by their keys) it says most.

    The given texts hold no names, so a sentence with three, chosen by the document's key, stands after each text.
    """
    nation, supplier = v.table(spark, sf_dir, "nation"), v.table(spark, sf_dir, "supplier")
    of = lambda key: F.concat(F.lit("src"), (F.col(key) % 20).cast("string"))
    names = nation.select(of("n_nationkey").alias("project"), F.col("n_name").alias("name")).unionByName(supplier.select(of("s_suppkey").alias("project"), F.col("s_name").alias("name")))
    k = F.col("doc_id")
    said = F.format_string(" See NATION_%d, (Supplier#%09d) nation_%d.", k * 7 % 25, k * 13 % 10, k * k % 25)
    return mentions(v.table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.concat(F.coalesce("text", F.lit("")), said).alias("text")), names)
