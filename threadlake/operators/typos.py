"""The slips of a writer, found by the words one edit away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake import views as v
from threadlake.queries import query
from threadlake.session import written

# Misspellings that are reported wherever they occur, and the limits of the tests.
SEEDS = ["teh", "seperate", "recieve", "definately", "occured", "untill"]
SHORTEST_WORD, SHORTEST_SLIP, LONGEST_SLIP = 3, 4, 20
LEAST, RARE, DOMINANCE, TOP = 2, 5, 200, 30

IN_DOCUMENTS = 20  # the queries' dictionary: words of at least so many documents
USABLE = 100  # a dictionary of fewer words tells nothing


def word_counts(texts: DataFrame, text: str, doc_id: str | None = None) -> DataFrame:
    """(word, n) for runs of letters a-z in lower-cased texts, with the number of documents where an id is given."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{SHORTEST_WORD},}})"), 1)
    words = texts.select(*([doc_id] if doc_id else []), F.explode(found).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), *([F.count_distinct(doc_id).alias("docs")] if doc_id else []))


def _keys(word: Column) -> Column:
    """A word and what is left of it without one letter: two words one edit apart share one of these."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def one_edit(a: Column, b: Column) -> Column:
    """Whether a letter more, less or other, or two neighbours swapped, make `a` of `b`."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.length(b) - 1),
        lambda i: F.concat(F.substring(b, F.lit(1), i - 1), F.substring(b, i + 1, F.lit(1)), F.substring(b, i, F.lit(1)), F.substring(b, i + 2, F.length(b))) == a,
    )
    return (a != b) & ((F.levenshtein(a, b, 1) == 1) | ((F.length(a) == F.length(b)) & (F.length(b) > 1) & swapped))


def neighbours(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, meant): the dictionary's words one edit away from each word, a pair possibly more than once.

    Words meet under what they have in common without one letter. As words are distinct and of letters a-z, a key of
    k letters has at most 26 (k + 1) + 1 words on either side: no key is hot, whatever the size of the corpus.
    """
    a = words.select("word", F.explode(_keys(F.col("word"))).alias("key"))
    b = dictionary.select(F.col("word").alias("meant"), F.explode(_keys(F.col("word"))).alias("key"))
    return a.join(b, "key").filter(one_edit(F.col("word"), F.col("meant"))).select("word", "meant")


def slips(counts: DataFrame, dictionary: DataFrame, least: int = LEAST, usable: int = USABLE) -> DataFrame:
    """(word, n, meant, meant_n) for words that read as slips of the dictionary's words.

    A slip is no word of the dictionary, has 4 to 20 letters, occurs at least `least` times and is one edit from a word of
    the dictionary; it is also rare (at most 5 times) or the commonest word it may mean is 200 times as common. `meant`
    is that word, the last in the alphabet of equally common ones. Words of the dictionary that the corpus lacks count
    0. Without `usable` words in the dictionary nothing is a slip. Null words are left out.
    """
    known = dictionary.filter(F.col("word").rlike("^[a-z]+$") & (F.length("word") <= LONGEST_SLIP + 1)).select("word").distinct()
    enough = dictionary.select("word").distinct().agg((F.count("word") >= usable).alias("enough")).filter("enough")  # one row or none
    own = counts.filter(F.length("word").between(SHORTEST_SLIP, LONGEST_SLIP) & (F.col("n") >= least)).select("word", "n")
    own = own.join(dictionary.select("word"), "word", "left_anti").join(F.broadcast(enough)).drop("enough")
    pairs = neighbours(own, known).join(counts.select(F.col("word").alias("meant"), F.col("n").alias("meant_n")), "meant", "left")
    best = pairs.groupBy("word").agg(F.max(F.struct(F.coalesce("meant_n", F.lit(0)).alias("meant_n"), "meant")).alias("best"))
    judged = own.join(best, "word").select("word", "n", "best.meant", "best.meant_n")
    return judged.filter((F.col("n") <= RARE) | (F.col("meant_n") >= DOMINANCE * F.col("n")))


def signature(texts: DataFrame, text: str, found: DataFrame, top: int = TOP) -> DataFrame:
    """(word, n) of the commonest slips, well-known misspellings with them wherever they occur, also within words."""
    low = F.lower(text)
    hits = [F.sum((F.length(low) - F.length(F.replace(low, F.lit(s), F.lit("")))) / len(s)).cast("long").alias(s) for s in SEEDS]
    seeds = texts.agg(*hits).select(F.explode(F.array(*(F.struct(F.lit(s).alias("word"), F.col(s).alias("n")) for s in SEEDS))).alias("x")).select("x.*").filter("n > 0")
    return found.select("word", "n").unionByName(seeds).groupBy("word").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "word").limit(top)


_SLIPS = f"""WITH counts AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{{SHORTEST_WORD},}}')) AS word FROM documents) GROUP BY 1),
known AS (SELECT word, n FROM counts WHERE docs >= {IN_DOCUMENTS}),
pairs AS (SELECT c.word, c.n, k.word AS meant, k.n AS meant_n FROM counts c JOIN known k ON abs(length(c.word) - length(k.word)) <= 1 AND damerau_levenshtein(c.word, k.word) = 1
  WHERE c.docs < {IN_DOCUMENTS} AND c.n >= {LEAST} AND length(c.word) BETWEEN {SHORTEST_SLIP} AND {LONGEST_SLIP} AND (SELECT count(*) FROM known) >= {USABLE}),
slips AS (SELECT word, n, meant, meant_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY meant_n DESC, meant DESC) AS place FROM pairs) WHERE place = 1 AND (n <= {RARE} OR meant_n >= {DOMINANCE} * n))"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = v.table(spark, sf_dir, "documents")
    counts = written(word_counts(docs, "text", "doc_id"), "word-counts")  # used five times over
    return docs, slips(counts, counts.filter(F.col("docs") >= IN_DOCUMENTS).select("word"))


@query("n23_slips", f"{_SLIPS} SELECT word, n, meant, meant_n FROM slips")
def n23_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slips of the words that many documents have."""
    return _found(spark, sf_dir)[1]


@query(
    "n23_signature",
    f"""{_SLIPS}, seeds AS ({" UNION ALL ".join(f"SELECT '{s}' AS word, CAST(sum((length(lower(text)) - length(replace(lower(text), '{s}', ''))) / {len(s)}) AS BIGINT) AS n FROM documents" for s in SEEDS)})
SELECT word, max(n) AS n FROM (SELECT word, n FROM slips UNION ALL SELECT word, n FROM seeds WHERE n > 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}""",
)
def n23_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty commonest of them, a top-k report."""
    docs, found = _found(spark, sf_dir)
    return signature(docs, "text", found)
