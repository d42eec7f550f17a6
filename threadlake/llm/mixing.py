"""Mixing to target weights by soft memberships, in DataFrame functions only.

A labelled table trains a naive Bayes classifier over hashed words; it gives every document a posterior
over the domains. With p[i, d] the posterior and t[i] the tokens of document i, rates r[i] >= 0 are sought for
which sum_i r[i] t[i] p[i, d] is the target of domain d, starting from rates that give every source the same
share. That least-squares problem has few rows and a column for each document; it is solved by projected gradient
steps, each one aggregation over the documents that brings back a number for each domain. The steps so far
are folded again over each document's starting rate, so no state is kept between them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.arrow import documents, id_crc, saved

BUCKETS = 1 << 12
STEPS = 30
TOLERANCE = 1e-4
SAMPLE = 20_000
DOMAINS = 64
EVIDENCE = 50.0

NEW = ("n_tokens", "domains", "posterior", "rate", "copies", "off_target")

Model = tuple[list[str], dict[tuple[str, int], float], list[float]]


def raw_words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and non-ASCII characters; empty strings may stand at the ends."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def word_list(text: Column) -> Column:
    return F.filter(raw_words(text), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_classifier(labelled: DataFrame, domain: str = "domain", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Domains, the log share of each domain's documents that hold a bucket's word, and log priors.

    Fitted on about `sample` labelled rows, chosen by a hash of the id. More than DOMAINS domains raise an error.
    """
    rows = labelled.filter(F.col(domain).isNotNull() & F.col(text).isNotNull())
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * sample / total))
    own = rows.select(F.col(domain).cast("string").alias("domain"), F.array_distinct(F.transform(word_list(F.col(text)), _bucket)).alias("buckets"))
    sizes = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count("*").alias("n")).limit(DOMAINS + 1).collect()}
    if len(sizes) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    names = sorted(sizes)
    seen = own.select("domain", F.explode("buckets").alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n")).collect()
    counts = {(r["domain"], r["b"]): r["n"] for r in seen}
    weights = {(d, b): math.log((counts.get((d, b), 0) + 0.5) / (sizes[d] + 1)) for d in names for b in range(BUCKETS)}
    return names, weights, [math.log(sizes[d] / sum(sizes.values())) for d in names]


def with_posteriors(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Each row of `docs` with n_tokens (words) and posterior, an array in the order of the domains.

    Nothing is shuffled: each row's words are looked up in a table that is a constant of the plan. The evidence of
    a long text counts as that of EVIDENCE words; a text without words has the priors.
    """
    names, weights, priors = model
    d = len(names)
    table = F.split(F.lit(",".join(f"{weights[x, b]:.7g}" for b in range(BUCKETS) for x in names)), ",").cast("array<double>")
    out = docs.withColumn("__words", raw_words(F.col(text)))
    empty = lambda at: F.when(F.element_at("__words", at) == "", 1).otherwise(0)
    tokens = F.size("__words") - empty(1) - F.when(F.size("__words") > 1, empty(-1)).otherwise(0)
    out = out.withColumn("n_tokens", tokens.cast("long")).withColumn("__b", F.transform("__words", lambda w: F.when(w == "", -1).otherwise(_bucket(w))))

    def evidence(k: int) -> Column:
        return F.aggregate("__b", F.lit(0.0), lambda a, b: a + F.coalesce(F.get(table, b * d + k), F.lit(0.0)))

    share = F.least(F.col("n_tokens").cast("double"), F.lit(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1))
    out = out.withColumn("__logs", F.array(*(F.lit(priors[k]) + evidence(k) * share for k in range(d))))
    out = out.withColumn("__raw", F.transform("__logs", lambda x: F.exp(x - F.array_max("__logs"))))
    total = F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("posterior", F.transform("__raw", lambda x: x / total)).drop("__words", "__b", "__logs", "__raw")


def _rate(history: list[list[float]]) -> Column:
    """The rate after the steps so far, each a number for each domain."""
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in history)) if history else F.array().cast("array<array<double>>")
    fit = lambda step: F.aggregate(F.zip_with("posterior", step, lambda p, y: p * y), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.col("__start"), lambda r, step: F.greatest(F.lit(0.0), r - F.col("n_tokens") * fit(step)))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[list[float]], float]:
    """The steps that bring the domains' expected tokens to `targets`, from rows of __start, n_tokens and posterior.

    Residuals are weighted by the inverse of the domains' Gram matrix, for which a gradient step of length 1 is safe.
    Also returned: by how much of all tokens the domain that is farthest off misses its target after the last step that was measured.
    """
    d = len(targets)
    gram_of = [F.sum(F.col("n_tokens") * F.col("n_tokens") * F.get("posterior", F.lit(i)) * F.get("posterior", F.lit(j))).alias(f"g{i}_{j}") for i in range(d) for j in range(d)]
    found = rows.agg(*gram_of).first()
    gram = np.array([x or 0.0 for x in found], float).reshape(d, d)
    inverse = np.linalg.pinv(gram + np.eye(d) * (1e-9 * gram.trace() + 1e-12))
    history: list[list[float]] = []
    off = 0.0
    for turn in range(steps + 1):
        sums = rows.withColumn("rate", _rate(history)).agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.get("posterior", F.lit(k))) for k in range(d))).first()
        residual = np.array([x or 0.0 for x in sums], float) - np.array(targets)
        off = float(np.abs(residual).max() / max(1.0, sum(targets)))
        if off <= tolerance or turn == steps:
            break
        history.append([float(x) for x in inverse @ residual])
    return history, off


def mix_sources(
    docs: DataFrame, labelled: DataFrame, domain: str = "domain", weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Each row of `docs` with n_tokens, domains, posterior, rate (expected number of copies), copies (a draw of it) and off_target.

    off_target is by how much of all tokens the domain that is farthest off misses its target: more than TOLERANCE where
    the targets can't be met, as when a domain has no documents.

    `weights` gives each domain's share of the tokens; by default the square root of its share of the corpus,
    normed. The whole keeps its number of tokens. Texts without words belong to the domains by their priors and
    count no tokens. A null source is a source of its own; a null id draws as any other. Without labelled rows or
    tokens every rate is the starting rate. Columns with the names of new ones are replaced, all others are carried on
    whatever they are named; those in `drop` are not. Repeated rows have equal rates; whole texts are read.
    """
    model = fit_classifier(labelled, domain, text, doc_id)
    names = model[0]
    kept = [c for c in docs.columns if c not in (*drop, *NEW)]
    base = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns})
    doc_id, text, source = (f"__own_{c}" for c in (doc_id, text, source))
    if names:
        scored = with_posteriors(base, model, text)
    else:
        scored = base.withColumn("n_tokens", F.size(word_list(F.col(text))).cast("long")).withColumn("posterior", F.array().cast("array<double>"))
    own = F.coalesce(F.col(source).cast("string"), F.lit(""))
    columns = [f"__own_{c}" for c in kept]
    scored = saved(scored.withColumn("__source", own).select(*dict.fromkeys([*columns, doc_id]), "n_tokens", "posterior", "__source"), "mixing")
    by_source = scored.groupBy("__source").agg(F.sum("n_tokens").alias("own"))
    whole = by_source.agg(F.sum("own").alias("all"), F.count(F.when(F.col("own") > 0, 1)).alias("sources")).first()
    tokens, sources = float(whole["all"] or 0), max(whole["sources"], 1)
    start = by_source.select("__source", F.when(F.col("own") > 0, F.lit(tokens / sources) / F.col("own")).otherwise(F.lit(1.0)).alias("__start"))
    rows = scored.join(start, "__source")
    history, off = [], 0.0
    if names and tokens:
        if weights is None:
            shares = scored.agg(*(F.sum(F.col("n_tokens") * F.get("posterior", F.lit(k))) for k in range(len(names)))).first()
            weights = {n: math.sqrt(max(x or 0.0, 0.0)) for n, x in zip(names, shares, strict=True)}
        total = sum(weights.get(n, 0.0) for n in names) or 1.0
        history, off = fit_rates(rows.select("__start", F.col("n_tokens").cast("double").alias("n_tokens"), "posterior"), [tokens * weights.get(n, 0.0) / total for n in names])
    u = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = rows.withColumn("rate", _rate(history))
    out = out.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
    out = out.withColumn("domains", F.array(*(F.lit(n) for n in names)).cast("array<string>")).withColumn("off_target", F.lit(off))
    return out.select(*(F.col(f"__own_{c}").alias(c) for c in kept), *NEW)


def language_labels(docs: DataFrame) -> DataFrame:
    """The labelled table of the queries: documents whose language is known, without those held out."""
    return docs.filter((F.pmod(id_crc(), F.lit(4)) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("domain"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its source, tokens, domain posterior, rate and copies, with languages as domains."""
    docs = documents(spark, sf_dir)
    mixed = mix_sources(docs.select("doc_id", "text", "source"), language_labels(docs), drop=("text",))
    return mixed.select("doc_id", "source", *NEW)
