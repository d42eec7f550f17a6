"""Column functions for scores, costs and ranks (operators M01-M16, D07)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priority of a fact's kind in ranking; what isn't listed counts 0.6.
KIND_PRIORITY = {
    "correction": 1.0,
    "ban": 1.0,
    "decision": 0.9,
    "goal": 0.85,
    "self_correction": 0.75,
    "truth_assertion": 0.75,
    "progress": 0.7,
    "domain_fact": 0.6,
    "model_correction": 0.6,
    "away_summary": 0.5,
}
# By how much a dense hit of a kind comes nearer; what isn't listed 0.02.
DENSE_BOOST = {
    "correction": 0.14,
    "ban": 0.14,
    "decision": 0.12,
    "goal": 0.10,
    "self_correction": 0.08,
    "truth_assertion": 0.08,
    "progress": 0.06,
    "domain_fact": 0.0,
    "model_correction": 0.04,
    "away_summary": 0.0,
}
# US dollars for a million tokens, input and output, by model or family.
RATES = {
    "haiku": (0.80, 4.00),
    "sonnet": (3.00, 15.00),
    "opus": (15.00, 75.00),
    "claude-haiku-4-5-20251001": (1.00, 5.00),
    "claude-sonnet-4-6": (3.00, 15.00),
    "claude-opus-4-7": (15.00, 75.00),
    "gpt-5": (1.25, 10.00),
    "gpt-5-mini": (0.25, 2.00),
    "gpt-5-nano": (0.05, 0.40),
    "o3": (10.00, 40.00),
    "o4-mini": (2.50, 10.00),
    "gemini-2.5-pro": (1.00, 10.00),
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-flash-lite": (0.10, 0.40),
    "gemini-pro": (1.00, 10.00),
    "default": (3.00, 15.00),
}
# Families of each provider, the more specific first, and how its models are recognised.
FAMILIES = {
    "anthropic": ["haiku", "sonnet", "opus"],
    "openai": ["gpt-5-nano", "gpt-5-mini", "gpt-5", "o4-mini", "o3"],
    "google": ["gemini-2.5-flash-lite", "gemini-2.5-flash", "gemini-2.5-pro", "gemini-pro"],
}
PROVIDERS = {"anthropic": "claude|haiku|sonnet|opus", "openai": "gpt-|^gpt|^o3|^o4", "google": "gemini"}
CACHE_READ, CACHE_CREATE = 0.10, 1.25


def relevance(rank: Column, base: Column) -> Column:
    """Half of a logistic of a BM25 rank (negative is better) and half of the base score; the base for no rank."""
    return F.when(rank.isNull(), base).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 / (1 + F.exp(rank)) + 0.5 * base)))


def recency(ts: Column, now: int | Column, half_life: float = 90.0) -> Column:
    """Halves every 90 days; 0.5 for an unknown time."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - ts) / 86400.0)
    return F.when(ts.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), age / half_life))


def kind_priority(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for p in KIND_PRIORITY.items() for x in p))
    return F.coalesce(F.element_at(table, kind), F.lit(0.6))


def composite(relevance: Column, ts: Column, kind: Column, now: int | Column) -> Column:
    """Relevance, recency and kind in the proportion 5:3:2."""
    return 0.5 * relevance + 0.3 * recency(ts, now) + 0.2 * kind_priority(kind)


KIND_PRIORITY_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_PRIORITY.items()) + " ELSE 0.6 END"


def decayed(base: Column, days: Column, times: Column) -> Column:
    """Confidence halved every 90 days, raised for repeated statements by at most half."""
    days, times = F.greatest(F.lit(0.0), days), F.greatest(F.lit(0), times)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * F.pow(F.lit(0.5), days / 90.0) * F.least(1 + 0.2 * F.log(1 + times), F.lit(1.5))))


# How far a source of claims can be trusted; an unknown one like an inference.
SOURCE_QUALITY = {"explicit_user_assertion": 4, "git_config_or_claude_md": 3, "inferred_from_mention": 2, "quoted_or_hypothetical": 1}


def conflict(old_quality: Column, new_quality: Column, old_category: Column, new_category: Column, evidence: Column) -> Column:
    """What becomes of a stored value when another is claimed.

    Claims of different categories coexist; a worse source never wins; one as good needs two pieces of evidence.
    """
    apart = F.coalesce((old_category != "") & (new_category != "") & (old_category != new_category), F.lit(False))
    return (
        F.when(apart, "coexist")
        .when(new_quality < old_quality, "keep_old")
        .when((F.coalesce(evidence, F.lit(1)) < 2) & (new_quality <= old_quality), "tentative")
        .otherwise("supersede")
    )


def fused(rank: Column, weight: Column | float = 1.0, k: int = 60) -> Column:
    """A reciprocal-rank term for a rank that counts from 0; to be summed over lists."""
    return F.lit(weight) / (k + rank + 1)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine_distance(a: Column, b: Column) -> Column:
    """M09."""
    return 1 - dot(a, b) / (norm(a) * norm(b))


def provider(model: Column) -> Column:
    """Whose model it is, by its name."""
    low, out = F.lower(F.trim(model)), None
    for name, pattern in PROVIDERS.items():
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("unknown")


def _rate(model: Column, at: int, own: dict[str, tuple[float, float]]) -> Column:
    low, whose = F.lower(F.trim(model)), provider(model)
    tests = [(low == k, x) for k, x in {**RATES, **own}.items()]
    for name, families in FAMILIES.items():
        tests += [(whose.isin(name, "unknown") & low.contains(f), own.get(f, RATES[f])) for f in families]
    out = None
    for test, rate in tests:
        out = F.when(test, rate[at]) if out is None else out.when(test, rate[at])
    return out.otherwise(own.get("default", RATES["default"])[at])


def cost(model: Column, fresh: Column, read: Column, created: Column, output: Column, own: dict[str, tuple[float, float]] | None = None) -> Column:
    """Dollars: the rate of the exact model, else of its provider's first family in the name, else the default one.

    Rates of one's `own` come before the fixed ones at either step. Only Anthropic bills cache writes more.
    """
    own = {k.lower(): x for k, x in (own or {}).items()}
    create = F.when(provider(model).isin("openai", "google"), 1.0).otherwise(CACHE_CREATE)
    return (_rate(model, 0, own) * (fresh + read * CACHE_READ + created * create) + _rate(model, 1, own) * output) / 1e6


def _rates_sql(at: int) -> str:
    exact = " ".join(f"WHEN lower(trim(model)) = '{k}' THEN {r[at]}" for k, r in RATES.items())
    families = " ".join(f"WHEN whose IN ('{p}', 'unknown') AND contains(lower(model), '{f}') THEN {RATES[f][at]}" for p, fs in FAMILIES.items() for f in fs)
    return f"CASE {exact} {families} ELSE {RATES['default'][at]} END"


PROVIDER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(model)), '{p}') THEN '{k}'" for k, p in PROVIDERS.items()) + " ELSE 'unknown' END"
COST_SQL = (
    f"(({_rates_sql(0)}) * (input_tokens + cache_read_tokens * {CACHE_READ} + cache_creation_tokens * CASE WHEN whose IN ('openai', 'google') THEN 1.0 ELSE {CACHE_CREATE} END)"
    f" + ({_rates_sql(1)}) * output_tokens) / 1e6"
)


def work_shape(ops: Column, marathon: Column, middle: Column) -> Column:
    """The shape of a body of sessions from its shares of short, long and middling ones."""
    return (
        F.when(ops >= 0.5, "ops_burst")
        .when(marathon >= 0.5, "marathon")
        .when((ops >= 0.2) & (marathon >= 0.2), "bimodal")
        .when(middle >= 0.5, "focused")
        .otherwise("mixed")
    )
