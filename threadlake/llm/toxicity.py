"""Toxicity by a factorization machine over hashed terms.

A text is the set of buckets its terms hash to: its words, and the beginnings (PREFIXES bytes) of longer words, as
inflected forms share a stem. Every bucket seen in SEEN training rows is a feature, with a weight and a vector; the product
of two vectors weighs the pair, so that terms which are harmless alone can count together. No term is left out for
telling nothing by itself.

Regularisation does what a choice of terms would do: a weight is pulled to what its own rows say (the log odds of the
label, as far as they are surer than chance), a vector to zero, and the more so the fewer rows a term has. Trained by
AdaGrad in numpy on runs of rows; a fifth of the rows is kept to calibrate the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.arrow import append_columns, as_bytes, documents, id_crc
from threadlake.llm.langid import sample_labelled
from threadlake.llm.words import hash_words, mix

BITS = 20
PREFIXES = (4, 5, 6, 8)
FACTORS = 8
SEEN = 3
TERMS = 64
SAMPLE = 8000
EPOCHS = 6
LINEAR = 10
RUN = 64


@dataclass
class FactorizationMachine:
    feature: np.ndarray  # by bucket: number of the feature, or -1
    bias: float
    weight: np.ndarray
    vectors: np.ndarray
    slope: float = 1.0  # calibration of the logit
    shift: float = 0.0

    def logits(self, bags: list[np.ndarray]) -> np.ndarray:
        """Of rows of features, before calibration."""
        row, x = np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate([*bags, np.zeros(0, np.int64)]).astype(np.int64)
        pairs = np.zeros(len(bags))
        for f in range(self.vectors.shape[1]):
            v = self.vectors[x, f]
            pairs += np.bincount(row, v, len(bags)) ** 2 - np.bincount(row, v * v, len(bags))
        return self.bias + np.bincount(row, self.weight[x], len(bags)) + pairs / 2 * short(bags)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return sigmoid(self.slope * self.logits([self.known(b) for b in bags_of(texts)]) + self.shift)

    def known(self, bag: np.ndarray) -> np.ndarray:
        f = self.feature[bag]
        return f[f >= 0]


def short(bags: list[np.ndarray]) -> np.ndarray:
    """What a row's pairs count: the more terms, the less, as they grow with the square of the terms."""
    return np.array([TERMS / max(TERMS, len(b)) for b in bags])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def buckets_of(texts: list[bytes | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each term."""
    words = hash_words(texts)
    owner, size = words.owner(), words.ends - words.starts
    at, where = words.starts, owner
    texts_of, found = [owner], [words.hashes]
    prefix = np.zeros(len(at), np.uint64)
    for n in range(1, max(PREFIXES) + 1):
        prefix = prefix * np.uint64(257) + words.data[at + n - 1]
        longer = size > n
        at, where, size, prefix = at[longer], where[longer], size[longer], prefix[longer]
        if n in PREFIXES:
            texts_of.append(where)
            found.append(mix(prefix + np.uint64(n << 56)))
    return np.concatenate(texts_of), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def bags_of(texts: list[bytes | None], bits: int = BITS) -> list[np.ndarray]:
    """The distinct buckets of each text, a hundred texts at a time."""
    out = []
    for i in range(0, len(texts), 100):
        some = texts[i : i + 100]
        text, bucket = buckets_of(some, bits)
        both = np.unique((text << bits) + bucket)
        out += np.split(both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(1, len(some))))
    return out


def own_odds(bags: list[np.ndarray], y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """By feature: the log odds that its rows give, shrunk to 0 the less sure they are, and how many rows it has."""
    seen = np.stack([np.bincount(np.concatenate([bags[i] for i in np.flatnonzero(y == label)] or [np.zeros(0, np.int64)]), minlength=count) for label in (0, 1)])
    rows = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    held = seen + 2.0 * (seen.sum(axis=0) + 0.5) / rows.sum()  # two rows of the usual share are added to each label
    odds = np.log(held[1] / (rows[1] + 2)) - np.log(held[0] / (rows[0] + 2))
    z2 = odds**2 / (1 / held).sum(axis=0)
    chance = 2 * np.log(max(2, count))  # what the surest of so many terms reaches without telling anything
    return odds * np.maximum(0, 1 - chance / np.maximum(z2, 1e-9)), seen.sum(axis=0)


def train(
    texts: list[bytes | None], labels: list[int], factors: int = FACTORS, epochs: int = EPOCHS, linear: int = LINEAR, rate: float = 0.1, pull: float = 5.0, pull_vectors: float = 100.0, seed: int = 1, bits: int = BITS
) -> FactorizationMachine:
    """AdaGrad on the logistic loss. Without both labels the score is the share of label 1, or 0.5 of no rows."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    feature = np.full(1 << bits, -1, np.int32)
    machine = FactorizationMachine(feature, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, factors)))
    if not 0 < y.sum() < len(y):
        return machine
    bags = bags_of(texts, bits)
    rows = np.bincount(np.concatenate(bags), minlength=1 << bits)
    ids = np.flatnonzero(rows >= SEEN)
    feature[ids] = np.arange(len(ids))
    count = max(1, len(ids))
    bags = [machine.known(b) for b in bags]
    held = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    order = np.flatnonzero(~held)
    goal, n = own_odds([bags[i] for i in order], y[order], count)
    machine.weight, machine.vectors = goal.copy(), rng.normal(0, 0.01, (count, factors))
    sum_b, sum_w, sum_v = 1.0, np.ones(count), np.ones((count, factors))
    for turn in range(linear + epochs):
        paired = turn >= linear
        mixed = rng.permutation(order)
        for i in range(0, len(mixed), RUN):
            own = mixed[i : i + RUN]
            # terms are left out at random, so that each learns to count without the others
            some = [bags[k][rng.random(len(bags[k])) < rng.uniform(0.4, 1)] for k in own]
            x, row = np.concatenate(some), np.repeat(np.arange(len(own)), [len(b) for b in some])
            v = machine.vectors[x]
            total = np.stack([np.bincount(row, v[:, f], len(own)) for f in range(factors)], axis=1)
            pairs = (total**2).sum(axis=1) - np.bincount(row, (v * v).sum(axis=1), len(own))
            share_of = short(some) * paired
            g = sigmoid(machine.bias + np.bincount(row, machine.weight[x], len(own)) + pairs / 2 * share_of) - y[own]
            sum_b += (g * g).sum()
            machine.bias -= rate * g.sum() / np.sqrt(sum_b)
            u, at, times = np.unique(x, return_inverse=True, return_counts=True)
            part = times / np.maximum(n[u], 1)  # of a term's rows: all its pull comes once an epoch
            gw = np.bincount(at, g[row], len(u)) + pull * part * (machine.weight[u] - goal[u])
            if not paired:
                sum_w[u] += gw * gw
                machine.weight[u] -= rate * gw / np.sqrt(sum_w[u])
                continue
            gv = np.stack([np.bincount(at, (g * share_of)[row] * (total[row, f] - v[:, f]), len(u)) for f in range(factors)], axis=1) + pull_vectors * part[:, None] * machine.vectors[u]
            sum_w[u] += gw * gw
            sum_v[u] += gv * gv
            machine.weight[u] -= rate * gw / np.sqrt(sum_w[u])
            machine.vectors[u] -= rate * gv / np.sqrt(sum_v[u])
    if 0 < y[held].sum() < held.sum():
        machine.slope, machine.shift = calibrated(machine.logits([bags[i] for i in np.flatnonzero(held)]), y[held])
    return machine


def calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logit of least loss: for each slope of a range the shift that keeps the share of label 1."""
    found = []
    for slope in np.geomspace(0.02, 8, 40):
        low, high = -30.0 - slope * logits.max(), 30.0 - slope * logits.min()
        for _ in range(60):
            shift = (low + high) / 2
            low, high = (shift, high) if sigmoid(slope * logits + shift).sum() < y.sum() else (low, shift)
        p = sigmoid(slope * logits + shift)
        found.append((-np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-9)).mean(), float(slope), float(shift)))
    return min(found)[1:]


def fit(labelled: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, **options) -> FactorizationMachine:
    """A machine of a bounded sample of the rows with a label. Without rows every score is 0.5."""
    rows = sample_labelled(labelled, label, text, doc_id, sample)
    return train([t for t, _ in rows], [int(x) for _, x in rows], **options)


def one_label(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """A row for each id that has a label; where its rows differ, the greatest label counts."""
    return labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias(label))


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Each row of `docs` with score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts of any length are scored, each row alone: repeated rows get equal scores, null and empty texts and those
    without a known term the score of no terms. An empty table stays empty. Columns of `docs` named score or
    predicted are replaced, all others are carried on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        s = shared.value.scores(as_bytes(batch.column(batch.schema.get_field_index(text))))
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return append_columns(docs, text, fields, compute, drop)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out (its label is not learned from; false for a null id), score, predicted."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.pmod(id_crc(), F.lit(5)) == 0, F.lit(False))
    model = fit(docs.filter(~held_out).join(one_label(documents(spark, sf_dir, "labels"), "toxic"), "doc_id"))
    return score(docs.withColumn("held_out", held_out), model, drop=("text",)).select("doc_id", "held_out", "score", "predicted")
