"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 2 to 4 bytes, over word edges too, hashed to
BUCKETS rows); a linear softmax over that mean gives the languages. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. As the softmax is linear in the mean, the trained
embeddings are folded into one small table of BUCKETS x languages, and scoring is a mean of table rows.

Calibration, on labelled rows held out of the descent: a temperature for the probabilities, and a
rejection threshold below which only REJECTED of well-formed rows fall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.arrow import append_columns, as_bytes, documents, id_crc
from threadlake.llm.words import mix, word_spans

BUCKETS = 1 << 14
DIMENSIONS = 16
SAMPLE = 4000
EPOCHS = 8
REJECTED = 0.001
UNKNOWN = "und"
_CHUNK = 1 << 18


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # logits by bucket and language
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in _chunks(texts):
            bucket, offsets = subwords(texts[a:b])
            n = np.diff(offsets)
            total = np.zeros((b - a, len(self.languages)))
            some = np.flatnonzero(n)
            if len(some):
                for k in range(len(self.languages)):
                    total[some, k] = np.add.reduceat(self.table[:, k][bucket], offsets[:-1][some])
            out[a:b] = total / np.maximum(n, 1)[:, None] + self.bias
        return softmax(out / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _chunks(texts: list[bytes | None]):
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or b"")
        if held >= _CHUNK or k == len(texts) - 1:
            yield start, k + 1
            start, held = k + 1, 0


def subwords(texts: list[bytes | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each text, one text after the other, and where each text's begin."""
    data, _, _, _ = word_spans(texts, folded=True)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=first[1:])
    # a blank stands before each text, as one follows it, so that a text's subwords don't depend on its neighbours
    data = np.concatenate([np.array([10], np.uint8), data])
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    h = np.where(letter, data, 32).astype(np.uint64) + np.uint64(1)
    found, where = [], []
    gram = h
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(257) + h[n - 1 :]
        # a run may begin or end at a word's edge, but holds at least a letter at its second place
        inside = letter[1 : len(gram) + 1].copy()
        for k in range(2, n - 1):
            inside &= letter[k : k + len(gram)]
        at = np.flatnonzero(inside)
        found.append((mix(gram[at] + np.uint64(n << 56)) % np.uint64(buckets)).astype(np.int32))
        where.append(at)
    at = np.concatenate(where)
    text = np.searchsorted(first, at, "right") - 1
    order = np.argsort(text.astype(np.int32), kind="stable")
    counts = np.bincount(text, minlength=len(texts))
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(counts)])


def train(texts: list[bytes | None], labels: list[str], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rejected: float = REJECTED, seed: int = 1) -> LanguageModel:
    """Fits embeddings and softmax by stochastic gradient descent; a fifth of the rows is kept for calibration."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    bags = []
    for t in texts:
        bucket, _ = subwords([t], buckets)
        kinds, n = np.unique(bucket, return_counts=True)
        bags.append((kinds, n / max(1, n.sum())))
    y = np.array([languages.index(x) for x in labels])
    held = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    embed, weight, bias = rng.normal(0, 0.1, (buckets, dimensions)), np.zeros((dimensions, len(languages))), np.zeros(len(languages))
    weight += rng.normal(0, 0.1, weight.shape)
    order = np.flatnonzero(~held)
    steps, done = epochs * len(order), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            rate = 1.0 * (1 - done / max(1, steps))
            done += 1
            kinds, share = bags[i]
            mean = share @ embed[kinds]
            p = softmax((mean @ weight + bias)[None, :])[0]
            p[y[i]] -= 1
            back = weight @ p
            weight -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            embed[kinds] -= rate * np.minimum(1.0, share * 20)[:, None] * back
    model = LanguageModel(languages, (embed @ weight).astype(np.float32), bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else order
    logits = np.array([bags[i][1] @ model.table[bags[i][0]] + bias for i in check]) if len(check) else np.zeros((0, len(languages)))
    if len(check):
        losses = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 21)}
        model.temperature = float(min(losses, key=losses.get))
        top = softmax(logits / model.temperature).max(axis=1)
        # never far above an even split, so that short but clean texts stay
        model.threshold = float(min(np.quantile(top, rejected), 1.5 / len(languages)))
    return model


def sample_labelled(docs: DataFrame, label: str, text: str, doc_id: str, size: int) -> list[tuple[bytes | None, object]]:
    """About `size` rows with a label, chosen by a hash of the id: bounded in rows, the same at every run."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    total = rows.count()
    if total > size:
        # texts of twice the size are read at most
        share = int(size / total * (1 << 40))
        rows = rows.filter(F.pmod(F.xxhash64(doc_id, F.lit(77)), F.lit(1 << 40)) < share)
    found = rows.select(doc_id, text, label).limit(2 * size).collect()
    return [(r[text].encode(), r[label]) for r in sorted(found, key=lambda r: (r[doc_id] is not None, r[doc_id] or 0, r[text]))]


def fit(labelled: DataFrame, label: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, **options) -> LanguageModel:
    """A model of a bounded sample of the rows with a label. Without such rows it knows no language and says `und`."""
    rows = sample_labelled(labelled, label, text, doc_id, sample)
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    return train([t for t, _ in rows], [str(x) for _, x in rows], **options)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Each row of `docs` with lang_pred, score (its calibrated probability) and rejected.

    A null text or one without a letter gets `und`, score 0, rejected. Rows whose best language is less likely
    than the model's threshold are rejected as well, but keep their prediction. Whole texts are read, repeated rows get
    equal predictions, an empty table stays empty. Columns of `docs` named as the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = "__has_letter"
    while flag in docs.columns:
        flag += "_"
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        letters = batch.column(batch.schema.get_field_index(flag)).to_pylist()
        if not model.languages:
            best, top = [None] * len(texts), np.zeros(len(texts))
        else:
            p = model.probabilities(texts)
            best, top = [model.languages[k] for k in p.argmax(axis=1)], p.max(axis=1)
        known = [x and b is not None for x, b in zip(letters, best, strict=True)]
        return [
            pa.array([b if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
            pa.array(np.where(known, top, 0.0), pa.float64()),
            pa.array([not k or x < model.threshold for k, x in zip(known, top, strict=True)], pa.bool_()),
        ]

    return append_columns(docs.withColumn(flag, has_letter), text, fields, compute, (*drop, flag))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter((F.pmod(id_crc(), F.lit(4)) != 2) & F.col("lang").isNotNull())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out (not learned from; false for a null id), lang_pred, score, rejected."""
    docs = documents(spark, sf_dir)
    model = fit(learnable(docs))
    rows = docs.select("doc_id", "text", F.coalesce(F.pmod(id_crc(), F.lit(4)) == 2, F.lit(False)).alias("held_out"))
    return predict(rows, model, drop=("text",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
