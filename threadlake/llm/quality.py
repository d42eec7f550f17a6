"""Text quality by co-training.

Two views of a document have a logistic classifier each: its content (hashed words, and hashed shapes of
words, in which letters and digits stand for their kind) and its page metadata (source, language, size, lines
and the make-up of characters). Both learn from a bounded sample of labelled rows. In every round each view labels
the rows of a bounded unlabelled sample of which it is surest, as many of each class as the labelled rows'
share asks for, and both learn again with those. Last, each view is calibrated on labelled rows kept
apart (a slope and an offset), and all documents are scored by the sum of the calibrated logits.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.arrow import append_columns, as_bytes, documents, id_crc
from threadlake.llm.toxicity import one_label, sigmoid
from threadlake.llm.words import hash_words, word_spans

CONTENT = 2048
METADATA = 64 + 12
LABELLED = 3000
UNLABELLED = 3000
ROUNDS = 4
GROWTH = 200
# letters, digits and what lies beyond ASCII by kind; other bytes as they are
_SHAPE = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)


def _kind_counts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the share of upper-case, lower-case, digit, space, line-end and other bytes."""
    kind = np.full(256, 5)
    for k, cs in enumerate((range(65, 91), [*range(97, 123), *range(128, 256)], range(48, 58), (32,), (10,))):
        kind[list(cs)] = k
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.bincount(text * 6 + kind[data[: first[-1]]], minlength=6 * (len(first) - 1)).reshape(-1, 6).astype(float)
    return counts / np.maximum(1, counts.sum(axis=1, keepdims=True))


def content_view(texts: list[bytes | None]) -> np.ndarray:
    """Square roots of the shares of hashed words and hashed shape trigrams."""
    n, half = len(texts), CONTENT // 2
    words = hash_words(texts)
    out = np.zeros((n, CONTENT))
    out[:, :half] = np.bincount(words.owner() * half + (words.hashes % np.uint64(half)).astype(np.int64), minlength=n * half).reshape(n, half)
    data, _, _, _ = word_spans(texts, folded=False)
    first = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    shape = _SHAPE[data].astype(np.uint64)
    if len(shape) > 2:
        gram = (shape[:-2] * np.uint64(65537) + shape[1:-1] * np.uint64(257) + shape[2:]) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.repeat(np.arange(n), np.diff(first))[: len(gram)]
        out[:, half:] = np.bincount(owner * half + (gram >> np.uint64(54)).astype(np.int64), minlength=n * half).reshape(n, half)
    for part in (slice(0, half), slice(half, CONTENT)):
        out[:, part] = np.sqrt(out[:, part] / np.maximum(1, out[:, part].sum(axis=1, keepdims=True)))
    return out


def metadata_view(texts: list[bytes | None], sources: list[str | None], langs: list[str | None]) -> np.ndarray:
    """Hashed source and language, and numbers of the page's layout."""
    n = len(texts)
    out = np.zeros((n, METADATA))
    for k, (s, g) in enumerate(zip(sources, langs, strict=True)):
        out[k, zlib.crc32(f"source={s}".encode()) % 64] = 1
        out[k, zlib.crc32(f"lang={g}".encode()) % 64] = 1
    data, starts, ends, offsets = word_spans(texts, folded=False)
    first = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    shares = _kind_counts(data, first)
    size = np.diff(first) - 1
    words = np.diff(offsets)
    lines = np.array([(t or b"").count(b"\n") + 1 for t in texts])
    hashes = hash_words(texts, folded=False)
    distinct = np.array([len(np.unique(hashes.hashes[a:b])) for a, b in zip(hashes.offsets[:-1], hashes.offsets[1:], strict=True)])
    length = np.zeros(n)
    np.add.at(length, np.repeat(np.arange(n), words), ends - starts)
    numbers = (np.log1p(size), np.log1p(words), np.log1p(lines), distinct / np.maximum(1, words), length / np.maximum(1, words) / 10, np.log1p(size / lines))
    out[:, 64:70] = np.stack(numbers, axis=1)
    out[:, 70:76] = np.sqrt(shares) * 3
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logits(x) + self.offset


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 3e-3, steps: int = 80) -> Logistic:
    """Accelerated gradient descent on the standardised features."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    z = ((x - mean) / scale).astype(np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    weight, bias = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    # the largest curvature, by power iteration
    y = y.astype(np.float32)
    weight, v = weight.astype(np.float32), np.full(x.shape[1], x.shape[1] ** -0.5, np.float32)
    for _ in range(10):
        v = z.T @ (z @ v)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate = 1 / (0.25 * norm / max(1, len(y)) + decay + 0.25)
    ahead, back = weight.copy(), bias
    for k in range(steps):
        error = sigmoid(z @ ahead + back) - y
        fresh = ahead - rate * (z.T @ error / max(1, len(y)) + decay * ahead)
        fresh_b = back - rate * float(error.mean()) if len(y) else back
        momentum = k / (k + 3)
        ahead, back = fresh + momentum * (fresh - weight), fresh_b + momentum * (fresh_b - bias)
        weight, bias = fresh, fresh_b
    return Logistic(mean, scale, weight, bias)


@dataclass
class CoTrained:
    views: list[Logistic] = field(default_factory=list)
    prior: float = 0.0
    pseudo: int = 0

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        if not self.views:
            return np.full(len(views[0]), sigmoid(np.array(self.prior)))
        # both views' evidence beyond the prior, halved as they aren't quite independent
        total = sum(m.calibrated(x) - self.prior for m, x in zip(self.views, views, strict=True))
        return sigmoid(self.prior + 0.75 * total)


def co_train(labelled: list[np.ndarray], y: np.ndarray, unlabelled: list[np.ndarray], rounds: int = ROUNDS, growth: int = GROWTH) -> CoTrained:
    """Views as matrices; a fifth of the labelled rows is kept for calibration. Without both labels the share is the score."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = CoTrained(prior=float(np.log(share / (1 - share))))
    if len(y) < 10 or not 0 < y.sum() < len(y):
        return model
    kept = np.arange(len(y)) % 5 == 4
    if not 0 < y[kept].sum() < kept.sum() or not 0 < y[~kept].sum() < (~kept).sum():
        kept = np.zeros(len(y), bool)
    x = [v[~kept] for v in labelled]
    target = y[~kept].astype(float)
    free = np.arange(len(unlabelled[0]))
    added, label = np.zeros(0, np.int64), np.zeros(0)
    for turn in range(rounds + 1):
        both = np.concatenate([target, label])
        model.views = [fit_logistic(np.concatenate([v, u[added]]), both) for v, u in zip(x, unlabelled, strict=True)]
        if turn == rounds or not len(free):
            break
        # each view names its surest rows, for the other to learn from; rows that they name differently stay free
        taken: dict[int, float] = {}
        disputed: set[int] = set()

        def name(row: int, value: float, taken=taken, disputed=disputed) -> None:
            if taken.setdefault(row, value) != value:
                disputed.add(row)

        for m, u in zip(model.views, unlabelled, strict=True):
            s = sigmoid(m.logits(u[free]))
            order = np.argsort(s, kind="stable")
            up, down = round(growth * share), round(growth * (1 - share))
            for i in order[::-1][:up]:
                if s[i] > 0.9:
                    name(int(free[i]), 1.0)
            for i in order[:down]:
                if s[i] < 0.1:
                    name(int(free[i]), 0.0)
        taken = {k: x for k, x in taken.items() if k not in disputed}
        added = np.concatenate([added, np.array(list(taken), np.int64)])
        label = np.concatenate([label, np.array(list(taken.values()))])
        free = np.setdiff1d(free, added)
    model.pseudo = len(added)
    check, truth = (labelled, y) if not kept.any() else ([v[kept] for v in labelled], y[kept])
    for m, v in zip(model.views, check, strict=True):
        s = m.logits(v)
        scale = float(s.std()) or 1.0
        fit = fit_logistic((s / scale)[:, None], truth.astype(float), decay=1e-2, steps=300)
        m.slope = max(0.05, float(fit.weight[0] / fit.scale[0])) / scale
        m.offset = float(fit.bias - fit.weight[0] / fit.scale[0] * fit.mean[0])
    return model


def _views(rows: list) -> list[np.ndarray]:
    texts = [r["text"].encode() if r["text"] is not None else None for r in rows]
    parts = []
    for i in range(0, len(rows), 100):
        some, own = texts[i : i + 100], rows[i : i + 100]
        parts.append((content_view(some).astype(np.float32), metadata_view(some, [r["source"] for r in own], [r["lang"] for r in own]).astype(np.float32)))
    if not parts:
        return [np.zeros((0, CONTENT)), np.zeros((0, METADATA))]
    return [np.concatenate([p[k] for p in parts]) for k in (0, 1)]


def _sampled(rows: DataFrame, size: int) -> list:
    """About `size` rows, chosen by a hash of the id."""
    total = rows.count()
    if total > size:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 40)) < int((1 << 40) * size / total))
    return sorted(rows.limit(2 * size).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, unlabelled: int = UNLABELLED, **options) -> CoTrained:
    """Co-trains on bounded samples of the rows of `docs` with and without a label."""
    own = docs.select("doc_id", "text", "source", "lang")
    known = one_label(labels, label).withColumnRenamed(label, "y")
    rows = _sampled(own.join(known, "doc_id"), labelled)
    others = _sampled(own.join(known, "doc_id", "left_anti"), unlabelled)
    return co_train(_views(rows), np.array([int(r["y"]) for r in rows], np.int64), _views(others), **options)


def score(docs: DataFrame, model: CoTrained, drop: tuple[str, ...] = ()) -> DataFrame:
    """Each row of `docs` (with text, source and lang) with score, the chance of quality 1, and predicted (1 from 0.5 on).

    Null texts count as empty, null sources and languages as values of their own. Whole texts of any length are read;
    repeated rows get equal scores; an empty table stays empty. Columns of `docs` named score or predicted are
    replaced, all others are carried on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        column = lambda n: batch.column(batch.schema.get_field_index(n))
        texts, sources, langs = as_bytes(column("text")), column("source").to_pylist(), column("lang").to_pylist()
        s = np.concatenate(
            [np.zeros(0)] + [shared.value.scores([content_view(texts[i : i + 100]), metadata_view(texts[i : i + 100], sources[i : i + 100], langs[i : i + 100])]) for i in range(0, len(texts), 100)]
        )
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return append_columns(docs, "text", fields, compute, drop, 1 << 19)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out (its label is not learned from), score, predicted."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang", (F.pmod(id_crc(), F.lit(5)) == 1).alias("held_out"))
    model = fit(docs.filter("NOT held_out"), documents(spark, sf_dir, "labels"))
    return score(docs, model, ("text", "source", "lang")).select("doc_id", "held_out", "score", "predicted")
