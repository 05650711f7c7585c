"""Quality by positive-unlabelled learning.

A small network over statistics of the text is trained on trusted positives
and unlabelled web text by the non-negative unbiased risk
pi R_p(+) + max(0, R_u(-) - pi R_p(-)), with an estimated class prior pi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import append_columns, as_bytes, first_by_hash, fresh

#: Bounds of the fit: trusted positives and unlabelled documents.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
HIDDEN, EPOCHS, BATCH, RATE = 16, 60, 1024, 0.01

_SYMBOLS = b"!#$%&*|.,;:?@=<>{}[]()/\\_-+~^\"'"


def statistics(text: bytes | None) -> np.ndarray:
    """Shares that tell running prose from junk, whatever the language; zeros for no text."""
    out = np.zeros(len(_SYMBOLS) + 16)
    words = (text or b"").split()
    if not words:
        return out
    n = len(words)
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    total = int(c.sum())
    upper, lower, digit = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    out[:len(_SYMBOLS)] = np.sqrt(np.minimum(c[np.frombuffer(_SYMBOLS, dtype=np.uint8)] / n, 4))
    size = np.fromiter(map(len, words), np.int64, n)
    seen = len(set(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words[1:], words))
    at = len(_SYMBOLS)
    out[at:] = [
        np.log1p(n) / 8, size.mean() / 10, size.std() / 10, size.max() / 100,
        upper / max(1, upper + lower), np.sqrt(digit / total), int(c[128:].sum()) / total,
        seen / n, np.sqrt(same / n), np.log(seen + 1) / np.log(n + 2),
        np.log1p(len(lines)) / 6, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 6,
        np.sqrt((size == 1).mean()), (size > 30).mean(), int(c[32] + c[10]) / total]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 10) -> Network:
    """Minimise the non-negative risk by Adam; where its negative part falls below 0, ascend on that part."""
    rng = np.random.default_rng(seed)
    every = np.vstack([pos, unl])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    p_all, u_all = (((x - mean) / scale).clip(-8, 8) for x in (pos, unl))
    d = every.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(20, -(-len(u_all) // BATCH))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for _ in range(steps):
            p = p_all[rng.integers(0, len(p_all), min(BATCH, len(p_all)))]
            u = u_all[rng.integers(0, len(u_all), min(BATCH, len(u_all)))]
            x = np.vstack([p, u])
            h = np.tanh(x @ w[0] + w[1])
            g = np.clip(h @ w[2] + w[3][0], -30, 30)
            s = 1 / (1 + np.exp(-g))
            k = len(p)
            neg_loss = np.logaddexp(0, g)                      # loss of calling it negative
            negative = neg_loss[k:].mean() - prior * neg_loss[:k].mean()
            dg = np.zeros(len(x))
            if negative >= 0:
                dg[:k] = prior * (s[:k] - 1) / k - prior * s[:k] / k
                dg[k:] = s[k:] / len(u)
            else:                                              # undo the overfit of the negative part
                dg[:k] = prior * s[:k] / k
                dg[k:] = -s[k:] / len(u)
            dh = np.outer(dg, w[2]) * (1 - h * h)
            grad = [x.T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ dg + 1e-4 * w[2], np.array([dg.sum()])]
            t += 1
            for q in range(4):
                m[q] = 0.9 * m[q] + 0.1 * grad[q]
                v[q] = 0.999 * v[q] + 0.001 * grad[q] ** 2
                w[q] = w[q] - rate * (m[q] / (1 - 0.9 ** t)) / (np.sqrt(v[q] / (1 - 0.999 ** t)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))


def _collect_statistics(texts: DataFrame) -> np.ndarray:
    """Statistics of a bounded table's distinct texts; a row of doubles each comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t).tolist() for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "x array<double>")
    got = [r["x"] for r in rows.distinct().collect()]
    return np.array(got) if got else np.zeros((0, len(statistics(None))))


def fit(docs: DataFrame, labelled: DataFrame, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED) -> Network | float:
    """Learn from `docs(doc_id, text)` and `labelled(doc_id, label)`.

    The prior is the smoothed share of label 1 among the labelled rows, the
    only use of label 0. Positives are at most `max_positive` label-1 rows and
    the unlabelled text at most `max_unlabelled` documents, both the first by a
    hash of doc_id. Without positives or documents the prior itself, a number,
    is what comes back, and every score is that.
    """
    known = labelled.where("doc_id is not null and label is not null")
    n, n1 = known.agg(F.count("*"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))).first()
    prior = (n1 + 1) / (n + 2)
    # Broadcasts: at most max_positive and max_unlabelled ids.
    positive = first_by_hash(known.where("label = 1").select("doc_id"), F.xxhash64("doc_id"), max_positive, "positive")
    unlabelled = first_by_hash(docs.select("doc_id").where("doc_id is not null"), F.xxhash64("doc_id", F.lit(1)), max_unlabelled, "unlabelled")
    texts = docs.select("doc_id", "text")
    pos = _collect_statistics(texts.join(F.broadcast(positive), "doc_id"))
    unl = _collect_statistics(texts.join(F.broadcast(unlabelled), "doc_id"))
    return train(pos, unl, prior) if len(pos) and len(unl) else prior


def quality_scores(docs: DataFrame, network: Network | float, score: str = "quality_score") -> DataFrame:
    """`docs` with a double column `score` in 0..1, from the whole text alone.

    Null and empty texts have the score of all-zero statistics. Repeated rows
    have equal scores; an empty table gives an empty result. A column of that
    name gives way; others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    columns = [c for c in docs.columns if c.lower() != score.lower()]
    text = fresh(["_llm_text"], columns)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        net = shared.value
        for b in batches:
            if isinstance(net, float):
                yield b, [pa.array([net] * b.num_rows, pa.float64())]
                continue
            x = np.array([statistics(t) for t in as_bytes(b.column(text))]).reshape(b.num_rows, -1)
            # One row at a time in the product's order: equal rows get equal scores in any batch.
            yield b, [pa.array(np.round(net.scores(x), 9) if b.num_rows else [], pa.float64())]

    with_text = docs.select(*columns, F.col("text").cast("string").alias(text))
    out, (name,) = append_columns(with_text, [T.StructField("llm_score", T.DoubleType())], run)
    return out.select(*columns, F.col(name).alias(score))
