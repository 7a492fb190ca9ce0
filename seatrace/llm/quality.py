"""Quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are words and runs of other signs, cases kept; one-, two- and three-token grams are hashed into buckets, and a
token that repeats the one before counts under one shared gram. A document is the sparse vector of its gram frequencies
scaled by `scale`; its score is a sparse dot product through a logistic curve.

The fit takes a bounded sample (`per_class` labelled texts of each label, at most `max_chars` characters each).

Edge cases: null and empty texts have no grams and are scored by the offset alone; without labels of both kinds each
score is the share of label 1, or 0; repeated rows get equal scores; texts are scored whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashMemo, bounded_sample, crc_bucket, map_texts, platt, sigmoid

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _word_hash(word: str) -> int:
    raw = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32) | zlib.adler32(raw)


def grams(ids: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of all one-, two- and three-token grams of a token sequence; a token after its equal is one shared gram."""
    if not len(ids):
        return np.empty(0, np.int64)
    one = ids * _A
    two = (ids[:-1] * _A ^ ids[1:]) * _B
    three = ((ids[:-2] * _A ^ ids[1:-1]) * _B ^ ids[2:]) * _A if len(ids) > 2 else np.empty(0, np.uint64)
    two = np.where(ids[:-1] == ids[1:], np.uint64(1), two)
    return np.concatenate([_mixed(one, bits), _mixed(two, bits), _mixed(three, bits)])


class Tokens:
    def __init__(self):
        self.memo = HashMemo(_word_hash)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, _TOKEN.findall(text or "")), np.uint64)


def train(texts, labels, sizes, *, bits=20, scale=8.0, alpha=0.3, beta=1.0, l1=0.02, l2=0.05, epochs=4, seed=3):
    """(weights, offset, slope) or None without both labels. FTRL-proximal, one document an update."""
    if len(set(labels)) < 2:
        return None
    tokens, y = Tokens(), np.array(labels, float)
    rows = []
    for t in texts:
        g = grams(tokens(t), bits)
        ids, n = np.unique(g, return_counts=True)
        rows.append((ids, scale * n / max(1, len(g))))
    share = {k: sizes.get(k, 0) / max(1, sum(1 for v in labels if v == k)) for k in (0, 1)}
    weight = np.array([share[v] for v in labels])
    weight /= weight.mean()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0

    def of(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    def offset():
        return -z0 / ((beta + n0**0.5) / alpha)

    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, v = rows[i]
            w, w0 = of(z[ids], n[ids]), offset()
            slope = float(sigmoid(np.array(w @ v + w0)) - y[i]) * weight[i]
            g = slope * v
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
            z0 += slope - ((n0 + slope * slope) ** 0.5 - n0**0.5) / alpha * w0
            n0 += slope * slope
    w, w0 = of(z, n), offset()
    raw = np.array([w[rows[i][0]] @ rows[i][1] + w0 for i in held])
    a, b = platt(raw, y[held], weight[held])
    return (w * a * scale).astype(np.float32), float(a * w0 + b), bits


def _kernel(model_b, prior: float):
    model, tokens = model_b.value, Tokens()

    def run(texts):
        if model is None:
            return {"score": np.full(len(texts), prior)}
        w, offset, bits = model
        raw = np.full(len(texts), offset)
        for i, t in enumerate(texts):
            g = grams(tokens(t), bits)
            if len(g):
                raw[i] += w[g].sum(dtype=np.float64) / len(g)
        return {"score": sigmoid(raw)}

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label_col="quality", per_class=5000, max_chars=20_000, id_col="doc_id", text_col="text", **options):
    rows, sizes = bounded_sample(docs, labels.where(F.col(label_col).isin(0, 1)), label_col, per_class, max_chars, id_col=id_col, text_col=text_col)
    total = sum(sizes.values())
    return train([r[0] for r in rows], [int(r[1]) for r in rows], sizes, **options), (sizes.get(1, 0) / total if total else 0.0)


def score_quality(docs: DataFrame, model, *, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """Per document: id, kept columns and score (0 to 1, higher for label 1)."""
    weights, prior = model
    held = docs.sparkSession.sparkContext.broadcast(weights)
    return map_texts(docs, lambda: _kernel(held, prior), [T.StructField("score", T.DoubleType())], id_col=id_col, text_col=text_col, keep=keep)


def op5(spark, sf_dir: str) -> DataFrame:
    """Per document: held_out, score and predicted; null and empty texts are scored by the offset alone."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(crc_bucket("doc_id", 3) != 1))
    return score_quality(docs, model).select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
