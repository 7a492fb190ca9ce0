"""Language identification: interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

Texts become letters (lowered; runs of anything else are one boundary). Every letter of the learnt texts, of whatever
script, is a symbol of its own; letters that were never learnt share one. For each language the model of order n keeps, per order, the sorted hashes of its n-grams with their
discounted probabilities and of its contexts with their interpolation weights; a text gets the language of the lowest
cross-entropy per symbol. The score is that language's share when the languages' likelihoods over `evidence` symbols are
compared; a text is rejected where its cross-entropy is above its language's calibrated bound.

The fit takes a bounded sample (`per_class` texts of each language, at most `max_chars` characters each).

Edge cases: null texts and texts without a letter are `und` with score 0; rows with a null language aren't learnt from;
without any learnt language every text is `und`; equal cross-entropies go to the first language by name.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc_bucket, map_texts

#: Symbols: 0 boundary, 1 letter never learnt, 2.. the letters learnt. Four symbols are one 64-bit number.
SYMBOL_BITS, ORDER = 16, 4
#: n-grams whose shares a task remembers; beyond them it starts anew.
MEMO = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hash(codes: np.ndarray) -> np.ndarray:
    h = codes * _MULT
    return (h ^ (h >> np.uint64(31))) * _MULT


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(points: np.ndarray, of_point: np.ndarray) -> np.ndarray:
    """Symbols of one text, with runs of boundaries joined and a boundary at both ends."""
    s = np.concatenate([[0], of_point[points], [0]]).astype(np.uint64)
    return s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]


def codes(s: np.ndarray, order: int) -> np.ndarray:
    """One number for each run of `order` symbols."""
    out = np.zeros(len(s) - order + 1, np.uint64)
    for j in range(order):
        out = (out << np.uint64(SYMBOL_BITS)) | s[j : len(s) - order + 1 + j]
    return out


@dataclass
class KneserNey:
    """grams[k]: (sorted hashes, discounted share) of (k+1)-grams; contexts[k]: (sorted hashes, interpolation weight)."""

    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    @staticmethod
    def fit(seqs: list[np.ndarray], order: int, n_symbols: int, discount: float = 0.75) -> KneserNey:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        top = np.concatenate([codes(s, order) for s in seqs if len(s) >= order] or [np.empty(0, np.uint64)])
        keys, n = np.unique(top, return_counts=True)
        counts.append((keys, n.astype(float)))
        for k in range(order - 1, 0, -1):  # below the top: how many different symbols stand before
            shorter, n = np.unique(counts[-1][0] & np.uint64((1 << (SYMBOL_BITS * k)) - 1), return_counts=True)
            counts.append((shorter, n.astype(float)))
        grams, contexts = [], []
        for keys, n in reversed(counts):
            ctx, inverse = np.unique(keys >> np.uint64(SYMBOL_BITS), return_inverse=True)
            total = np.bincount(inverse, n, len(ctx)) if len(keys) else np.empty(0)
            kinds = np.bincount(inverse, minlength=len(ctx))
            grams.append(_sorted(keys, np.maximum(n - discount, 0) / total[inverse] if len(keys) else n))
            contexts.append(_sorted(ctx, discount * kinds / total if len(ctx) else total))
        return KneserNey(order, grams, contexts, 1.0 / n_symbols)

    def logs(self, top: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each top-order code after the symbols before it."""
        p = np.full(len(top), self.floor)
        for k in range(self.order):
            code = top & np.uint64((1 << (SYMBOL_BITS * (k + 1))) - 1)
            share, _ = _found(self.grams[k], code, 0.0)
            weight, _ = _found(self.contexts[k], code >> np.uint64(SYMBOL_BITS), 1.0)
            p = share + weight * p
        return np.log(p)


def _sorted(keys, values):
    h = _hash(keys)
    by = np.argsort(h)
    return h[by], np.asarray(values, float)[by]


def _found(table, code, default):
    hashes, values = table
    if not len(hashes):
        return np.full(len(code), default), None
    h = _hash(code)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, values[at], default), at


@dataclass
class Identifier:
    langs: list[str]
    models: list[KneserNey]
    of_point: np.ndarray
    order: int
    bounds: list[float]
    evidence: float


def train(texts: list[str], langs: list[str], *, order: int = ORDER, evidence: float = 20.0, reject_share: float = 0.005) -> Identifier | None:
    if not 1 <= order <= 64 // SYMBOL_BITS:
        raise ValueError(f"order is at most {64 // SYMBOL_BITS}")
    names = sorted(set(langs))
    if not names:
        return None
    is_letter = letters()
    points = [code_points(t) for t in texts]
    n = np.zeros(0x110000, np.int64)
    for p in points:
        ids, c = np.unique(p, return_counts=True)
        n[ids] += c
    n[~is_letter] = 0
    common = np.argsort(-n, kind="stable")[: (1 << SYMBOL_BITS) - 2]
    common = np.sort(common[n[common] > 0])
    of_point = is_letter.astype(np.uint16)
    of_point[common] = np.arange(2, 2 + len(common))
    seqs = [symbols(p, of_point) for p in points]
    models, bounds = [], []
    for name in names:
        own = [s for s, l in zip(seqs, langs, strict=True) if l == name]
        fit, held = [s for i, s in enumerate(own) if i % 5], own[::5]
        model = KneserNey.fit(fit or held, order, len(common) + 2)
        entropies = [-model.logs(codes(s, order)).mean() for s in held if len(s) >= order + 20]
        bounds.append(float(np.quantile(entropies, 1 - reject_share)) * 1.05 if len(entropies) >= 20 else float("inf"))
        models.append(model)
    return Identifier(names, models, of_point, order, bounds, evidence)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def _kernel(model_b):
    model: Identifier | None = model_b.value
    if model is not None:
        memo = np.empty(0, np.uint64), np.empty((0, len(model.langs)), np.float32)  # n-grams met so far, ascending, and their log shares

    def run(texts):
        nonlocal memo
        n = len(texts)
        out = {"lang_pred": ["und"] * n, "score": np.zeros(n), "cross_entropy": [None] * n, "rejected": [True] * n}
        if model is None:
            return out
        tops = []
        for t in texts:
            s = symbols(code_points(t), model.of_point) if t else np.zeros(1, np.uint64)
            if len(s) < 3:
                tops.append(np.empty(0, np.uint64))  # no letter
            else:
                tops.append(codes(np.concatenate([np.zeros(max(1, model.order - 2), np.uint64), s]) if len(s) < 2 * model.order else s, model.order))
        sizes = np.array([len(t) for t in tops], np.int64)
        every = np.concatenate(tops) if tops else np.empty(0, np.uint64)
        if not len(every):
            return out
        grams, at = np.unique(every, return_inverse=True)
        held, logs = memo
        near = np.minimum(np.searchsorted(held, grams), max(0, len(held) - 1))
        new = grams[held[near] != grams] if len(held) else grams
        if len(new):
            fresh = np.stack([m.logs(new) for m in model.models], 1).astype(np.float32)
            if len(held) + len(new) > MEMO:
                held, logs = held[near[held[near] == grams]] if len(held) else held, logs[near[held[near] == grams]] if len(held) else logs
            both = np.concatenate([held, new])
            by = np.argsort(both, kind="stable")
            held, logs = memo = both[by], np.concatenate([logs, fresh])[by]
        own = logs[np.searchsorted(held, grams)]
        some = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        total = np.stack([np.add.reduceat(own[:, j].astype(np.float64)[at], starts) for j in range(len(model.langs))], 1)
        entropy = -total / sizes[some][:, None]
        for d, e, size in zip(some, entropy, sizes[some], strict=True):
            best = int(np.argmin(e))
            odds = np.exp(-(e - e[best]) * min(model.evidence, float(size)))
            out["lang_pred"][d], out["score"][d] = model.langs[best], 1.0 / odds.sum()
            out["cross_entropy"][d], out["rejected"][d] = float(e[best]), bool(e[best] > model.bounds[best])
        return out

    return run


def fit(docs: DataFrame, *, lang_col="lang", per_class=1500, max_chars=20_000, id_col="doc_id", text_col="text", **options) -> Identifier | None:
    rows, _ = bounded_sample(docs.select(id_col, text_col), docs.select(id_col, F.col(lang_col).cast("string").alias("__l")), "__l", per_class, max_chars, id_col=id_col, text_col=text_col)
    return train([r[0] for r in rows], [r[1] for r in rows], **options)


def identify(docs: DataFrame, model: Identifier | None, *, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """Per document: id, kept columns, lang_pred (learnt language or und), score, cross_entropy and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: _kernel(held), FIELDS, id_col=id_col, text_col=text_col, keep=keep)


def op7(spark, sf_dir: str) -> DataFrame:
    """Per document: lang_pred and score; null texts and those without a letter are und with score 0; a table without languages gives und alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc_bucket("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
