"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's parts (itself, its beginnings and its end) are hashed to buckets; a word's vector is the sum of its buckets'
vectors, so inflected forms share what was learnt. Filters of several widths slide over the vectors of the whole text,
each filter keeps its maximum, and a logistic layer reads the maxima. Training backpropagates through the maxima only.
Buckets seen in fewer than `min_docs` training texts keep a zero vector, so words never learnt say nothing.

The fit learns from every labelled text, whole. The texts are dealt to shards of about SHARD; a shard learns from a slice
of its texts, then all go on from the mean of what they have learnt. Which buckets live is counted over all of them.
Scores that the texts get from networks which haven't learnt from them calibrate the score and one decision threshold for
each language, drawn towards the common one where a language has few labels: curve and thresholds are found by Spark over
all these scores. Language is never an input of a score.

Edge cases: null and empty texts are one padding token and get a score; without labels of both kinds the score of every
text is the known share of label 1, or 0; repeated rows get equal scores; texts are scored whole.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from seatrace.shipping import ship_package

from .common import bounded_batches, brief_shuffles, checkpoint_dir, crc_bucket, discard, keep_memory, map_texts, platt, release_memory, sigmoid, written

_WORD = re.compile(r"\w+")
WIDTHS = (1, 2, 3)


@dataclass
class Cnn:
    buckets: int
    table: np.ndarray  # (rows, d) vectors; row 0 is zero
    row_of: np.ndarray  # (buckets,) row of a bucket
    conv: dict[int, tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    bias: float
    curve: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def vectors(self, parts: np.ndarray) -> np.ndarray:
        """Word vectors from the table rows of their parts."""
        return self.table[parts].sum(1)

    def pooled(self, x: np.ndarray, starts: np.ndarray):
        """Maxima of all filters over documents that begin at starts; x has zeros between documents. Values go by filter, then place."""
        tops, pre, across = [], [], np.ascontiguousarray(x.T)
        for w, (weight, bias) in self.conv.items():
            d = x.shape[1]
            y = weight[:d].T @ across[:, : len(x) - w + 1]
            for j in range(1, w):
                y += weight[j * d : (j + 1) * d].T @ across[:, j : len(x) - w + 1 + j]
            for j in range(1, w):
                y[:, starts[1:] - j] = 0  # it would reach into the next document; there are windows of padding alone before it
            tops.append(np.maximum.reduceat(y, starts, axis=1).T + bias)
            pre.append(y)
        return pre, np.concatenate(tops, 1)

    def raw(self, x, starts):
        return np.maximum(self.pooled(x, starts)[1], 0) @ self.out + self.bias

    def score(self, raw):
        return sigmoid(self.curve[0] * raw + self.curve[1])


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


PARTS = 5


_WHOLE, _BEGINS, _ENDS = zlib.crc32(b"="), zlib.crc32(b"<"), zlib.crc32(b">")


def parts(word: str, buckets: int) -> list[int]:
    """Buckets of a word (behind `=`), its first four, five and six letters (behind `<`) and its last four (behind `>`); -1 where the word is no longer."""
    n, data = len(word), word.encode("utf-8", "surrogatepass")
    whole = zlib.crc32(data, _WHOLE) % buckets
    if n <= 4:
        return [whole, -1, -1, -1, -1]
    if len(data) == n:
        a, b, c, z = data[:4], data[4:5], data[5:6], data[-4:]
    else:
        a, b, c, z = (x.encode("utf-8", "surrogatepass") for x in (word[:4], word[4], word[5:6], word[-4:]))
    four = zlib.crc32(a, _BEGINS)
    five = zlib.crc32(b, four)
    return [whole, four % buckets, five % buckets if n > 5 else -1, zlib.crc32(c, five) % buckets if n > 6 else -1, zlib.crc32(z, _ENDS) % buckets]


#: crc32 by bytes: _CRC[x] is what the byte x adds.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
#: Longer words are hashed one by one.
_MOST_BYTES = 64


def _crc_on(crc: np.ndarray, data: np.ndarray) -> np.ndarray:
    """crc32 carried on by a byte for each place (without zlib's inversions)."""
    return _CRC[(crc ^ data) & np.uint32(255)] ^ (crc >> np.uint32(8))


def parts_of(found: list[str], buckets: int) -> np.ndarray:
    """parts() of many words, a row each: hashed side by side, byte by byte."""
    out = np.full((len(found), PARTS), -1, np.int64)
    apart = [i for i, w in enumerate(found) if len(w) > _MOST_BYTES or not w.isascii()]
    for i in apart:
        out[i] = parts(found[i], buckets)
    size = np.fromiter(map(len, found), np.int64, len(found))
    size[apart] = 0
    order = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]  # the longest first: those that have a further byte come first
    n = size[order]
    data = np.frombuffer("".join([found[i] for i in order]).encode("ascii"), np.uint8)
    begin = np.cumsum(n) - n
    flip = np.uint32(0xFFFFFFFF)
    whole, begins = (np.full(len(n), np.uint32(start) ^ flip, np.uint32) for start in (_WHOLE, _BEGINS))
    by_length = np.searchsorted(-n, -np.arange(1, n.max(initial=0) + 1), "right")  # how many words have so many bytes
    held = np.full((len(n), PARTS), -1, np.int64)
    for j, m in enumerate(by_length.tolist()):
        letter = data[begin[:m] + j]
        whole[:m] = _crc_on(whole[:m], letter)
        if j < 6:
            begins[:m] = _crc_on(begins[:m], letter)
            longer = np.count_nonzero(n > max(j + 1, 4))
            if j >= 3:
                held[:longer, j - 2] = (begins[:longer] ^ flip) % np.uint32(buckets)
    held[:, 0] = (whole ^ flip) % np.uint32(buckets)
    longer = np.count_nonzero(n > 4)
    ends = np.full(longer, np.uint32(_ENDS) ^ flip, np.uint32)
    for j in range(4, 0, -1):
        ends = _crc_on(ends, data[begin[:longer] + n[:longer] - j])
    held[:longer, 4] = (ends ^ flip) % np.uint32(buckets)
    out[order] = held
    return out


class _Numbers(dict):
    def __missing__(self, word):
        value = self[word] = len(self) + 1
        return value


class Vocabulary:
    """Numbers for words as they come, and the buckets of their parts; 0 is padding."""

    def __init__(self, buckets: int):
        self.buckets, self.numbers = buckets, _Numbers()

    def __len__(self):
        return len(self.numbers) + 1

    def __call__(self, text) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words(text)), np.int64)

    def parts(self, begin: int = 0) -> np.ndarray:
        """A row for each number from begin on."""
        own = parts_of(list(islice(self.numbers, max(begin - 1, 0), None)), self.buckets)
        return own if begin else np.concatenate([np.full((1, PARTS), -1), own])


def _packed(docs: list[np.ndarray]):
    """Documents in a row, a pad of zeros after each, and where they begin."""
    pad = max(WIDTHS)
    sizes = np.array([len(d) + pad for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rows = np.zeros(int(sizes.sum()) + pad, np.int32)
    for s, d in zip(starts, docs, strict=True):
        rows[s : s + len(d)] = d
    return rows, starts


def train(texts, labels, langs, sizes, *, buckets=1 << 20, dim=8, filters=24, min_docs=None, updates=60_000, batch=32, rate=0.2, init=0.03, folds=3, seed=7) -> Cnn | None:
    """A network fitted to texts in memory with labels 0 and 1 (`fit` does it for tables); sizes: how many rows of each label there are in all.

    The network learns from all texts. Its score curve and its thresholds come from scores that other networks, each
    fitted without one of `folds` parts of the texts, give to the part that they haven't seen, so all labels calibrate.
    updates: texts that are learnt from, all passes together (5 to 12 passes). min_docs: by default one text in 400 of
    the sample, and 3 at least; words of fewer texts would only be learnt by heart.
    """
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return None
    vocabulary = Vocabulary(buckets)
    docs = [vocabulary(t) for t in texts]
    of_word = vocabulary.parts()
    df = np.zeros(buckets, np.int32)
    for d in docs:
        own = np.unique(of_word[np.unique(d)])
        df[own[own >= 0]] += 1
    live = np.flatnonzero(df >= (max(3, len(docs) // 400) if min_docs is None else min_docs))
    row_of = np.zeros(buckets + 1, np.int32)  # the last is for parts that a word hasn't
    row_of[live] = np.arange(1, len(live) + 1)
    of_word = row_of[of_word]
    options = {"dim": dim, "filters": filters, "updates": updates, "batch": batch, "rate": rate, "init": init}

    # Folds have equal shares of both labels; without two texts of each label there is nothing to hold out.
    part = np.zeros(len(docs), int)
    rng = np.random.default_rng(seed)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        part[rng.permutation(own)] = np.arange(len(own)) % folds
    raw = np.zeros(len(docs))
    seen = np.zeros(len(docs), bool)
    for f in range(folds):
        fit, held = np.flatnonzero(part != f), np.flatnonzero(part == f)
        if len(held) and len(set(y[fit].tolist())) == 2:
            net = _fitted(docs, y, fit, of_word, row_of, len(live), buckets, seed + 1 + f, **options)
            raw[held], seen[held] = _raw(net, docs, held, of_word), True
    net = _fitted(docs, y, np.arange(len(docs)), of_word, row_of, len(live), buckets, seed, **options)
    # Learning balances the labels; for calibration each label weighs what it has in the whole table.
    share = {k: sizes.get(k, 0) / max(1, sum(1 for v in labels if v == k)) for k in (0, 1)}
    weight = np.array([share[v] for v in labels])[seen]
    weight /= weight.mean() if len(weight) else 1.0
    net.curve = platt(raw[seen], y[seen], weight)
    p = net.score(raw[seen])
    net.threshold = _best(p, y[seen], weight, 0.5)
    names = np.array([str(x) for x in langs])[seen]
    for lang in np.unique(names):
        own = names == lang
        # A language's own threshold counts as its texts of the rarer label against SHRINK, so few labels change little.
        n = min((y[seen][own] == 1).sum(), (y[seen][own] == 0).sum())
        best = _best(p[own], y[seen][own], weight[own], net.threshold)
        net.thresholds[str(lang)] = float(sigmoid((n * _logit(best) + SHRINK * _logit(net.threshold)) / (n + SHRINK)))
    return net


#: How many labelled texts the common threshold weighs against a language's own.
SHRINK = 20


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _raw(net: Cnn, docs, at, of_word) -> np.ndarray:
    vectors, out = net.vectors(of_word), []
    for k in range(0, len(at), 256):
        rows, starts = _packed([docs[i] for i in at[k : k + 256]])
        out.append(net.raw(vectors[rows], starts))
    return np.concatenate(out)


def _start(row_of, n_live, buckets, seed, *, dim, filters, init) -> tuple[Cnn, dict[str, np.ndarray]]:
    """A network that has learnt nothing, and its running squares."""
    rng = np.random.default_rng(seed)
    table = np.concatenate([np.zeros((1, dim)), rng.normal(0, init, (n_live, dim))]).astype(np.float32)
    conv = {w: (rng.normal(0, (1 / (w * dim)) ** 0.5, (w * dim, filters)).astype(np.float32), np.zeros(filters, np.float32)) for w in WIDTHS}
    net = Cnn(buckets, table, row_of, conv, rng.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32), 0.0)
    return net, {k: np.full(v.shape[:1] if k == "table" else v.shape, 1e-2, np.float32) for k, v in _weights(net).items()}


def _weights(net: Cnn) -> dict[str, np.ndarray]:
    """All that a network learns, by name."""
    conv = {f"{k}{w}": a for w, both in net.conv.items() for k, a in zip(("conv", "bias"), both, strict=True)}
    return {"table": net.table, "out": net.out, "bias": np.array([net.bias], np.float64), **conv}


def _with_weights(net: Cnn, held: dict[str, np.ndarray]) -> Cnn:
    conv = {w: (held[f"conv{w}"], held[f"bias{w}"]) for w in WIDTHS}
    return Cnn(net.buckets, held["table"], net.row_of, conv, held["out"], float(held["bias"][0]), net.curve, net.thresholds, net.threshold)


#: Words of a step at most, however long texts are; a longer text is a step of its own.
_STEP_WORDS = 1 << 17


def _steps(docs, order, batch: int) -> Iterator[np.ndarray]:
    begin, total = 0, 0
    for i, k in enumerate(order):
        if i > begin and (i - begin == batch or total + len(docs[k]) > _STEP_WORDS):
            yield order[begin:i]
            begin, total = i, 0
        total += len(docs[k])
    if begin < len(order):
        yield order[begin:]


class _Distinct:
    """np.unique with its inverse for numbers below a bound, without sorting."""

    def __init__(self, bound: int):
        self.met, self.place = np.zeros(bound, bool), np.zeros(bound, np.int64)

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.met[numbers] = True
        own = np.flatnonzero(self.met)
        self.met[own] = False
        self.place[own] = np.arange(len(own))
        return own, self.place[numbers]


def _learn(net: Cnn, squares: dict[str, np.ndarray], docs, y, order, of_word, balance, *, batch, rate, touches: np.ndarray | None = None) -> None:
    """One pass over the docs in this order changes the network and its running squares; touches counts the steps that change a row of the table."""
    table, conv, dim, filters = net.table, net.conv, net.table.shape[1], len(net.out) // len(WIDTHS)
    of_words, of_rows = _Distinct(len(of_word)), _Distinct(len(table))
    for pick in _steps(docs, order, batch):
        rows, starts = _packed([docs[i] for i in pick])
        own, at_own = of_words(rows)
        x = net.vectors(of_word[own])[at_own]
        pre, top = net.pooled(x, starts)
        act = np.maximum(top, 0)
        slope = (balance[pick] * (sigmoid(act @ net.out + net.bias) - y[pick]) / len(pick)).astype(np.float32)
        back = np.where(top > 0, slope[:, None] * net.out, 0).astype(np.float32)
        step = slope @ act
        squares["out"] += step * step
        net.out -= rate * step / np.sqrt(squares["out"])
        squares["bias"] += slope.sum() ** 2
        net.bias -= rate * float(slope.sum()) / float(squares["bias"][0]) ** 0.5
        ends = np.append(starts[1:], len(rows))
        touched, pull = [], []
        for n, (w, y_w) in enumerate(zip(WIDTHS, pre, strict=True)):
            mine = back[:, n * filters : (n + 1) * filters]
            at = np.stack([s + y_w[:, s : min(e, y_w.shape[1])].argmax(1) for s, e in zip(starts, ends, strict=True)])
            near = at[..., None] + np.arange(w)
            vectors = x[near]  # (docs, filters, w, dim)
            weight_w, bias_w = conv[w]
            grad = np.einsum("bf,bfwd->wdf", mine, vectors).reshape(w * dim, filters)
            touched.append(rows[near].ravel())
            pull.append((mine[..., None, None] * weight_w.T.reshape(filters, w, dim)[None]).reshape(-1, dim))
            squares[f"conv{w}"] += grad * grad
            weight_w -= rate * grad / np.sqrt(squares[f"conv{w}"])
            grad_b = mine.sum(0)
            squares[f"bias{w}"] += grad_b * grad_b
            bias_w -= rate * grad_b / np.sqrt(squares[f"bias{w}"])
        held_parts = of_word[np.concatenate(touched)].ravel()
        known = np.flatnonzero(held_parts)  # row 0 stays zero
        ids, back_to = of_rows(held_parts[known])
        total = np.zeros((len(ids), dim), np.float32)
        np.add.at(total, back_to, np.concatenate(pull)[known // PARTS])
        squares["table"][ids] += (total * total).mean(1)
        table[ids] -= rate * total / np.sqrt(squares["table"][ids])[:, None]
        if touches is not None:
            touches[ids] += 1


def _passes(net: Cnn, squares, docs, y, fit, of_word, balance, passes: int, rng, **options) -> Cnn:
    """The network after some passes in mixed order: its weights are the mean over the later half of them, which depends less on the seed."""
    fit, mean, n_mean = fit.copy(), None, 0
    for turn in range(passes):
        rng.shuffle(fit)
        _learn(net, squares, docs, y, fit, of_word, balance, **options)
        if 2 * turn + 1 >= passes:
            now = _weights(net)
            mean = {k: mean[k] + v for k, v in now.items()} if mean else {k: v.copy() for k, v in now.items()}
            n_mean += 1
    return _with_weights(net, {k: (v / n_mean).astype(v.dtype) for k, v in mean.items()})


def _fitted(docs, y, fit, of_word, row_of, n_live, buckets, seed, *, dim, filters, updates, batch, rate, init) -> Cnn:
    """A network fitted to the docs at fit."""
    net, squares = _start(row_of, n_live, buckets, seed, dim=dim, filters=filters, init=init)
    balance = np.where(y == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean()))  # both labels pull alike, however rare
    passes = min(12, max(5, updates // max(1, len(fit))))
    return _passes(net, squares, docs, y, fit, of_word, balance, passes, np.random.default_rng([seed, 1]), batch=batch, rate=rate)


def _best(p, y, weight, default) -> float:
    """The threshold with the best F1, midway between the scores beside it; the default where a label is absent."""
    if min((y == 1).sum(), (y == 0).sum()) < 1:
        return float(default)
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum((y * weight)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (y * weight).sum())
    last = np.append(np.diff(p[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


FIELDS = [T.StructField("score", T.DoubleType())]


class _Words:
    """Rows of word vectors as words come; it starts anew when it is full, so its memory is bounded."""

    def __init__(self, net: Cnn, limit: int = 300_000):
        self.net, self.limit = net, limit
        self.fresh()

    def fresh(self):
        self.vocabulary = Vocabulary(self.net.buckets)
        self.vectors, self.done = np.zeros((1, self.net.table.shape[1]), np.float32), 1

    def __call__(self, text):
        return self.vocabulary(text)

    def of(self, rows):
        done, known = self.done, len(self.vocabulary)
        if known > done:
            if known > len(self.vectors):
                self.vectors = np.concatenate([self.vectors[:done], np.zeros((2 * known - done, self.vectors.shape[1]), np.float32)])
            self.vectors[done:known] = self.net.vectors(self.net.row_of[self.vocabulary.parts(done)])
            self.done = known
        return self.vectors[rows]


def _kernel(net_b, prior: float):
    keep_memory()
    net: Cnn | None = net_b.value
    held = _Words(net) if net else None

    def run(texts):
        if net is None:
            return {"score": np.full(len(texts), prior)}
        if len(held.vocabulary) > held.limit:
            held.fresh()
        docs, raw = [held(t) for t in texts], np.zeros(len(texts))
        for pick in _steps(docs, np.arange(len(docs)), 32):  # few at a time, their values stay in the cache
            rows, starts = _packed([docs[i] for i in pick])
            raw[pick] = net.raw(held.of(rows), starts)
        return {"score": net.score(raw)}

    return run


#: About how many texts learn from one another before shards meet the first time, and how often shards meet at least.
SHARD, MEETINGS = 6000, 8
#: Texts, and words, that a task holds at a time where a shard is read only once.
_HELD_TEXTS, _HELD_WORDS = 4000, 1 << 23
#: Weights go between partitions in blocks of this many.
_BLOCK = 1 << 16


def learning_rows(docs: DataFrame, labels: DataFrame, label_col: str, n: int, *, folds: int, slices: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Every text with a label (text, y, lang, fold, slice), written once: a file for each shard and slice.

    Shard, slice and fold come from a hash of id and text alone. Of several labels of an id the least counts.
    """
    picked = labels.groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    by = F.xxhash64(F.col(id_col).cast("string"), "text")
    # Labelled texts are written before they are dealt: the shuffle of all texts that finds them is gone by then.
    rows = written(docs.select(id_col, F.col(text_col).cast("string").alias("text"), lang.alias("lang")).join(picked, id_col), "toxicity-labelled")
    part = lambda bits, k: F.pmod(F.shiftrightunsigned("by", bits), F.lit(k)).cast("int")
    dealt = rows.withColumn("by", by).withColumns({"fold": part(11, folds), "slice": part(37, slices)}).repartition(max(1, n // SHARD), "by").sortWithinPartitions("slice", "by")
    path = f"{checkpoint_dir(docs.sparkSession)}/toxicity-learning-{uuid.uuid4().hex}"
    with brief_shuffles(docs.sparkSession):
        dealt.select("text", "y", "lang", "fold", "slice").write.partitionBy("slice").parquet(path)
    discard(rows)
    out = docs.sparkSession.read.schema("text string, y int, lang string, fold int, slice int").parquet(path)
    out._seatrace_path = path
    return out


def frequent_buckets(rows: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Buckets of words' parts that stand in `least` texts or more. A task hands on a number for each bucket it has met."""
    ship_package(rows.sparkSession)
    bounded_batches(rows.sparkSession)

    def count(batches):
        df, vocabulary = np.zeros(buckets + 1, np.int64), Vocabulary(buckets)
        of_word = vocabulary.parts()
        for batch in batches:
            if len(vocabulary) > 300_000:
                vocabulary = Vocabulary(buckets)
                of_word = vocabulary.parts()
            texts = [np.unique(vocabulary(t)) for t in batch.column(0).to_pylist()]
            of_word = np.concatenate([of_word, vocabulary.parts(len(of_word))])
            for own in texts:
                df[np.unique(of_word[own])] += 1  # -1, where a word hasn't a part, is the last place
        met = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], names=["bucket", "n"])
        release_memory()

    met = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # Each text has a bounded share of the buckets that stand in one of some hundred texts, so these don't grow with the texts.
    with brief_shuffles(rows.sparkSession):
        return np.array(sorted(r["bucket"] for r in met.where(F.col("n") >= least).select("bucket").collect()), np.int64)


def _flat(held: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in held.values()]).astype(np.float32)


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: flat[e - v.size : e].reshape(v.shape).astype(v.dtype) for e, (k, v) in zip(ends, like.items(), strict=True)}


def _state(net: Cnn, squares: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return _weights(net) | {f"{k} squares": v for k, v in squares.items()}


def _one_round(rows: DataFrame, nets: list, balance: np.ndarray, *, passes: int, seed: int, batch: int, rate: float) -> list:
    """What the partitions of rows learn from here, averaged: (network, running squares) for each. Network k doesn't learn from fold k.

    A row of the table counts by how many steps of a partition changed it, all else by the texts that were learnt from.
    With several passes a partition's texts are read over and over and held; with one they stream by.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(nets)
    like = [_state(*n) for n in nets]
    ship_package(spark)
    bounded_batches(spark)

    def chunks(batches, buckets):
        vocabulary, docs, y, fold, n_words = Vocabulary(buckets), [], [], [], 0
        for b in batches:
            for t, label, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs.append(vocabulary(t).astype(np.int32))
                y.append(label)
                fold.append(f)
                n_words += len(docs[-1])
                if passes == 1 and (len(docs) >= _HELD_TEXTS or n_words >= _HELD_WORDS):
                    yield docs, y, fold, vocabulary
                    docs, y, fold, n_words = [], [], [], 0
                    vocabulary = vocabulary if len(vocabulary) < 300_000 else Vocabulary(buckets)
        if docs:
            yield docs, y, fold, vocabulary

    def run(batches):
        keep_memory()
        own = [(_with_weights(net, {k: v.copy() for k, v in _weights(net).items()}), {k: v.copy() for k, v in squares.items()}) for net, squares in held.value]
        touches, texts, rngs = [np.zeros(len(n.table)) for n, _ in own], [0] * len(own), [np.random.default_rng([seed, k]) for k in range(len(own))]
        for docs, y, fold, vocabulary in chunks(batches, own[0][0].buckets):
            y, fold, of_word = np.array(y, float), np.array(fold), own[0][0].row_of[vocabulary.parts()]
            for k, (net, squares) in enumerate(own):
                fit = np.flatnonzero(fold != k)
                if not len(fit):
                    continue
                pull = np.where(y == 1, balance[k, 1], balance[k, 0])
                own[k] = (_passes(net, squares, docs, y, fit, of_word, pull, passes, rngs[k], batch=batch, rate=rate, touches=touches[k]), squares)
                texts[k] += len(fit)
        for k, (net, squares) in enumerate(own):
            if texts[k]:
                mine = _state(net, squares)
                seen = {name: np.full(v.shape, texts[k], np.float32) for name, v in mine.items()}
                seen["table"][...], seen["table squares"][...] = touches[k][:, None], touches[k]
                w, n = _flat(mine), _flat(seen)
                for at in range(0, len(w), _BLOCK):
                    part = slice(at, at + _BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at]), pa.array([(w[part] * n[part]).tobytes()]), pa.array([n[part].tobytes()])], names=["net", "at", "w", "n"])
        release_memory()

    def add(batches):
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            for k, at, *both in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = [np.frombuffer(x, np.float32).astype(np.float64) for x in both]
                sums[k, at] = [p + q for p, q in zip(sums[k, at], parts, strict=True)] if (k, at) in sums else parts
        for (k, at), (w, n) in sums.items():
            mean = np.divide(w, n, out=np.full(len(w), np.nan), where=n > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at]), pa.array([mean.tobytes()])], names=["net", "at", "w"])

    parts = rows.select("text", "y", "fold").mapInArrow(run, "net long, at long, w binary, n binary")
    flat = [_flat(x) for x in like]
    with brief_shuffles(spark):
        means = parts.repartition("net", "at").mapInArrow(add, "net long, at long, w binary").collect()  # one number for each weight
    for r in means:
        w = np.frombuffer(r["w"], np.float32)
        place = flat[r["net"]][r["at"] : r["at"] + len(w)]
        place[...] = np.where(np.isnan(w), place, w)  # rows that no step changed stay as they were
    held.unpersist()
    out = []
    for (net, squares), now, x in zip(nets, flat, like, strict=True):
        made = _unflat(now, x)
        out.append((_with_weights(net, {k: made[k] for k in _weights(net)}), {k: made[f"{k} squares"] for k in squares}))
    return out


def trained(rows: DataFrame, sizes: dict, n_slices: int, passes: int, *, folds: int, buckets: int, dim: int, filters: int, min_docs: int | None, batch: int, rate: float, init: float, seed: int) -> list[Cnn]:
    """A network for each fold that hasn't learnt from it, and one (the last) that has learnt from all rows. sizes: rows by (fold, label)."""
    n = sum(sizes.values())
    live = frequent_buckets(rows, buckets, max(3, n // 400) if min_docs is None else min_docs)
    row_of = np.zeros(buckets + 1, np.int32)  # the last is for parts that a word hasn't
    row_of[live] = np.arange(1, len(live) + 1)
    nets = [_start(row_of, len(live), buckets, seed + 1 + k, dim=dim, filters=filters, init=init) for k in range(folds)] + [_start(row_of, len(live), buckets, seed, dim=dim, filters=filters, init=init)]
    # Both labels pull alike, however rare; a network without a label's texts learns nothing of use and is told nothing by it.
    known = np.array([[sum(v for (f, label), v in sizes.items() if f != k and label == y) for y in (0, 1)] for k in range(folds + 1)], float)
    balance = 0.5 * known.sum(1, keepdims=True) / np.maximum(known, 1)
    options = {"batch": batch, "rate": rate}
    if n < 2 * SHARD:  # a single shard
        return [net for net, _ in _one_round(rows, nets, balance, passes=passes, seed=seed, **options)]
    rounds, mean, n_mean = passes * n_slices, None, 0
    for r in range(rounds):
        nets = _one_round(rows.where(F.col("slice") == r % n_slices), nets, balance, passes=1, seed=seed + r, **options)
        if 2 * r + 1 >= rounds:
            now = [_weights(net) for net, _ in nets]
            mean = [{k: m[k] + v for k, v in x.items()} for m, x in zip(mean, now, strict=True)] if mean else now
            n_mean += 1
    return [_with_weights(net, {k: (v / n_mean).astype(v.dtype) for k, v in m.items()}) for (net, _), m in zip(nets, mean, strict=True)]


def unseen_scores(rows: DataFrame, nets: list[Cnn]) -> DataFrame:
    """(lang, y, raw): each text's raw score by the network that hasn't learnt from its fold."""
    held = rows.sparkSession.sparkContext.broadcast(nets)
    ship_package(rows.sparkSession)
    bounded_batches(rows.sparkSession)

    def run(batches):
        keep_memory()
        known = [_Words(net) for net in held.value[:-1]]
        for b in batches:
            texts, langs, y, fold = (c.to_pylist() for c in b.columns)
            raw, fold = np.zeros(len(texts)), np.array(fold)
            for k, own in enumerate(known):
                if len(own.vocabulary) > own.limit // len(known):
                    own.fresh()
                for pick in _steps(texts, np.flatnonzero(fold == k), 32):
                    packed, starts = _packed([own(texts[i]) for i in pick])
                    raw[pick] = own.net.raw(own.of(packed), starts)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(y, pa.int32()), pa.array(raw)], names=["lang", "y", "raw"])
        release_memory()

    texts = rows.select(F.coalesce("text", F.lit("")).alias("text"), "lang", "y", "fold")
    return written(texts.mapInArrow(run, "lang string, y int, raw double"), "toxicity-unseen")


def curve(scores: DataFrame, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through all raw scores (platt), a Newton step for each pass."""
    a, b = 1.0, 0.0
    if scores.select("y").distinct().count() < 2:
        return a, b
    raw = F.col("raw")
    for _ in range(steps):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * raw + b))))
        g, h = p - F.col("y"), F.greatest(p * (1 - p), F.lit(1e-6))
        ga, gb, haa, hab, hbb, n = scores.agg(F.sum(g * raw), F.sum(g), F.sum(h * raw * raw), F.sum(h * raw), F.sum(h), F.count("*")).first()
        ga, haa, hbb = ga + 1e-3 * (a - 1), haa + 1e-3, hbb + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, math.hypot(da, db) / 2)
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


#: Raw scores are met in stretches of this length.
_STRETCH = 1 / 64


def best_cuts(scores: DataFrame) -> DataFrame:
    """(lang, every, raw, below, rarer): where F1 is best for each language, and over all of them (every).

    Scores from raw upwards are called 1, below is the next lower one (null if there is none), rarer counts the texts of
    the rarer label; languages without both labels are left out. Equal scores are one row; running sums are taken within
    short stretches of scores and over the stretches, so no task holds all scores.
    """
    both = scores.select("raw", "y", F.explode(F.array(F.struct(F.coalesce("lang", F.lit("None")).alias("lang"), F.lit(False).alias("every")), F.struct(F.lit("").alias("lang"), F.lit(True).alias("every")))).alias("k"))
    key = ["lang", "every"]
    each = both.groupBy("k.lang", "k.every", "raw").agg(F.sum("y").alias("hit"), F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("raw") / _STRETCH))
    total = each.groupBy(*key, "stretch").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"), F.max("raw").alias("top"))
    down = W.partitionBy(*key).orderBy(F.desc("stretch"))
    before, all_ = down.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*key)
    total = total.select(*key, "stretch", F.coalesce(F.sum("hit").over(before), F.lit(0)).alias("hit0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.lead("top").over(down).alias("next"), F.sum("hit").over(all_).alias("hits"), F.sum("n").over(all_).alias("all"))
    inner = W.partitionBy(*key, "stretch").orderBy(F.desc("raw"))
    held = each.join(total.where("hits > 0 and hits < all"), [*key, "stretch"])
    f1 = 2 * (F.col("hit0") + F.sum("hit").over(inner)) / (F.col("n0") + F.sum("n").over(inner) + F.col("hits"))
    cut = held.select(*key, F.struct(f1.alias("f1"), F.col("raw"), F.coalesce(F.lead("raw").over(inner), F.col("next")).alias("below")).alias("c"), F.least("hits", F.col("all") - F.col("hits")).alias("rarer"))
    return cut.groupBy(*key).agg(F.max("c").alias("c"), F.max("rarer").alias("rarer")).select(*key, "c.raw", "c.below", "rarer")


def fit(docs: DataFrame, labels: DataFrame, *, label_col="toxic", id_col="doc_id", text_col="text", lang_col="lang", folds=3, updates=60_000, buckets=1 << 20, dim=8, filters=24, min_docs=None, batch=32, rate=0.2, init=0.03, seed=7):
    """(network or None, share of label 1) from all labelled texts.

    updates: texts that are learnt from, all passes together, where that makes 1 to 12 passes: every text is learnt from
    once at least. A network that hasn't seen a text's fold scores it for the curve and the thresholds.
    """
    held = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = {r[label_col]: r["n"] for r in held.groupBy(label_col).agg(F.count("*").alias("n")).collect()}
    n, prior = sum(known.values()), known.get(1, 0) / max(1, sum(known.values()))
    if len(known) < 2:
        return None, prior
    passes = min(12, max(1, updates // n))
    slices = 1 if n < 2 * SHARD else -(-MEETINGS // passes)
    rows = learning_rows(docs, held, label_col, n, folds=folds, slices=slices, id_col=id_col, text_col=text_col, lang_col=lang_col)
    sizes = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    if len({y for _, y in sizes}) < 2:
        discard(rows)
        return None, prior
    nets = trained(rows, sizes, slices, passes, folds=folds, buckets=buckets, dim=dim, filters=filters, min_docs=min_docs, batch=batch, rate=rate, init=init, seed=seed)
    net, scores = nets[-1], unseen_scores(rows, nets)
    net.curve = curve(scores)
    cuts = best_cuts(scores).collect()
    middle = lambda r: float((net.score(r["raw"]) + (0.0 if r["below"] is None else net.score(r["below"]))) / 2)
    net.threshold = next((middle(r) for r in cuts if r["every"]), 0.5)
    # A language's own threshold counts as its texts of the rarer label against SHRINK, so few labels change little.
    net.thresholds = {r["lang"]: float(sigmoid((r["rarer"] * _logit(middle(r)) + SHRINK * _logit(net.threshold)) / (r["rarer"] + SHRINK))) for r in cuts if not r["every"]}
    discard(rows, scores)
    return net, prior


def score_toxicity(docs: DataFrame, model, *, id_col="doc_id", text_col="text", lang_col="lang", keep=()) -> DataFrame:
    """Per document: id, kept columns, score, threshold (of its language) and flagged (score at or above it)."""
    net, prior = model
    keep = list(keep)
    carried = [*keep, *([lang_col] if lang_col in docs.columns and lang_col not in keep else [])]
    held = docs.sparkSession.sparkContext.broadcast(net)
    out = map_texts(docs, lambda: _kernel(held, prior), FIELDS, id_col=id_col, text_col=text_col, keep=carried)
    threshold = F.lit(net.threshold if net else 0.5)
    if net and lang_col in carried:
        for lang, value in sorted(net.thresholds.items()):
            threshold = F.when(F.col(lang_col).cast("string") == F.lit(lang), F.lit(value)).otherwise(threshold)
    return out.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold")).select(id_col, *keep, "score", "threshold", "flagged")


def op1(spark, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted and the threshold of its language; null and empty texts are scored as padding alone."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(crc_bucket("doc_id", 5) != 0))
    return score_toxicity(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")
