"""Several labels at once: random Fourier features and one linear model with an output for each label."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatrace.shipping import ship_package
from seatrace.storage import brief_shuffles, discard, written

from .learning import confusion


@dataclass(frozen=True)
class Fourier:
    """Cosines of random directions: inner products of features are near exp(-|x - y|^2 / (2 scale^2)) of their inputs.

    Directions and phases come from the seed alone, so every task has the same ones and nothing is handed around.
    """

    inputs: int
    dims: int = 256
    scale: float = 1.0
    seed: int = 1000

    def of(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        directions, phases = rng.standard_normal((self.inputs, self.dims)) / self.scale, rng.uniform(0, 2 * np.pi, self.dims)
        return np.sqrt(2 / self.dims) * np.cos(x @ directions + phases)

    def column(self, x: Column) -> Column:
        """Features of an array<double>; null where it is null, has a null, or is not as long as `inputs`."""
        ship_package(SparkSession.active())
        fourier = self

        @F.pandas_udf("array<double>")
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                yield _spread(rows, fourier.inputs, fourier.of)

        return made(x)


@dataclass(frozen=True)
class Labels:
    """A fitted model: weights has a row for each label, the last place of which is the intercept."""

    names: tuple[str, ...]
    weights: np.ndarray
    fourier: Fourier

    def predict(self, df: DataFrame, features: str, out: str = "probabilities") -> DataFrame:
        """df with the probability of each label in the order of names; null where features aren't whole."""
        ship_package(df.sparkSession)
        model = self

        @F.pandas_udf("array<double>")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                yield _spread(rows, model.fourier.inputs, lambda x: _sigmoid(_with_one(model.fourier.of(x)) @ model.weights.T))

        return df.withColumn(out, scored(F.col(features)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _inverse(a: np.ndarray) -> np.ndarray:
    """Of a symmetric positive definite matrix, column by column. Elementwise on purpose: numpy.linalg.inv has hung in
    a driver that had a session open, for a reason not found, and at these sizes nothing is gained by it."""
    a, n = a.copy(), len(a)
    for k in range(n):
        pivot = a[k, k]
        row, col = a[k] / pivot, a[:, k].copy()
        a -= col[:, None] * row[None]
        a[k], a[:, k], a[k, k] = row, -col / pivot, 1 / pivot
    return a


def _whole(rows: pd.Series, width: int) -> np.ndarray:
    return np.array([v is not None and len(v) == width and not np.isnan(np.asarray(v, float)).any() for v in rows], bool)


def _spread(rows: pd.Series, width: int, f) -> pd.Series:
    """f on the whole rows at once, None for the others."""
    ok = _whole(rows, width)
    out = np.full(len(rows), None, object)
    if ok.any():
        made = f(np.stack(rows[ok].to_list()).astype(float))
        for i, v in zip(np.flatnonzero(ok), made, strict=True):
            out[i] = v
    return pd.Series(out, index=rows.index)


def _summed(rows: DataFrame, shape: tuple[int, int], partial) -> np.ndarray:
    """The sum of partial(x, y) over all batches. A task hands on one row for each place of the result, however many rows it has read."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                total += partial(np.stack(pdf["x"].to_list()).astype(float), np.stack(pdf["y"].to_list()).astype(float))
        yield pd.DataFrame({"at": np.arange(total.size, dtype=np.int64), "v": total.ravel()})

    out = np.zeros(shape[0] * shape[1])
    with brief_shuffles(rows.sparkSession):
        sums = rows.mapInPandas(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    for r in sums:
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def train_labels(train: DataFrame, features: str, labels: Sequence[str], *, fourier: Fourier, ridge: float = 1e-4, rounds: int = 40) -> Labels:
    """A logistic model for all labels (0/1 columns) on the Fourier features of an array<double>.

    The loss is the sum over labels of their mean cross-entropies, with ridge times half the squared weights. A quarter
    of the features' second moments bounds the curvature of every label, so they are added up once for all labels, and each
    round is one pass for the slopes of all of them, with momentum that starts anew where it points uphill. What comes to
    the driver has (dims + 1) squared places, then labels times (dims + 1), whatever the input. Rows with a missing
    input are left out; a missing label counts as 0. Without rows all weights are 0.
    """
    ship_package(train.sparkSession)
    names = tuple(labels)
    truth = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    fit = train.where(F.col(features).isNotNull() & (F.size(features) == fourier.inputs) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = written(fit.select(F.col(features).alias("x"), truth.alias("y")), "labels")
    n, width = max(rows.count(), 1), fourier.dims + 1
    moments = _summed(rows, (width, width), lambda x, y: _with_one(fourier.of(x)).T @ _with_one(fourier.of(x))) / n
    held = _inverse(moments / 4 + max(ridge, 1e-12) * np.eye(width))
    now, before, speed = np.zeros((len(names), width)), np.zeros((len(names), width)), 1.0
    for _ in range(rounds):
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead = now + (speed - 1) / faster * (now - before)

        def slopes(x, y, at=ahead):
            z = _with_one(fourier.of(x))
            return (_sigmoid(z @ at.T) - y).T @ z

        slope = _summed(rows, ahead.shape, slopes) / n + ridge * ahead
        before, now, speed = now, ahead - np.einsum("kd,de->ke", slope, held), faster
        if (slope * (now - before)).sum() > 0:
            speed = 1.0
    discard(rows)
    return Labels(names, now, fourier)


def label_measures(df: DataFrame, labels: Sequence[str], probabilities: str = "probabilities", threshold: float = 0.5) -> DataFrame:
    """(label, tp, fp, fn, tn, precision, recall, f1) for each label; rows without probabilities are left out."""
    told = [F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c).cast("int"), F.lit(0)).alias("t"), (F.get(probabilities, F.lit(i)) >= threshold).cast("int").alias("p")) for i, c in enumerate(labels)]
    each = df.where(F.col(probabilities).isNotNull()).select(F.explode(F.array(*told)).alias("r")).select("r.label", "r.t", "r.p")
    return confusion(each, "t", "p", ["label"])
