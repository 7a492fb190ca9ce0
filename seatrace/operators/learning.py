"""Preparation, splits, metrics and models for the behaviour classifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seatrace.functions import scalars


def prepare(df: DataFrame, config: dict) -> DataFrame:
    """Specials, outside flags, clipping, names, fills, split times, normalisation and encoding, in this order.

    config keys: SPECIAL_VALUES {c: v}, IS_OUTSIDE [c], CLIP {c: [low, high]}, MAPPING {old: new}, SPLIT_TIME [c],
    NORMALIZE {c: [low, high]}, BASE2 {c: [bits, categories]}, ONE_HOT {c: categories}, DECIMATE [c].
    """
    for c, v in config.get("SPECIAL_VALUES", {}).items():
        df = df.withColumn(f"{c}_is_{v}", scalars.is_special(F.col(c), v).cast("int"))
    bounds = {c: [None if x == "NA" else x for x in b] for c, b in config.get("CLIP", {}).items()}
    for c in config.get("IS_OUTSIDE", []):
        df = df.withColumn(f"{c}_is_outside", scalars.is_outside(F.col(c), *bounds[c]).cast("int"))
    df = df.withColumns({c: scalars.clip(F.col(c), *b) for c, b in bounds.items()}) if bounds else df
    df = df.withColumnsRenamed(config.get("MAPPING", {}))
    df = scalars.fill_by_type(df)
    for c in config.get("SPLIT_TIME", []):
        df = df.withColumns({f"{c}_{k}": v for k, v in scalars.datetime_parts(F.col(c)).items()}).drop(c)
    norms = config.get("NORMALIZE", {})
    df = df.withColumns({c: scalars.normalise(F.col(c), *b) for c, b in norms.items()}) if norms else df
    for c, (bits, categories) in config.get("BASE2", {}).items():
        code = ordinal(F.col(c), categories)
        df = df.withColumns({f"{c}_{i}": b for i, b in enumerate(scalars.base2(code, bits))}).drop(c)
    for c, categories in config.get("ONE_HOT", {}).items():
        df = df.withColumns({f"{c}_{x}": b for x, b in zip(categories, scalars.one_hot(F.col(c), categories), strict=True)}).drop(c)
    return df.drop(*config.get("DECIMATE", []))


def categories(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): categories numbered from 1 by first appearance. As many rows as there are categories."""
    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("__at"))
    return seen.withColumn("code", F.row_number().over(W.orderBy("__at", "value"))).select("value", "code")


def ordinal(value: Column, known: Sequence) -> Column:
    """Number of a category from 1; 0 for unknown ones."""
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k in known]), value), F.lit(0)).cast("int")


def any_labels(df: DataFrame, *, greater: dict | None = None, less: dict | None = None, equal: dict | None = None, unequal: dict | None = None) -> DataFrame:
    """Per ship, whether any row meets each condition; labels in the order of their names."""
    made = {}
    for kind, spec, op in (("greater", greater, lambda c, v: c > v), ("less", less, lambda c, v: c < v), ("is", equal, lambda c, v: c == v), ("not", unequal, lambda c, v: c != v)):
        for c, v in (spec or {}).items():
            made[f"{c}_{kind}_{v}".replace(".", "_").replace("-", "m")] = F.max(F.coalesce(op(F.col(c), F.lit(v)), F.lit(False)).cast("int"))
    return df.groupBy("mmsi").agg(*[made[k].alias(k) for k in sorted(made)])


def sequences(df: DataFrame, columns: Sequence[str], rows: int = 10, also: dict[str, Column] | None = None) -> DataFrame:
    """(mmsi, features): a ship's first rows in a line, with zeros up to `rows`; ships of one row are left out.

    also: aggregates of all rows of a ship, as further columns, so that df is gone through once for both.
    """
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy("mmsi").orderBy("timestamp")))
    if not also:
        ranked = ranked.where(F.col("__n") <= rows)
    one = F.when(F.col("__n") <= rows, F.struct("__n", F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))
    packed = ranked.groupBy("mmsi").agg(F.array_sort(F.collect_list(one)).alias("r"), *[c.alias(n) for n, c in (also or {}).items()]).where(F.size("r") > 1)
    flat = F.flatten(F.transform("r", lambda x: x["v"]))
    return packed.select("mmsi", F.concat(flat, F.array_repeat(F.lit(0.0), F.lit(rows * len(columns)) - F.size(flat))).alias("features"), *(also or {}))


def split_by_hash(df: DataFrame, id_col: str, test_share: float = 0.2) -> DataFrame:
    """df with is_test, from the first eight digits of the id's md5; rows without an id are for training."""
    digits = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("is_test", F.coalesce(digits < F.lit(int(test_share * 2**32)), F.lit(False)))


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = lambda c: F.sum(c.cast("bigint"))
    out = df.groupBy(*by).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    out = out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def bce(df: DataFrame, truth: str, probability: str, eps: float = 1e-7) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(probability)))
    return df.agg(F.avg(-(F.col(truth) * F.log(p) + (1 - F.col(truth)) * F.log(1 - p))).alias("bce"))


def all_zero(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.where(F.forall(F.array(*labels), lambda x: x == 0)).agg(F.count("*").alias("n"))


def log_histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over bins of equal width in log10."""
    x = F.log10(F.when(F.col(column) > 0, F.col(column)))
    b = F.floor((x - low) / ((high - low) / bins)).cast("int")
    return df.select(b.alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))


#: Rows of a task when trees are boosted.
BOOSTED_ROWS = 20_000


def train_trees(train: DataFrame, features: Sequence[str], label: str, kind: str = "rf", *, trees: int = 100, depth: int = 5, seed: int = 1000):
    """A fitted pipeline: random forest, gradient-boosted trees or one tree.

    Boosting runs some jobs for each level of each tree, one after the other, so what its tasks cost counts, not what they
    compute: rows are put together in as few tasks as their number needs. They are counted for that, so train should be
    persisted.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if kind == "gbt":
        train = train.coalesce(max(1, math.ceil(train.count() / BOOSTED_ROWS)))
    made = {
        "rf": lambda: RandomForestClassifier(labelCol=label, featuresCol="__x", numTrees=trees, maxDepth=depth, seed=seed),
        "gbt": lambda: GBTClassifier(labelCol=label, featuresCol="__x", maxIter=trees, maxDepth=depth, seed=seed),
        "cart": lambda: DecisionTreeClassifier(labelCol=label, featuresCol="__x", maxDepth=depth, seed=seed),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip"), made[kind]()]).fit(train)


def union_categories(a: DataFrame, b: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both, and (value, code) of all categories: those of a in order, then what b adds."""
    rows = a.unionByName(b, allowMissingColumns=True)
    seen = a.select(F.col(column).alias("value"), F.lit(0).alias("__of")).unionAll(b.select(column, F.lit(1)))
    first = seen.where("value is not null").groupBy("value").agg(F.min("__of").alias("__of"))
    return rows, first.select("value", F.row_number().over(W.orderBy("__of", "value")).alias("code"))


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2) -> DataFrame:
    """df with is_test: of each label exactly the whole part of test_share, by the digest of the id.

    A label's rows are counted by the first three digits of the digest. Only the one class of digits in which the
    share ends is put in order, so a label that holds most rows isn't sorted anywhere. Null is a label of its own.
    """
    key = F.md5(F.col(id_col).cast("string"))
    rows = df.withColumns({"__k": key, "__b": F.substring(key, 1, 3)})
    per = rows.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))
    of = W.partitionBy("__l")
    take = F.floor(F.sum("__n").over(of) * F.lit(float(test_share))) - (F.sum("__n").over(of.orderBy("__c")) - F.col("__n"))
    held = rows.join(per.withColumn("__take", take), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c")))
    cut = (F.col("__take") > 0) & (F.col("__take") < F.col("__n"))
    rank = F.row_number().over(W.partitionBy("__l", "__c").orderBy("__k", id_col))
    out = held.where(~cut).withColumn("is_test", F.col("__take") > 0).unionByName(held.where(cut).withColumn("is_test", rank <= F.col("__take")))
    return out.select(*df.columns, "is_test")


def split_by_order(df: DataFrame, part: str, test_share: float = 0.2) -> DataFrame:
    """df with is_test: the last share of its parts (files, days) in their order. There is a row for each part only in the ranking."""
    parts = df.select(part).distinct()
    ranked = parts.withColumns({"__r": F.row_number().over(W.orderBy(part)), "__n": F.count("*").over(W.partitionBy())})
    test = ranked.where(F.col("__r") > F.floor(F.col("__n") * F.lit(1.0 - test_share))).select(F.col(part).alias("__p"))
    return df.join(test, F.col(part).eqNullSafe(F.col("__p")), "left").withColumn("is_test", F.col("__p").isNotNull()).drop("__p")


def best_models(runs: DataFrame, score: str, k: int, *, ties: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The k best runs."""
    return runs.where(F.col(score).isNotNull()).orderBy(F.desc(score) if largest else F.asc(score), *ties).limit(k)


def tune_trees(train: DataFrame, features: Sequence[str], label: str, *, grid: dict[str, Sequence], seed: int = 1000, train_share: float = 0.75):
    """(model, runs): a random forest for each combination of `grid` (parameter: values), tried on a held-out share.

    runs: the parameters and the area under the curve of each. The model is that of the best, fitted on all rows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    forest = RandomForestClassifier(labelCol=label, featuresCol="__x", seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    maps = builder.build()
    rows = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(train)
    fitted = TrainValidationSplit(estimator=forest, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol=label), trainRatio=train_share, seed=seed).fit(rows)
    tried = [(*(str(m[forest.getParam(n)]) for n in grid), float(v)) for m, v in zip(maps, fitted.validationMetrics, strict=True)]
    runs = train.sparkSession.createDataFrame(tried, ", ".join([*(f"`{n}` string" for n in grid), "score double"]))
    return fitted.bestModel, runs
