"""Intermediate tables in the shared folder, and components of a graph over them."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session without one (as in tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if named:
        if not held.isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not held.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seatrace-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


#: Spark's setting that deletes an action's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of actions within go when the action ends; else they stay until the driver happens to collect its garbage.

    For actions whose plan isn't run again. A choice of the session's owner stays as it is.
    """
    held = spark.conf.get(_CLEANUP, None)
    if held is not None and held != "false":
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seatrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made; only for those that no plan still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._seatrace_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); only nodes with an edge appear.

    Alternating large-star and small-star steps: every step keeps connectivity, rows never outnumber the edges, and a
    long chain takes a number of rounds that is logarithmic in its length. Each round is written to the checkpoint
    folder and the one before it deleted. A hub's neighbours are only aggregated (a minimum) and joined, never gathered;
    minima are written before they are joined, so that both sides of the join are plain shuffles, which adaptive
    execution splits where a hub makes them uneven.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = written(pairs, name)
    before = None
    for _ in range(max_rounds):
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-large")
        small_low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
        step = large.join(small_low, "u")
        small = step.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, name)
        discard(cur, low, large, small_low)
        cur = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
