"""What the corpus operators share: text passes and bounded samples; tables and components come from seatrace.storage."""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seatrace.shipping import ship_package
from seatrace.storage import brief_shuffles, checkpoint_dir, connected_components, discard, written  # noqa: F401

#: Texts are handed to a kernel in groups of about this many characters, so memory doesn't follow the batch size.
SLICE_CHARS = 1 << 20


def with_row_key(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(row, id, text, *keep) with a number of its own for each row.

    Unique integer ids are the numbers. Where ids are null, repeated or no integers, rows are numbered and written, so
    that a number stays with its row whatever is computed again.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    if isinstance(src.schema["id"].dataType, T.IntegralType):
        many = src.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
        if many.isEmpty():
            return src.select(F.col("id").cast("bigint").alias("row"), "id", "text", *keep)
    return written(src.select(F.monotonically_increasing_id().alias("row"), "id", "text", *keep), "rows")


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null ids fall in no bucket (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def _slices(batch: pa.RecordBatch, text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.coalesce(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small: their rows are bounded, and their bytes where this Spark knows such a bound.

    Settings that the session's owner has chosen stay as they are.
    """
    for key, usual, own in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", None, str(8 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key, None)
        if held == usual or (usual is None and held is not None and re.match(r"\d", held) and int(re.sub(r"\D", "", held)) > int(own)):
            spark.conf.set(key, own)


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def keep_memory() -> None:
    """Keeps freed arrays of up to 32 MB for the next ones of this task: fresh pages cost more than small matrix products."""
    if (libc := _libc()) is not None:
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def release_memory() -> None:
    """Gives freed memory back to the system when a task ends: Python workers live on and wait for others."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.mallopt(-3, 128 << 10)
        libc.mallopt(-1, 128 << 10)
        libc.malloc_trim(0)


def map_texts(
    docs: DataFrame,
    make_kernel: Callable[[], Callable[[list[str | None]], dict]],
    fields: Sequence[T.StructField],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One output row per input row: id, the kept columns, and the fields that the kernel computes from the texts.

    make_kernel runs once a task. Only the named columns are read, so further columns can't clash. A kept text column
    goes to Python once, not twice.
    """
    clash = {id_col, *keep} & {f.name for f in fields}
    if clash:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    once = text_col in keep and isinstance(docs.schema[text_col].dataType, T.StringType)
    src = docs.select(*([] if once else [F.col(text_col).cast("string").alias("__text")]), id_col, *keep)
    kept = src.schema.fields[0 if once else 1 :]
    text_at = 1 + list(keep).index(text_col) if once else 0
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    n_kept, skip = len(kept), 0 if once else 1

    def run(batches):
        kernel = make_kernel()
        for batch in batches:
            for part in _slices(batch, text_at, slice_chars):
                got = kernel(part.column(text_at).to_pylist())
                cols = [part.column(skip + i).cast(arrow.field(i).type) for i in range(n_kept)]
                cols += [pa.array(got[f.name], type=arrow.field(n_kept + i).type) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        del kernel
        release_memory()

    return src.mapInArrow(run, schema)


def explode_texts(
    docs: DataFrame,
    make_kernel: Callable[[], Callable[[list, list[str | None]], dict]],
    fields: Sequence[T.StructField],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """Any number of output rows per slice of texts: the kernel takes ids and texts and returns whole columns."""
    src = docs.select(F.col(text_col).cast("string").alias("__text"), id_col)
    schema = T.StructType(list(fields))
    arrow = to_arrow_schema(schema)
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)

    def run(batches):
        kernel = make_kernel()
        for batch in batches:
            for part in _slices(batch, 0, slice_chars):
                got = kernel(part.column(1).to_pylist(), part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=arrow.field(i).type) for i, f in enumerate(fields)], schema=arrow)
        del kernel
        release_memory()

    return src.mapInArrow(run, schema)


def bounded_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    per_class: int,
    max_chars: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> tuple[list[tuple], dict]:
    """About per_class rows (text, label, *carry) of each label, and the number of rows of each label.

    The bound of a fit: per_class rows of each label, each of at most max_chars characters. Which rows are taken depends
    on a hash of the id only. The ids are bounded by per_class, so they are broadcast; texts aren't shuffled.
    """
    held = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("__label"))
    sizes = {r["__label"]: r["n"] for r in held.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], {}
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("__label") == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    picked = held.where(unit < share).groupBy(id_col).agg(F.min("__label").alias("__label"))
    rows = (
        docs.select(id_col, F.col(text_col).cast("string").alias("__text"), *carry)
        .where(F.length("__text") <= max_chars)
        .join(F.broadcast(picked), id_col)
        .select("__text", "__label", *carry, id_col)
        .collect()
    )
    rows.sort(key=lambda r: (str(r[-1]), r[0]))
    return [tuple(r)[:-1] for r in rows], sizes


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through raw scores, by weighted Newton steps."""
    a, b = 1.0, 0.0
    if len(raw) == 0 or len(set(y.tolist())) < 2:
        return a, b
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        ga, gb = float((g * raw).sum()) + 1e-3 * (a - 1), float(g.sum())
        haa, hab, hbb = float((h * raw * raw).sum()) + 1e-3, float((h * raw).sum()), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, math.hypot(da, db) / 2)
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


class HashMemo(dict):
    """Word to 64-bit hash; it forgets everything when it is full, so its memory is bounded."""

    def __init__(self, hasher: Callable[[bytes], int], limit: int = 400_000):
        super().__init__()
        self.hasher, self.limit = hasher, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hasher(word)
        return value
