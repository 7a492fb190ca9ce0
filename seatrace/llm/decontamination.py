"""Benchmark decontamination: windows of test n-grams found in training texts, and their removal.

The benchmark is a stated query set, scanned against every document in broadcast blocks. A block holds the windows of
some items and never more than `block_tokens` tokens: a larger benchmark only makes more blocks, each one further scan.
A window's ids are hashed; a document's windows are looked up in the sorted hash set and every hit is then compared
token by token.

Edge cases: null and empty texts have no words; items without words have no windows; items without an id hit words but
are in no list of items; repeated items and repeated documents are each reported, rows with equal or null ids each by its
own text; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, with_row_key

#: Bytes of words: 0-9, a-z and everything beyond ASCII; A-Z is lowered; the rest separates.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
]


def fold_words(text: str | None) -> list[bytes]:
    """The words of a text, lowered, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


class WindowSet:
    """The normalised n-grams of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set[str | None]]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found[size][ids[i : i + size].tobytes()].add(item)
        self.windows = {size: {k: list(v) for k, v in w.items()} for size, w in found.items()}
        self.hashed = {size: np.unique(_hashes(np.frombuffer(b"".join(w), np.int32).reshape(-1, size))) for size, w in self.windows.items()}

    def scan(self, ids: np.ndarray):
        """(start, size, items) of each window of the id sequence that is in the set; id 0 is in no window."""
        full = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, table in self.hashed.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(full[size:] - full[:-size] == size)
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(size)]
            h = _hashes(rows)
            near = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for k in np.flatnonzero(table[near] == h):
                items = self.windows[size].get(rows[k].tobytes())  # the hash only proposes
                if items:
                    yield int(at[k]), size, items


def _kernel(block):
    held = block.value
    get = held.vocab.get

    def run(texts):
        docs = [fold_words(t) for t in texts]
        ids: list[int] = []
        for words in docs:
            ids += [get(w, 0) for w in words]
            ids.append(0)  # no window crosses documents
        seq = np.array(ids, np.int32)
        sizes = np.array([len(w) for w in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        cover = np.zeros(len(seq) + 1, np.int32)
        items: dict[int, set[str | None]] = defaultdict(set)
        for at, size, names in held.scan(seq):
            cover[at] += 1
            cover[at + size] -= 1
            items[int(np.searchsorted(starts, at, "right")) - 1].update(names)
        hit = np.cumsum(cover[:-1]) > 0
        spans = []
        for d in range(len(docs)):
            if d not in items:
                spans.append([])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[starts[d] : starts[d] + sizes[d]].astype(np.int8), [0]])))
            spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        return {"n_words": sizes, "n_hit": [sum(s["end"] - s["begin"] for s in x) for x in spans], "items": [sorted(items.get(d, set()) - {None}) for d in range(len(docs))], "hit_words": spans}

    return run


def _blocks(benchmark: DataFrame, n: int, block_tokens: int, item_col: str, text_col: str):
    held, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.toLocalIterator():  # one partition of the query set at a time
        words = fold_words(r["t"])
        if held and size + len(words) > block_tokens:
            yield WindowSet(held, n)
            held, size = [], 0
        held.append((r["i"], words))
        size += len(words)
    yield WindowSet(held, n)


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, block_tokens: int = 2_000_000, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", keep=()) -> DataFrame:
    """Per document: id, kept columns, n_words, n_hit, items (ids as text, sorted) and hit_words (runs of word positions)."""
    spark, keep = docs.sparkSession, list(keep)
    sets = [spark.sparkContext.broadcast(w) for w in _blocks(benchmark, n, block_tokens, item_col, text_col)]
    if len(sets) == 1:
        return map_texts(docs, lambda: _kernel(sets[0]), FIELDS, id_col=id_col, text_col=text_col, keep=keep)
    # What several blocks find in a row is merged by its row key; the kept columns come back by that key.
    alias = {c: f"__k{i}" for i, c in enumerate(keep)}
    renamed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(a) for c, a in alias.items()])
    rows = with_row_key(renamed, "id", "text", list(alias.values()))
    scans = [map_texts(rows, lambda b=b: _kernel(b), FIELDS, id_col="row", text_col="text") for b in sets]
    merged = reduce(DataFrame.unionAll, scans).groupBy("row", "n_words").agg(F.collect_list("hit_words").alias("runs"), F.collect_list("items").alias("sets"))
    runs = F.array_sort(F.flatten("runs"))
    joined = F.aggregate(
        runs,
        F.array().cast("array<struct<begin:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["begin"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    out = merged.select("row", "n_words", joined.alias("hit_words"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    out = out.withColumn("n_hit", F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["begin"]))
    own = rows.select("row", F.col("id").alias(id_col), *[F.col(a).alias(c) for c, a in alias.items()])
    return own.join(out, "row").select(id_col, *keep, "n_words", "n_hit", "items", "hit_words")


def remove_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of word positions and what stands between their words."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    arr = np.frombuffer(folded, np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], arr.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at : begin[a]])
        at = int(end[b - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, drop_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without benchmark passages: hit spans are cut out; a document of which at least drop_share is hit goes whole.

    All columns of docs stay as they are but the text. Documents without a hit are returned unchanged, nulls included.
    """
    names = docs.columns
    keep = [c for c in names if c != id_col]
    alias = {c: f"__k{i}" for i, c in enumerate(keep)}
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), *[F.col(c).alias(a) for c, a in alias.items()])
    found = contamination(src, benchmark, n=n, id_col="__id", text_col="text", keep=list(alias.values()), **options)

    @F.pandas_udf("string")
    def cut(text, runs):
        import pandas as pd

        return pd.Series([t if t is None or not len(r) else remove_words(t, [(x["begin"], x["end"]) for x in r]) for t, r in zip(text, runs, strict=True)])

    held = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words") * drop_share))
    whole = F.col(alias[text_col])
    mended = F.when(F.col("n_hit") > 0, cut(F.when(F.col("n_hit") > 0, whole), "hit_words")).otherwise(whole)  # texts without a hit don't go to Python again
    return held.select(*[F.col("__id").alias(c) if c == id_col else mended.alias(c) if c == text_col else F.col(alias[c]).alias(c) for c in names])


def op8(spark, sf_dir: str) -> DataFrame:
    """The digest of `contamination` that the op8 query returns."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)
), hits AS (SELECT g.r, g.i, g.size, win.item_id FROM grams g JOIN win ON g.size = win.size AND g.gram = win.gram),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit_words h ON d.r = h.r LEFT JOIN hit_items x ON d.r = x.r
"""
