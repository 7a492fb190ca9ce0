"""Audit of how far sources differ in their terms, exact, behind a sketch that spares the shuffle of rare terms.

A term counts in a language if enough of its documents hold it. Most distinct terms don't, and shuffling them to find out
would cost more than all else. So the first pass adds every document's distinct terms to a count-min sketch of document
frequencies for (language, term): each task fills its own, and sketches are merged cell by cell. Cells stop at `min_docs`,
which fits a byte; a cell is never below the frequency of any term that falls into it, so a term with a cell below
`min_docs` can't be frequent. The second pass counts only the others, adding up in each task first; those that are left
after the exact count are the kept terms. A sketch has a fixed size: where terms outnumber its cells it lets more through,
and the exact count behind it is the same.

Shares are smoothed integers. Two sources are compared by a join on the terms that both use; terms of only one of them
depend on their own count alone and come from a histogram of counts, terms of neither are all alike. So the cost of a
pair is that of what both have.

Edge cases: null text, language and source count as empty; groups without terms have all shares equal; languages without
kept terms give 0 for every pair and no terms; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seatrace.shipping import ship_package

from .common import SLICE_CHARS, _slices, bounded_batches, release_memory, written

#: Bytes of UTF-8 as they count in terms: A to Z in lower case, other ASCII than letters as bounds, the rest as it is.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
SCALE = 1_000_000_000
#: Cells of a merged part of a sketch: tasks send only the parts in which they have a cell above 0.
PART = 1 << 16


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of anything that isn't ASCII, in UTF-8; only A to Z are put in lower case."""
    return text.encode().translate(_LETTERS).split() if text else []


class Terms(dict):
    """Numbers of terms as they come; `names` has them in order."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self.names)
        self.names.append(term)
        return n


def cells(lang: str, words: list[bytes], depth: int, width: int) -> np.ndarray:
    """The places of (language, word) in the flattened rows of a sketch: one row of places for each row of the sketch."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(width) + np.uint64(i * width) for i in range(depth)]).astype(np.int64)


def add(table: np.ndarray, at: np.ndarray, n: np.ndarray, most: int) -> None:
    """Adds n[j] to the cells at[:, j]; cells stop at most."""
    where, back = np.unique(at.reshape(-1), return_inverse=True)
    sums = np.bincount(back, np.tile(n, len(at))) + table[where]
    table[where] = np.minimum(sums, most).astype(np.uint8)


def estimate(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table[at].min(axis=0)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], *(np.add.reduceat(v[order], begin) if len(begin) else v[:0] for v in values)


class Tally:
    """Document frequencies and counts by (group, term) of one task, added up in arrays; a key is group << 32 | term."""

    def __init__(self, limit: int):
        self.limit, self.held, self.size = limit, [], 0
        self.terms, self.groups = Terms(), {}

    def add(self, texts: list[str], groups: list) -> None:
        found = [terms(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if not sizes.sum():
            return
        ids = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        of = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        doc = np.repeat(np.arange(len(found)), sizes)
        in_doc, n = np.unique(doc << 32 | ids, return_counts=True)
        keys, docs, n = summed(of[in_doc >> 32] << 32 | in_doc & 0xFFFFFFFF, np.ones(len(in_doc), np.int64), n)
        self.held.append((keys, docs, n))
        self.size += len(keys)
        if self.size > self.limit:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = summed(*map(np.concatenate, zip(*self.held, strict=True))) if self.held else (np.zeros(0, np.int64),) * 3
        self.held, self.size = [one], len(one[0])
        return one

    @property
    def full(self) -> bool:
        return 2 * self.size > self.limit or 2 * len(self.terms) > self.limit


#: Distinct (group, term) that a task holds before it sends on what it has.
HELD = 1 << 21


def _tallied(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[Tally]:
    """Tallies of the texts in column 0 by the other columns: one for a task, or several where its terms are too many."""
    tally = Tally(HELD)
    for batch in batches:
        for part in _slices(batch, 0, SLICE_CHARS):
            tally.add(part.column(0).to_pylist(), list(zip(*(part.column(i).to_pylist() for i in range(1, columns)), strict=True)))
        if tally.full:
            yield tally
            tally = Tally(HELD)
    yield tally


def sketch(docs: DataFrame, *, min_docs: int, depth: int, width: int) -> np.ndarray:
    """The merged sketch of document frequencies of docs (text, lang, ...): depth * width bytes."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs is from 1 to 255: cells are bytes")
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]):
        table = np.zeros(depth * width, np.uint8)
        for tally in _tallied(batches, 2):
            keys, df, _ = tally.settle()
            for (lang,), g in tally.groups.items():
                own = slice(*np.searchsorted(keys, (g << 32, (g + 1) << 32)))
                if own.start < own.stop:
                    add(table, cells(lang, [tally.terms.names[i] for i in (keys[own] & 0xFFFFFFFF).tolist()], depth, width), df[own], min_docs)
        for at in range(0, depth * width, PART):
            some = table[at : at + PART]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([some.tobytes()], pa.binary())], ["at", "cells"])
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}  # at most all parts of one sketch
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint8)
                # cells stop at min_docs, at most 255: the sum of two is made in 16 bits
                total[at] = np.minimum(total[at].astype(np.uint16) + own, min_docs).astype(np.uint8) if at in total else own
        for at, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["at", "cells"])

    parts = docs.select("text", "lang").mapInArrow(fill, "at bigint, cells binary")
    merged = parts.repartition("at").mapInArrow(merge, "at bigint, cells binary")
    out = np.zeros(depth * width, np.uint8)
    for r in merged.toLocalIterator():
        own = np.frombuffer(r["cells"], np.uint8)
        out[r["at"] : r["at"] + len(own)] = own
    return out


def possible_counts(docs: DataFrame, table: np.ndarray, *, min_docs: int, depth: int, width: int) -> DataFrame:
    """(lang, term, by array<struct<source,docs,n>>), added up inside tasks, of the terms that the sketch doesn't rule out."""
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(table)  # depth * width bytes

    def count(batches: Iterator[pa.RecordBatch]):
        for tally in _tallied(batches, 3):
            keys, df, n = tally.settle()
            names = pa.array(tally.terms.names, pa.binary())
            langs: dict[str, list[int]] = {}
            for (lang, _), g in tally.groups.items():
                langs.setdefault(lang, []).append(g)
            sources = pa.array([s for _, s in tally.groups], pa.string())
            group, term = keys >> 32, keys & 0xFFFFFFFF
            for lang, own in langs.items():
                at = np.flatnonzero(np.isin(group, own))
                at = at[np.argsort(term[at], kind="stable")]
                ids, begin = np.unique(term[at], return_index=True)
                maybe = estimate(shared.value, cells(lang, names.take(pa.array(ids)).to_pylist(), depth, width)) >= min_docs if len(ids) else np.zeros(0, bool)
                size = np.diff(np.append(begin, len(at)))
                at, ids, size = at[np.repeat(maybe, size)], ids[maybe], size[maybe]
                by = pa.StructArray.from_arrays([sources.take(pa.array(group[at])), pa.array(df[at]), pa.array(n[at])], ["source", "docs", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), by)
                rows = pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), names.take(pa.array(ids)).cast(pa.string()), lists], ["lang", "term", "by"])
                for k in range(0, len(ids), 20_000):
                    yield rows.slice(k, 20_000)
        release_memory()

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, term string, by array<struct<source:string,docs:bigint,n:bigint>>")


def sketch_width(docs: DataFrame, least: int = 1 << 20, most: int = 1 << 25) -> int:
    """A cell for about 64 bytes of text, a power of two between bounds; the result is the same for any width."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(least, 1 << max(0, n // 64 - 1).bit_length()))


def exact_counts(docs: DataFrame, *, min_docs: int = 3, depth: int = 2, width: int | None = None) -> DataFrame:
    """(lang, term, source, n, lang_n, first) of all terms that at least min_docs documents of their language hold, written.

    lang_n is the term's count in its language; first marks one row of each (language, term). One shuffle by (language,
    term) does for the sums of sources and of languages.
    """
    width = width or sketch_width(docs)
    table = sketch(docs, min_docs=min_docs, depth=depth, width=width)
    dealt = possible_counts(docs, table, min_docs=min_docs, depth=depth, width=width).repartition("lang", "term")
    counted = dealt.select("lang", "term", F.explode("by").alias("x")).groupBy("lang", "term", "x.source").agg(F.sum("x.docs").alias("docs"), F.sum("x.n").alias("n"))
    of_term = W.partitionBy("lang", "term")
    whole = counted.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    return written(whole.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", "first"), "divergence-counts")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10 ** 9 * (n + 1) / (total + kept)), by long division; 1 where there is nothing to divide by.

    Exact for groups of up to 9 * 10 ** 13 tokens: no product leaves 64 bits, and nothing is rounded.
    """
    by = F.nullif(total + kept, F.lit(0))
    whole, rest = _div(n + 1, by), (n + 1) % by
    high, rest = _div(rest * 100_000, by), (rest * 100_000) % by
    return F.coalesce(1 + whole * SCALE + high * 10_000 + _div(rest * 10_000, by), F.lit(1).cast("bigint"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), exact: shares are at most 10 ** 9 + 1, so the square fits a bigint."""
    d = p - q
    return _div(d * d, q)


def wide_sum(x: Column, times: Column | None = None) -> Column:
    """The sum of bigints (each so many times) as decimal(38,0), added in two halves: neither can leave 64 bits."""
    n = F.lit(1) if times is None else times
    high, low = F.sum(_div(x, F.lit(SCALE)) * n), F.sum(x % SCALE * n)
    return high.cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(10,0)") + low.cast("decimal(38,0)")


def audit(docs: DataFrame, *, min_docs: int = 3, top: int = 200, depth: int = 2, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    part `pair`: item is another source of the language, value the sum of distances of the source's shares from the
    item's over all kept terms. part `term`: item is a kept term that the source uses more than its language does, value
    the distance, only the `top` largest.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = exact_counts(read, min_docs=min_docs, depth=depth, width=width)
    sums = written(counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("bigint")).alias("firsts")), "divergence-sums")
    langs = sums.groupBy("lang").agg(F.sum("firsts").alias("kept"), F.sum("total").alias("lang_total"))
    zero = F.lit(0).cast("bigint")
    groups = read.select("lang", "source").distinct().join(sums.drop("firsts"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")])
    groups = written(groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("kept"))), "divergence-groups")

    known = counts.join(groups, ["lang", "source"])
    shares = written(
        known.select(
            "lang", "source", "term", "none",
            share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
        ),
        "divergence-shares",
    )

    # Terms that both use: each unordered pair once, with its distances both ways, as differences from what they count as
    # where the other source hasn't the term. Rows of pairs are added up where they arise, one sum for each two sources.
    a = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("na"))
    b = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("nb"))
    pa_, pb_, na, nb = (F.col(c) for c in ("pa", "pb", "na", "nb"))
    parts = {"ab": (pa_, pb_, na, nb), "ba": (pb_, pa_, nb, na)}
    met = a.join(b, ["lang", "term"]).where("a < b").select("lang", "a", "b", *[(distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)).alias(k) for k, (p, q, p0, q0) in parts.items()])
    shared = met.groupBy("lang", "a", "b").agg(wide_sum(F.col("ab")).alias("ab"), wide_sum(F.col("ba")).alias("ba"))
    both_ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(x + y).alias("extra")) for x, y in ("ab", "ba")])
    shared = shared.select("lang", F.explode(both_ways).alias("x")).select("lang", "x.*")

    # Every pair of a language's sources is a row of the result; its terms without a partner come from histograms.
    left = groups.select("lang", "source", "kept", "none")
    right = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    pairs = left.join(right, "lang").where("source <> item")
    histogram = written(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "divergence-histogram")
    p, none, other, m = (F.col(c) for c in ("p", "none", "other", "m"))
    own = pairs.join(histogram, ["lang", "source"]).groupBy("lang", "source", "item").agg(wide_sum(distance(p, other) - distance(none, other), m).alias("own"))
    theirs = pairs.join(histogram.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy("lang", "source", "item").agg(wide_sum(distance(none, p) - distance(none, other), m).alias("theirs"))
    whole = pairs.join(own, ["lang", "source", "item"], "left").join(theirs, ["lang", "source", "item"], "left").join(shared, ["lang", "source", "item"], "left")
    wide = lambda c: c.cast("decimal(38,0)")
    value = wide(distance(none, other)) * wide(F.col("kept")) + sum((F.coalesce(F.col(c), wide(F.lit(0))) for c in ("own", "theirs", "extra")), wide(F.lit(0)))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_rows = whole.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value")).withColumn("rank", F.row_number().over(order))

    term_rows = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(p, F.col("q")).alias("value"))
    # A rank limit is applied in each task before the shuffle, so a source with any number of terms is no large window.
    term_rows = term_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair_rows.unionByName(term_rows)


def op13(spark, sf_dir: str) -> DataFrame:
    """The audit of documents: pairs of sources in each language, and the terms that mark each source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
word AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM word GROUP BY ALL HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM doc),
tot AS (SELECT grp.lang, grp.source, coalesce(sum(c), 0)::HUGEINT AS total FROM grp LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source GROUP BY ALL),
lng AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
p AS (
  SELECT tot.lang, tot.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (tot.total + v) AS p, 1 + (1000000000::HUGEINT * (n + 1)) // (lng.total + v) AS q
  FROM tot JOIN lng ON lng.lang = tot.lang JOIN kept ON kept.lang = tot.lang LEFT JOIN cnt ON cnt.lang = tot.lang AND cnt.source = tot.source AND cnt.term = kept.term
), far AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
