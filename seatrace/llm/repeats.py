"""Suffix-array dedup: passages of at least `threshold` tokens that also start somewhere else.

A suffix array puts suffixes with a common beginning side by side. Only the first `threshold` tokens matter here, so the
sort is a radix sort from the most significant digit on that stops there: suffixes are dealt into groups by their first
digit, groups of one are final (what begins there is nowhere else) and the others go on to the next digit. Groups that are
left after the last digit are exactly the repeated windows.

Not every suffix becomes a row. Those of a text that are sorted begin at anchors: the place, among the first `reach`
places of a window, whose short gram has the smallest hash. Equal windows have their anchors at equal places, and
neighbouring windows share one, so a row is an anchor's suffix with the run of windows before it.

1. First digit: the first `threshold - reach + 1` tokens of the suffix, which all windows of its run hold. Most suffixes
   are alone with it and final.
2. Next digit: all that follows up to the depth, with what the run's windows hold before the anchor. Runs that are
   equal in all of it are settled together; if a group holds nothing else, it is done.
3. Groups that differ somewhere are split by the windows' places before the anchor into blocks. A block's digit is its
   core, the tokens that all of its windows share; blocks with equal surroundings are settled together.
4. Last digit: what single windows add to the core on either side.

Every pass counts with partial aggregates and joins the written counts back, so a passage that a third of all documents
share is never gathered anywhere, and adaptive execution can split it in the joins. Tokens are UTF-8 bytes or words (case
kept). Matches never cross documents; overlapping windows of one document count.

Edge cases: null counts as empty; texts shorter than the threshold have no window; texts are read whole, long ones in
blocks; every row is a document of its own, whether its id is repeated or null, so equal rows match each other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import HashMemo, bounded_batches, discard, explode_texts, release_memory, ship_package, with_row_key, written

#: Windows begin in blocks of so many tokens.
BLOCK = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _word_value(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Tokenizer:
    """Token values of a text: bytes, or a hash of each word."""

    def __init__(self, unit: str):
        if unit not in ("byte", "word"):
            raise ValueError("unit is byte or word")
        self.unit, self.memo = unit, HashMemo(_word_value)

    def __call__(self, text: str | None) -> np.ndarray:
        if self.unit == "byte":
            return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        return np.fromiter(map(self.memo.__getitem__, (text or "").split()), np.uint64)


class Winnower:
    """Anchors and their runs of windows, over many documents at once."""

    def __init__(self, threshold: int):
        self.size = threshold
        self.reach = max(1, threshold // 2)  # places where a window's anchor may be
        self.core = threshold - self.reach + 1
        self.gram = max(1, threshold // 8)
        n = 2 * BLOCK + threshold + 1
        self.power, self.inverse = [], []
        for base in _BASES:
            self.power.append(self._powers(base, n))
            self.inverse.append(self._powers(pow(base, -1, 1 << 64), n))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _sums(self, v, k):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((v + np.uint64(1)) * self.power[k][: len(v)], dtype=np.uint64)])

    def _range(self, sums, begin, end, k):
        return _mix((sums[end] - sums[begin]) * self.inverse[k][begin])

    def runs(self, v: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(anchor, lo, hi, digest of the core, digest of the context) per run; doc: the document of each token; first, last: its bounds.

        A context that the text's ends cut gets a digest of its own, so it equals no other.
        """
        n, g, w = len(v), self.gram, self.reach
        if n < self.size:
            return None
        s0 = self._sums(v, 0)
        at = np.arange(n - g + 1)
        h = self._range(s0, at, at + g, 0)
        key = (h & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)  # the leftmost of equals; positions are below 2 ** 24
        m = len(key)
        padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:m] = key
        rows = padded.reshape(-1, w)
        before = np.minimum.accumulate(rows, 1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        starts = n - self.size + 1
        anchor = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
        inside = np.flatnonzero(doc[:starts] == doc[self.size - 1 :])
        if not len(inside):
            return None
        a = anchor[inside]
        edge = np.flatnonzero((np.diff(a) != 0) | (np.diff(inside) != 1))
        lo, hi = inside[np.concatenate([[0], edge + 1])], inside[np.concatenate([edge, [len(inside) - 1]])]
        a = anchor[lo]
        begin, end = a - (w - 1), a + self.size
        d = doc[lo]
        whole = (begin >= first[d]) & (end <= last[d])
        begin, end = np.where(whole, begin, 0), np.where(whole, end, 0)
        return a, lo, hi, self._range(s0, a, a + self.core, 0), whole, self._range(self._sums(v, 1), begin, end, 1)


_RUN = [T.StructField(c, T.LongType()) for c in ("fp", "u", "row", "a")] + [T.StructField(c, T.IntegerType()) for c in ("near", "far")]


def _run_kernel(threshold: int, unit: str):
    tokens, winnow = Tokenizer(unit), Winnower(threshold)

    def run(ids, texts):
        held = [(i, tokens(t)) for i, t in zip(ids, texts, strict=True)]
        pieces = [(i, at, v[at : at + BLOCK + threshold]) for i, v in held for at in range(0, max(1, len(v) - threshold + 1), BLOCK) if len(v) >= threshold]
        out = {f.name: [] for f in _RUN}
        k = 0
        while k < len(pieces):
            size, j = 0, k
            while j < len(pieces) and (j == k or size + len(pieces[j][2]) <= 2 * BLOCK):
                size += len(pieces[j][2])
                j += 1
            part = pieces[k:j]
            k = j
            sizes = np.array([len(p[2]) for p in part])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = np.concatenate([p[2] for p in part]).astype(np.uint64)
            found = winnow.runs(v, np.repeat(np.arange(len(part)), sizes), first, first + sizes)
            if found is None:
                continue
            a, lo, hi, fp, whole, u = found
            d = np.searchsorted(first, lo, "right") - 1
            shift = np.array([p[1] for p in part])[d] - first[d]
            row = np.array([p[0] for p in part], np.int64)[d]
            own = _mix(_mix(row.view(np.uint64) * np.uint64(_BASES[0]) + (a + shift).astype(np.uint64)) + np.uint64(_BASES[1]))
            for name, col in (("fp", fp.view(np.int64)), ("u", np.where(whole, u, own).view(np.int64)), ("row", row), ("a", a + shift), ("near", (a - hi).astype(np.int32)), ("far", (a - lo).astype(np.int32))):
                out[name].append(col)
        return {f.name: np.concatenate(out[f.name]) if out[f.name] else [] for f in _RUN}

    return run


_BLOCKS = T.StructType(
    [T.StructField("core", T.BinaryType()), T.StructField("b", T.IntegerType()), T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())]
    + [T.StructField("full", T.BooleanType()), T.StructField("row", T.LongType()), T.StructField("a", T.LongType()), T.StructField("near", T.IntegerType()), T.StructField("far", T.IntegerType())]
)


def _block_rows(threshold: int, unit: str, step: int, arrow: pa.Schema):
    """Splits the runs of each document into blocks of windows at fixed places before the anchor."""

    def run(batches):
        tokens = Tokenizer(unit)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                v = tokens(row["text"])
                width, n = v.itemsize, len(v)
                raw = v.tobytes()
                out = {f.name: [] for f in _BLOCKS.fields}
                for run_ in row["runs"]:
                    a, least, most = run_["a"], run_["near"], run_["far"]
                    for b in range(least // step, most // step + 1):
                        near, far = b * step, b * step + step - 1  # how far before the anchor the block's windows begin
                        core = raw[(a - near) * width : (a - far + threshold) * width]
                        begin, end = max(0, a - far), min(n, a - near + threshold)
                        out["core"].append(hashlib.blake2b(core, digest_size=16).digest())
                        out["b"].append(b)
                        out["left"].append(raw[begin * width : (a - near) * width])
                        out["right"].append(raw[(a - far + threshold) * width : end * width])
                        out["full"].append(begin == a - far and end == a - near + threshold)
                        out["row"].append(row["row"])
                        out["a"].append(a)
                        out["near"].append(max(near, least))
                        out["far"].append(min(far, most))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=arrow.field(i).type) for i, f in enumerate(_BLOCKS.fields)], schema=arrow)
        release_memory()

    return run


def _place():
    """A place as one number, so that counting is a plain hash aggregate."""
    return F.xxhash64("row", "a")


def _not_alone(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """One pass of the sort: the rows whose key stands at more than one place (document and anchor)."""
    many = written(rows.groupBy(*key).agg(F.min(_place()).alias("l"), F.max(_place()).alias("h")).where("l <> h").select(*key), f"{name}-groups")
    out = written(rows.join(many, key), name)
    discard(many)
    return out


def _settle(rows: DataFrame, key: list[str], more: list[str], name: str) -> DataFrame:
    """rows, whose key isn't alone, with settled (equal elsewhere in `more`, too) and open (to be split further).

    A group of equal rows is done. Where a group holds different ones, one of each kind stays open: others may share a
    part of it.
    """
    kinds = written(rows.groupBy(*key, *more).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")), f"{name}-kinds")
    mixed = written(kinds.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit(True).alias("mixed")), f"{name}-mixed")
    told = written(kinds.join(mixed, key, "left").select(*key, *more, "first", (F.col("first") != F.col("last")).alias("settled"), F.coalesce("mixed", F.lit(False)).alias("mixed")), f"{name}-told")
    out = rows.join(told, [*key, *more])
    out = written(out.withColumn("open", F.col("mixed") & (~F.col("settled") | (_place() == F.col("first")))).drop("first", "mixed"), name)
    discard(kinds, mixed, told)
    return out


def _span(threshold: int):
    return F.col("row"), (F.col("a") - F.col("far")).alias("begin"), (F.col("a") - F.col("near") + threshold).alias("end")


def _spans(rows: DataFrame, threshold: int, unit: str) -> DataFrame:
    """(row, spans) of rows (row, text)."""
    if threshold < 2:
        raise ValueError("threshold is at least 2 tokens")
    step = math.isqrt(max(1, threshold // 2)) + 1
    width = 1 if unit == "byte" else 8

    # First digit: what every window of a run holds.
    runs = written(explode_texts(rows, lambda: _run_kernel(threshold, unit), _RUN, id_col="row"), "runs")
    shared = _not_alone(runs, ["fp"], "shared")
    discard(runs)

    # Next: the whole context, to the depth of the sort.
    told = _settle(shared, ["fp"], ["u"], "told")
    discard(shared)
    spans = told.where("settled").select(*_span(threshold))

    # Cores of blocks, for the runs that are left.
    left = told.where("open").groupBy("row").agg(F.collect_set(F.struct("a", "near", "far")).alias("runs"))
    arrow = to_arrow_schema(_BLOCKS)
    ship_package(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    blocks = written(rows.join(left, "row").mapInArrow(_block_rows(threshold, unit, step, arrow), _BLOCKS), "blocks")
    again = _not_alone(blocks, ["core", "b"], "again")
    discard(blocks)
    cored = _settle(again.withColumn("cut", F.when(~F.col("full"), _place()).otherwise(0)), ["core", "b"], ["left", "right", "cut"], "cored")
    discard(again)
    spans = spans.unionAll(cored.where("settled").select(*_span(threshold)))

    # Last: single windows. One that begins o tokens before the anchor takes o - near of them before the core and far - o after it.
    single = cored.where("open").select("core", "b", "left", "right", "row", "a", F.explode(F.sequence("near", "far")).alias("o"))
    taken = ((F.col("o") - F.col("b") * step) * width).cast("int")
    more = ((F.col("b") * step + step - 1 - F.col("o")) * width).cast("int")
    blank = F.lit(b"")
    before = F.when(taken > 0, F.substring(F.col("left"), F.length("left") - taken + 1, taken)).otherwise(blank)
    after = F.when(more > 0, F.substring(F.col("right"), F.lit(1), more)).otherwise(blank)
    digest = [F.xxhash64(F.lit(k), "core", "o", before, F.length(before), after).alias(f"w{k}") for k in (1, 2)]  # 128 bits
    window = written(single.select(*digest, "row", "a", F.col("o").alias("near"), F.col("o").alias("far")), "windows")
    hits = _not_alone(window, ["w1", "w2"], "hits")
    discard(window)
    spans = spans.unionAll(hits.select(*_span(threshold)))
    return spans.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def repeated_spans(docs: DataFrame, *, threshold: int = 400, unit: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): runs of tokens that repeated windows cover, one row for each row of docs that has any."""
    rows = with_row_key(docs, id_col, text_col)
    return rows.select("row", F.col("id").alias(id_col)).join(_spans(rows.select("row", "text"), threshold, unit), "row").select(id_col, "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans with touching and overlapping ones joined."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def byte_spans(raw: bytes, text: str, spans: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    """Spans of tokens as spans of bytes; a run of words takes the space after it along."""
    if unit == "byte" or not spans:
        return spans
    begins, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        begins.append(at)
        at += len(w)
    ends = [*begins[1:], len(text)]
    size = lambda n: len(text[:n].encode("utf-8", "surrogatepass"))
    return [(size(begins[a]), size(ends[b - 1])) for a, b in spans]


_CUT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]


def cut_repeats(docs: DataFrame, *, threshold: int = 400, unit: str = "byte", id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """Per row: id, kept columns, n_bytes, n_removed, n_spans and kept (the bytes that are left)."""
    keep = list(keep)
    alias = {c: f"__k{i}" for i, c in enumerate(keep)}
    renamed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(x) for c, x in alias.items()])
    rows = with_row_key(renamed, "id", "text", list(alias.values()))
    joined = rows.join(_spans(rows.select("row", "text"), threshold, unit), "row", "left").select("id", *alias.values(), "text", "spans")
    n = 1 + len(keep)
    schema = T.StructType([*joined.schema.fields[:n], *_CUT])
    arrow = to_arrow_schema(schema)
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, removed, counts, kept = [], [], [], []
                for text, own in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    gone = byte_spans(raw, text or "", merged(own), unit)
                    sizes.append(len(raw))
                    removed.append(sum(b - a for a, b in gone))
                    counts.append(len(gone))
                    edges = [0, *(x for s in gone for x in s), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                cols += [pa.array(c, type=arrow.field(n + i).type) for i, c in enumerate((sizes, removed, counts, kept))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        release_memory()

    back = {"id": id_col} | {x: c for c, x in alias.items()}
    return joined.mapInArrow(run, schema).select(*[F.col(f.name).alias(back.get(f.name, f.name)) for f in schema.fields])


def op3(spark, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of what is left.

    Null and empty texts have 0 bytes and the digest of nothing; rows with equal or null ids are documents of their own.
    """
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
win AS (SELECT r, i, md5(t[i:i + 399]) AS h FROM (SELECT r, t, unnest(range(1, octet_length(t) - 398)) AS i FROM doc WHERE octet_length(t) >= 400)),
many AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM win SEMI JOIN many USING (h)),
flow AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit),
island AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM flow),
span AS (SELECT r, g, min(i) AS b, max(i) + 400 AS e FROM island GROUP BY r, g),
edge AS (SELECT r, b, e, lag(e, 1, 1) OVER (PARTITION BY r ORDER BY b) AS prev, lead(b) OVER (PARTITION BY r ORDER BY b) AS nxt FROM span),
per AS (
  SELECT r, any_value(d.t) AS t, sum(s.e - s.b) AS removed, count(s.b) AS spans,
         string_agg(hex(d.t[s.prev:s.b - 1]) || CASE WHEN s.nxt IS NULL THEN hex(d.t[s.e:]) ELSE '' END, '' ORDER BY s.b) AS kept
  FROM doc d JOIN edge s USING (r) GROUP BY r
)
SELECT d.doc_id, CAST(octet_length(d.t) AS BIGINT) AS n_bytes, CAST(coalesce(p.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(p.spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN p.r IS NULL THEN d.t ELSE unhex(p.kept) END) AS kept_sha256
FROM doc d LEFT JOIN per p USING (r)
"""
