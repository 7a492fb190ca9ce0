"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it. Pieces are dealt by hash into shards of about
`shard_rows`, and each shard is packed alone, largest first: a piece goes to the open bin where it leaves least room; where
none has room, a bin is opened of the length with the least cost for each token that it can be filled with, looking ahead
at the pieces still to come. In the end every bin gets the least length that holds its contents.

Only ids and token counts move; texts stay where they are read. The cost of a length is `fixed + c + c * c / attention`.

Edge cases: null and empty texts have no tokens and are in no bin; null ids are packed like others; repeated rows are
packed each; ties go by id and place, so equal input gives equal bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, written
from .subwords import RANKS, Subwords

LENGTHS = (512, 1024, 2048, 4096, 8192)


def cost(length: int, fixed: float = 32.0, attention: float = 16384.0) -> float:
    return fixed + length + length * length / attention


def opened(size: int, smaller: Sequence[int], lengths: Sequence[int]) -> int:
    """The length to open for a piece. smaller: sizes of the pieces still to come, ascending."""
    best, least = lengths[-1], float("inf")
    for c in lengths:
        if c < size:
            continue
        room, end = c - size, len(smaller)
        while room and end:  # fill with the largest that fits, then the next
            end = bisect_right(smaller, room, 0, end)
            if end:
                end -= 1
                room -= smaller[end]
        each = cost(c) / (c - room)
        if each < least:
            best, least = c, each
    return best


def pack(sizes: Sequence[int], lengths: Sequence[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin, offset) of each piece, sizes being in descending order, and (length, used) of each bin."""
    lengths = sorted(lengths)
    rising = list(reversed(sizes))
    room: list[tuple[int, int]] = []  # (tokens left, bin), ascending
    used: list[int] = []
    given: list[int] = []
    bins, offsets = [], []
    for k, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            c = opened(size, _View(rising, len(sizes) - k - 1), lengths)
            b, left = len(used), c
            used.append(0)
            given.append(c)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return bins, offsets, final, used


class _View(Sequence):
    """The first n items of a list, without a copy."""

    def __init__(self, items, n):
        self.items, self.n = items, n

    def __len__(self):
        return self.n

    def __getitem__(self, i):
        return self.items[i]


def token_counts(docs: DataFrame, *, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def kernel():
        subwords = Subwords(ranks)
        return lambda texts: {"n_tokens": [subwords.count(t) for t in texts]}

    return map_texts(docs, kernel, [T.StructField("n_tokens", T.LongType())], id_col=id_col, text_col=text_col)


def pack_documents(docs: DataFrame, *, lengths: Sequence[int] = LENGTHS, shard_rows: int = 20_000, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece (number in its document), begin and n_tokens (its tokens), bin, offset, length and used (of the bin)."""
    lengths = sorted(lengths)
    longest = lengths[-1]
    counted = written(token_counts(docs, ranks=ranks, id_col=id_col, text_col=text_col), "tokens")
    kind = counted.schema[id_col].dataType
    last = F.floor((F.col("n_tokens") - 1) / longest)
    pieces = (
        counted.where("n_tokens > 0")
        .select(F.col(id_col).cast("string").alias("id"), "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
        .select("id", "piece", (F.col("piece") * longest).alias("begin"), F.least(F.lit(longest), F.col("n_tokens") - F.col("piece") * longest).alias("n_tokens"))
    )
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        bins, offsets, final, used = pack(pdf["n_tokens"].tolist(), lengths)
        pdf["bin"] = [int(s) * (1 << 32) + b for s, b in zip(pdf["shard"], bins, strict=True)]
        pdf["offset"] = offsets
        pdf["length"] = [final[b] for b in bins]
        pdf["used"] = [used[b] for b in bins]
        return pdf[["id", "piece", "begin", "n_tokens", "bin", "offset", "length", "used"]]

    out = dealt.groupBy("shard").applyInPandas(one, "id string, piece long, begin long, n_tokens long, bin long, offset long, length long, used long")
    return out.select(F.col("id").cast(kind).alias(id_col), "piece", "begin", "n_tokens", "bin", "offset", "length", "used")


def op9(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins; null and empty texts have none, ties go by id and place."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
