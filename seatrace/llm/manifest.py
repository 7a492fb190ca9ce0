"""Merkle manifest of a dataset: a tree over each group's rows and one over the groups' roots.

Leaves are digests of rows, numbered in order of id inside their group. Every `arity` consecutive nodes are joined into the
digest of their hashes, written one behind the other, until one node is left. What is stored for a parent is this text, its
preimage: the hashes of all its children in one string. A leaf's proof is its path of ancestor preimages. A node's own hash
is 64 characters at a known slot of its parent's preimage, so siblings are what is left when the slot is cut out, and
another hash is folded in by putting it into the slot and hashing again.

Nodes are gathered in chunks of SPAN consecutive ones, and a chunk's levels are computed in one row: a tree over n leaves
takes log(n) / log(SPAN) shuffles, each SPAN times smaller than the one before. Paths come down the same way: a chunk is
joined with the path above it, a leaf with that of its chunk. Leaves are numbered by ranges: rows are sorted in ranges of
(group, id), counted for each range, and a range's offset is added, so a group may hold any share of all rows.

Edge cases: a null group is a group of its own and comes first; null columns count as `-`; an empty text is `0:`; null ids
come first; equal ids follow by digest and then by row; columns other than the named ones aren't read; an empty table has
no root and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import checkpoint_dir, written

#: Levels of a chunk; with two children it has 16 nodes.
LEVELS = 4
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
HEX = 64


def field(value: Column) -> Column:
    """One column inside a leaf's preimage: its length in bytes and its text, so that no two rows share a preimage."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(nodes: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """nodes (key, ...) with pos from 0 in each key, and (key, n); order must tell all rows apart."""
    by = [F.col("key"), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    held = written(ranged, f"{name}-sorted")
    part = F.shiftright("at", 33)
    ranges = written(held.groupBy("key", part.alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("n")), f"{name}-ranges")
    # One row for each range that a key touches, so as many for a key as there are tasks.
    offset = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("key", "part", (F.col("low") - offset).alias("shift"))
    out = held.withColumn("part", part).join(starts, ["key", "part"]).withColumn("pos", F.col("at") - F.col("shift"))
    return out.drop("at", "part", "shift"), ranges.groupBy("key").agg(F.sum("n").alias("n"))


def height(n: Column, arity: int) -> Column:
    """Levels above n leaves."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(F.lit(p).cast("bigint"))
        p *= arity
    return F.size(F.filter(F.array(*powers), lambda x: x < n))


def chunk_levels(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(key, n, chunk, preimages, hash) of nodes (key, n, pos, hash): preimages[k] are those of the parents k + 1 levels up.

    A chunk has at most arity ** levels nodes, so the group is bounded. Near the root there are fewer levels.
    """
    span = arity**levels
    chunk = F.floor(F.col("pos") / F.lit(span)) if span & (span - 1) else F.shiftright("pos", span.bit_length() - 1)
    cur = nodes.groupBy("key", "n", chunk.cast("bigint").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("h0"))
    todo = height(F.col("n"), arity)
    for k in range(levels):
        above = F.transform(F.sequence(F.lit(0), F.floor((F.size(f"h{k}") - 1) / arity).cast("int")), lambda i: F.array_join(F.slice(f"h{k}", i * arity + 1, arity), ""))
        cur = cur.withColumn(f"p{k}", F.when(F.lit(k) < todo, above))
        cur = cur.withColumn(f"h{k + 1}", F.coalesce(F.transform(f"p{k}", lambda x: F.sha2(x, 256)), F.col(f"h{k}")))
    preimages = F.filter(F.array(*[f"p{k}" for k in range(levels)]), lambda p: p.isNotNull())
    return cur.select("key", "n", "chunk", preimages.alias("preimages"), F.col(f"h{levels}")[0].alias("hash"))


def own_path(pos: Column, preimages: Column, arity: int, levels: int) -> Column:
    """The ancestors of place pos inside its chunk, lowest first: their preimages, and the node's slot in each."""
    powers = F.array(*[F.lit(arity**k).cast("bigint") for k in range(levels + 1)])

    def step(p: Column, k: Column) -> Column:
        inside = F.pmod(pos, F.lit(arity**levels))
        at = F.floor(inside / F.element_at(powers, k + 1))
        return F.struct(F.element_at(p, (F.floor(at / arity) + 1).cast("int")).alias("preimage"), F.pmod(at, F.lit(arity)).cast("int").alias("slot"))

    return F.transform(preimages, step)


@dataclass
class Manifest:
    """leaves (key, pos, n, hash, ...), chunks by step (key, n, chunk, preimages, hash) and roots (key, hash)."""

    leaves: DataFrame
    chunks: list[DataFrame]
    roots: DataFrame
    arity: int
    levels: int


def tree(leaves: DataFrame, sizes: DataFrame, *, arity: int = 2, levels: int = LEVELS, name: str = "tree") -> Manifest:
    """Chunks of a tree over numbered leaves (key, pos, hash, ...), each step written."""
    if arity < 2 or levels < 1:
        raise ValueError("arity is at least 2, levels at least 1")
    placed = written(leaves.join(sizes, "key"), f"{name}-leaves")
    most, steps = placed.agg(F.max("n")).first()[0] or 0, []
    nodes = placed.select("key", "n", "pos", "hash")
    while True:
        now = written(chunk_levels(nodes, arity, levels), f"{name}-chunks")
        steps.append(now)
        most = -(-most // arity**levels)
        if most <= 1:
            break
        span = arity**levels
        # Trees that are finished have one node and no level left; they go up as they are.
        nodes = now.select("key", F.ceil(F.col("n") / span).cast("bigint").alias("n"), F.col("chunk").alias("pos"), "hash")
    return Manifest(placed, steps, steps[-1].select("key", "hash"), arity, levels)


def with_paths(m: Manifest) -> DataFrame:
    """The leaves with their path (preimage, slot) of all ancestors, lowest first."""
    span, above = m.arity**m.levels, None
    for k in range(len(m.chunks) - 1, -1, -1):
        chunks = m.chunks[k].select("key", "chunk", "preimages", *(["hash"] if above is None else []))
        if above is None:
            up = chunks.select("key", "chunk", "preimages", F.array().cast("array<struct<preimage:string,slot:int>>").alias("above"))
        else:
            up = chunks.withColumn("upper", F.floor(F.col("chunk") / span)).join(above.withColumnsRenamed({"chunk": "upper", "preimages": "upper_preimages", "above": "upper_above"}), ["key", "upper"])
            path = F.concat(own_path(F.col("chunk"), F.col("upper_preimages"), m.arity, m.levels), F.col("upper_above"))
            up = up.select("key", "chunk", "preimages", path.alias("above"))
        above = up
    out = m.leaves.withColumn("chunk", F.floor(F.col("pos") / span)).join(above, ["key", "chunk"])
    path = F.concat(own_path(F.col("pos"), F.col("preimages"), m.arity, m.levels), F.col("above"))
    return out.withColumn("path", path).drop("chunk", "preimages", "above")


def siblings(path: Column) -> Column:
    """What is left of each ancestor's preimage without the node's own slot, lowest first."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["preimage"], F.lit(""), p["slot"] * HEX + 1, F.lit(HEX))), "")


def folded(hash_: Column, path: Column) -> Column:
    """The root that another hash in the leaf's place leads to: it goes into each ancestor's preimage in turn."""
    return F.aggregate(path, hash_, lambda h, p: F.sha2(F.overlay(p["preimage"], h, p["slot"] * HEX + 1, F.lit(HEX)), 256))


@dataclass
class Dataset:
    """The manifest of all groups, and the tree over their roots with one leaf for each group."""

    groups: Manifest
    top: Manifest


def manifest(docs: DataFrame, *, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None, arity: int = 2, levels: int = LEVELS) -> Dataset:
    """Digests each row of docs once, in the pass that reads it; only ids, groups and digests are shuffled.

    keep: further columns to carry by their names (none of them key, row, hash, pos or n).
    """
    key = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("hash"), *[c.alias(n) for n, c in (keep or {}).items()])
    held = written(rows.withColumn("row", F.monotonically_increasing_id()), "manifest-digests")
    leaves, sizes = numbered(held, ["id", "hash", "row"], "manifest")
    groups = tree(leaves.drop("row"), sizes, arity=arity, levels=levels, name="manifest")
    roots = groups.roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "hash")
    tops, n = numbered(roots, ["group"], "manifest-top")
    return Dataset(groups, tree(tops, n, arity=arity, levels=levels, name="manifest-top"))


def proofs(m: Dataset) -> DataFrame:
    """The leaves with subroot, root and their whole path through subroot to root."""
    upper = with_paths(m.top).join(m.top.roots.withColumnRenamed("hash", "root"), "key").select(F.col("group").alias("key"), F.col("hash").alias("subroot"), "root", F.col("path").alias("top"))
    return with_paths(m.groups).join(upper, "key").withColumn("path", F.concat("path", "top")).drop("top")


def save(m: Dataset, path: str) -> None:
    """Leaves and the preimages of all parents as tables."""
    for part, tree_ in (("groups", m.groups), ("top", m.top)):
        tree_.leaves.write.mode("overwrite").parquet(f"{path}/{part}/leaves")
        steps = [c.select(F.lit(k).alias("step"), "*") for k, c in enumerate(tree_.chunks)]
        reduce(DataFrame.unionByName, steps).write.mode("overwrite").partitionBy("step").parquet(f"{path}/{part}/chunks")


def load(spark, path: str, *, arity: int = 2, levels: int = LEVELS) -> Dataset:
    def one(part: str) -> Manifest:
        chunks = spark.read.schema(T.StructType.fromDDL("key string, n bigint, chunk bigint, preimages array<array<string>>, hash string, step int")).parquet(f"{path}/{part}/chunks")
        n = (chunks.agg(F.max("step")).first()[0] or 0) + 1
        steps = [chunks.where(F.col("step") == k).drop("step") for k in range(n)]
        return Manifest(spark.read.parquet(f"{path}/{part}/leaves"), steps, steps[-1].select("key", "hash"), arity, levels)

    return Dataset(one("groups"), one("top"))


def changed_chunks(a: Dataset, b: Dataset) -> DataFrame:
    """(key, chunk) of the lowest chunks that differ between two manifests, found from the groups whose roots differ."""
    roots = a.groups.roots.withColumnRenamed("hash", "ha").join(b.groups.roots.withColumnRenamed("hash", "hb"), "key", "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("key")
    low = [m.groups.chunks[0].join(roots, "key", "left_semi").select("key", "chunk", F.col("hash").alias(h)) for m, h in ((a, "ha"), (b, "hb"))]
    return low[0].join(low[1], ["key", "chunk"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("key", "chunk")


def op11(spark, sf_dir: str) -> DataFrame:
    """Per document: its leaf, subroot, root and proof, and whether a leaf that may have been tampered with still folds to the root.

    Tampering adds 1 to n_chars where 7 divides the crc32 of doc_id. Null columns, groups and ids have defined places, see above.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    tampered = leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    m = manifest(docs, keep={"tampered": F.when(hit, tampered)})
    held = proofs(m)
    out = held.select(
        F.col("id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "hash"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = "sha256({})".format(" || ".join("coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format(c) for c in COLUMNS))
#: DuckDB has no crc32: its bits, one after the other.
_CRC = "xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ord(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT))"
ORACLE = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('v' || lang, '') AS k, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} AS tampered
  FROM documents
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM leaf
), node AS (
  SELECT k, 0 AS lvl, pos, n, leaf AS h FROM ranked
  UNION ALL
  SELECT k, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY k, lvl, pos // 2, n
), sub AS MATERIALIZED (
  SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), topnode AS (
  SELECT 0 AS lvl, pos, n, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM topnode WHERE n > 1 GROUP BY lvl, pos // 2, n
), climb AS (
  SELECT r.k, r.pos AS at, 0 AS lvl, r.pos, r.n, CASE WHEN {_CRC} % 7 = 0 THEN tampered ELSE leaf END AS h, '' AS proof FROM ranked r
  UNION ALL
  SELECT c.k, c.at, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(s.h, '') || c.h ELSE c.h || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN node s ON s.k = c.k AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.n > 1
), over AS (
  SELECT c.k, c.at, 0 AS lvl, s.pos, s.n, c.h, c.proof FROM climb c JOIN sub s USING (k) WHERE c.n = 1
  UNION ALL
  SELECT c.k, c.at, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(s.h, '') || c.h ELSE c.h || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
  FROM over c LEFT JOIN topnode s ON s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.n > 1
)
SELECT r.doc_id, r.leaf, sub.h AS subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM ranked r JOIN sub USING (k) JOIN over o ON o.k = r.k AND o.at = r.pos AND o.n = 1 CROSS JOIN (SELECT h FROM topnode WHERE n = 1) t
"""
