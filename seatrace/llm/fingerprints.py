"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame operations only.

Leaves are paragraphs: a text is cut after line ends and sentence ends, each leaf holding at least LEAF_MIN and at most
about LEAF_MAX code points. Leaves are gathered into sections; a section ends after a leaf whose digest says so (two
first hex digits in sixteen) or after SECTION_MAX leaves, so an edit moves bounds only nearby. A section's digest is that
of its leaves' digests, and the root is that of the sections' digests, all of them whole.

A fingerprint is text: the root, then the sections as `digest=leaf,leaf,...`, parted by "|", with the first digits of each
digest but the root's. Equal texts have equal
fingerprints and unequal texts unequal roots. Likeness is the Dice share of common leaves; differing sections, and in
them differing leaves, locate edits.

Edge cases: null counts as empty; an empty text has one empty leaf; long texts only have more leaves; repeated documents
have equal fingerprints; a lone document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAF_MIN, LEAF_MAX, SECTION_MAX = 24, 160, 32
#: Characters of each digest that a fingerprint shows: leaves, sections.
LEAF_HEX, SECTION_HEX = 8, 16
LEAF_PATTERN = rf"(?s).{{{LEAF_MIN},{LEAF_MAX}}}?[\n.!?]+|.{{1,{LEAF_MAX}}}"
#: Runs of joined whole leaf digests: up to the first whose digest begins with 0 or 1, else SECTION_MAX leaves or the rest.
SECTION_PATTERN = rf"(?:[0-9a-f]+,){{0,{SECTION_MAX - 1}}}?[01][0-9a-f]*,|(?:[0-9a-f]+,){{1,{SECTION_MAX}}}"


def leaves(text: Column) -> Column:
    """The paragraphs of a text; together they are the text."""
    found = F.regexp_extract_all(text, F.lit(LEAF_PATTERN), 0)
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def leaf_digests(text: Column, shown: int = 64) -> Column:
    """The first digits of the leaves' digests, each with a comma after it."""
    return F.concat(F.array_join(F.transform(leaves(text), lambda x: F.substring(F.sha2(x, 256), 1, shown)), ","), F.lit(","))


def fingerprint(digests: Column) -> Column:
    """The tree as text, from whole leaf digests."""
    sections = F.transform(F.regexp_extract_all(digests, F.lit(SECTION_PATTERN), 0), lambda s: F.struct(F.sha2(s, 256).alias("digest"), s.alias("leaves")))
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ","), 256)
    short = lambda s: F.array_join(F.transform(F.split(F.rtrim(s, F.lit(",")), ","), lambda x: F.substring(x, 1, LEAF_HEX)), ",")
    named = F.transform(sections, lambda s: F.concat(F.substring(s["digest"], 1, SECTION_HEX), F.lit("="), short(s["leaves"])))
    return F.concat(root, F.lit("|"), F.array_join(named, "|"))


def fingerprint_leaves(print_: Column) -> Column:
    """Leaf digests of a fingerprint, in order, each with a comma after it."""
    return F.concat(F.regexp_replace(F.regexp_replace(print_, r"^[0-9a-f]*\|[0-9a-f]{%d}=" % SECTION_HEX, ""), r"\|[0-9a-f]{%d}=" % SECTION_HEX, ","), F.lit(","))


def likeness(a: Column, b: Column) -> Column:
    """Dice share of the distinct leaves that two documents have in common, from their joined leaf digests."""
    a, b = F.array_distinct(F.split(F.rtrim(a, F.lit(",")), ",")), F.array_distinct(F.split(F.rtrim(b, F.lit(",")), ","))
    return F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def edits(a: Column, b: Column) -> Column:
    """Leaves (position and digest) of fingerprint a that b hasn't, looking only into sections that differ."""
    branches = lambda p: F.filter(F.split(p, r"\|"), lambda s: s.contains("="))
    other = branches(b)
    there = F.flatten(F.transform(other, lambda s: F.split(F.substring_index(s, "=", -1), ",")))
    lost = F.filter(branches(a), lambda s: ~F.array_contains(other, s))
    return F.transform(lost, lambda s: F.struct(F.substring_index(s, "=", 1).alias("section"), F.filter(F.split(F.substring_index(s, "=", -1), ","), lambda x: ~F.array_contains(there, x)).alias("leaves")))


def with_next(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id") -> DataFrame:
    """docs with next_<column> of the document after it in descending order of id; after the last comes the first.

    Documents are dealt to ranges of ids, found from quantiles, and a copy of each range's first row goes to the range
    before it: a window inside each range is all it takes, and no task holds more than some ranges. The driver holds one
    number for each range. Null ids come last; equal ids are ordered by a hash of their columns.
    """
    spark = docs.sparkSession
    i = F.col(id_col).cast("bigint")
    n = docs.count()
    ranges = min(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 64)
    cuts: list[int] = []
    if ranges > 1:
        at = docs.select(i.cast("double").alias("i")).where("i is not null").stat.approxQuantile("i", [k / ranges for k in range(1, ranges)], 0.2 / ranges)
        cuts = sorted({int(c) for c in at}, reverse=True)
    part = F.lit(0)
    if cuts:  # how many cuts are at or above the id: first among every step-th cut, then among the step that follows
        step = math.isqrt(len(cuts)) + 1
        every, coarse = (F.array(*[F.lit(c).cast("bigint") for c in x]) for x in (cuts, cuts[step - 1 :: step]))
        before = F.size(F.filter(coarse, lambda c: c >= i)) * step
        part = F.coalesce(before + F.size(F.filter(F.slice(every, before + 1, F.lit(step)), lambda c: c >= i)), F.lit(len(cuts)))
    held = docs.withColumns({"__part": part, "__i": i})
    firsts = [(r["__part"], r["m"]) for r in held.groupBy("__part").agg(F.max("__i").alias("m")).orderBy("__part").collect()]
    if not firsts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    top, last = firsts[0][1], firsts[-1][0]
    place = lambda p, wraps, copy: F.struct(p.cast("int").alias("part"), F.lit(wraps).alias("wraps"), F.lit(copy).alias("copy"))
    places = [F.array(place(F.col("__part"), False, False)), F.when(F.col("__i").eqNullSafe(F.lit(top)), F.array(place(F.lit(last), True, True)))]
    if len(firsts) > 1:
        first_of = F.create_map(*[F.lit(x) for p, m in firsts for x in (p, m)])
        before_of = F.create_map(*[F.lit(x) for (p, _), (q, _) in zip(firsts[1:], firsts, strict=False) for x in (p, q)])
        places.append(F.when(F.col("__i").eqNullSafe(first_of[F.col("__part")]) & before_of[F.col("__part")].isNotNull(), F.array(place(before_of[F.col("__part")], False, True))))
    nothing = F.array().cast("array<struct<part:int,wraps:boolean,copy:boolean>>")
    dealt = held.select("*", F.explode(F.concat(*[F.coalesce(p, nothing) for p in places])).alias("__to"))
    order = W.partitionBy("__to.part").orderBy("__to.wraps", F.col("__i").desc_nulls_last(), F.xxhash64(*columns))
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not __to.copy")
    return out.drop("__part", "__i", "__to")


def op10(spark, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and their likeness; null texts count as empty, a lone document is its own next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Short leaf digests of the plain texts are taken before the shuffle, so the next document's come along.
    paired = with_next(docs.withColumn("digests", leaf_digests(F.col("text"), LEAF_HEX)), ["text", "digests"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = edited.select("doc_id", "text", "edited", "next_digests", "digests", fingerprint(leaf_digests(F.col("text"))).alias("fingerprint"), fingerprint(leaf_digests(F.col("edited"))).alias("edited_fingerprint"))
    return both.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("digests"), fingerprint_leaves(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("digests"), F.col("next_digests")).alias("near_next"),
    )


ORACLE = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nxt AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM doc),
ed AS (SELECT *, substr(text, 1, CAST(length(text) - length(text) // 2 AS BIGINT)) || substr(next_text, 1, CAST(length(text) // 2 AS BIGINT)) AS edited FROM nxt),
cut AS (
  SELECT *, list_transform(CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '@leaf') END, lambda x: sha256(x)) AS a,
         list_transform(CASE WHEN edited = '' THEN [''] ELSE regexp_extract_all(edited, '@leaf') END, lambda x: sha256(x)) AS b,
         list_transform(CASE WHEN next_text = '' THEN [''] ELSE regexp_extract_all(next_text, '@leaf') END, lambda x: sha256(x)) AS c
  FROM ed
), joined AS (
  SELECT *, regexp_extract_all(array_to_string(a, ',') || ',', '@section') AS sa, regexp_extract_all(array_to_string(b, ',') || ',', '@section') AS sb,
         list_distinct(list_transform(a, lambda x: substr(x, 1, 8))) AS da, list_distinct(list_transform(b, lambda x: substr(x, 1, 8))) AS db, list_distinct(list_transform(c, lambda x: substr(x, 1, 8))) AS dc
  FROM cut
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(list_transform(sa, lambda s: sha256(s)), ',')) || '|' || array_to_string(list_transform(sa, lambda s: substr(sha256(s), 1, 16) || '=' || array_to_string(list_transform(string_split(rtrim(s, ','), ','), lambda x: substr(x, 1, 8)), ',')), '|') AS fingerprint,
  sha256(array_to_string(list_transform(sb, lambda s: sha256(s)), ',')) || '|' || array_to_string(list_transform(sb, lambda s: substr(sha256(s), 1, 16) || '=' || array_to_string(list_transform(string_split(rtrim(s, ','), ','), lambda x: substr(x, 1, 8)), ',')), '|') AS edited_fingerprint,
  2.0::DOUBLE * len(list_intersect(da, db)) / (len(da) + len(db)) AS near_edited,
  2.0::DOUBLE * len(list_intersect(da, dc)) / (len(da) + len(dc)) AS near_next
FROM joined
""".replace("@leaf", LEAF_PATTERN).replace("@section", SECTION_PATTERN)
