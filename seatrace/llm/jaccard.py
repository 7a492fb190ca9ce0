"""N-gram Jaccard join by token-combination prefixes, and the classes of near duplicates that it links.

A document is its set of distinct word shingles, hashed to 64 bits and ordered by hash. Two sets are linked when
den * |A and B| >= num * |A or B|. Equal sets are one representative from the start.

Prefixes. Linked sets of a and b tokens differ in D = a (den - num) / num tokens at most. Tokens fall into classes by
ranges of their hashes, and a set's prefix is extended class by class until it holds D + J classes that aren't empty. At
most D of them hold a token that a partner lacks or adds; so the two prefixes have J classes with exactly the same tokens
(J is a tenth of a long set's tokens, SHARED at least). How wide classes are follows from a set's size alone (about LOAD
tokens each); a set whose larger partners have finer classes is indexed by those, too.

Index. A class of a long set is indexed by the combination of all its tokens. In short sets each token is a class of its
own: tokens that few sets hold (RARE at most) are indexed alone, frequent ones in combinations of two. A set with fewer
entries held by others than any linked pair shares goes at once. As linked sets share J entries, all but SHARED of a
set's J most frequent ones can be spared: passages that many texts quote aren't indexed. Every linked pair still shares
SHARED entries (short sets one): nothing is lost.

Verification is of candidates, by counting the common tokens of whole sets. Each set is held against the two centres
(the smallest and the largest set of an entry) with which it shares most entries; that links nearly all of a group of
copies without its pairs. Entries whose sets are linked by then, directly or through others, are done. Of the other
entries, the pairs of different classes in small ones are verified each, once. Large ones are joined to groups, whose whole
sets meet in blocks of bounded size, each pair of blocks in a task of its own; there common tokens are counted by matrix
products, and a block pair returns a spanning forest of its links. Rows stay in proportion to the input but for the
blocks of a large group whose sets share entries and yet aren't linked to its centres.

Edge cases: null and empty texts have no set and are linked with nothing; texts of fewer words than a shingle are one
shingle; repeated rows have equal sets and are linked; rows with equal ids are documents of their own and keep a row
each; null ids are linked by their texts, and a class without any id has a null one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashMemo, connected_components, discard, explode_texts, ship_package, with_row_key, written

#: Entries that linked sets are made to share.
SHARED = 3
#: Tokens of a class, about; finer where a set would have too few classes.
LOAD = 6.0
#: Sets of fewer tokens have a class for each token; that is 64 bits of the hash.
SHORT, EACH = 48, 64
#: Sets of so many tokens can fill longer prefixes.
LONG = 64
#: A token held by more short sets than this is frequent.
RARE = 4
#: An open entry of so many sets at most has its pairs verified.
FEW = 8
#: A block holds sets of about so many tokens together; a set counts at least LEAST.
BLOCK_TOKENS, LEAST = 1 << 21, 1 << 10

#: Bytes in which A-Z is lowered; bytes.split() then parts at 0x20 and 0x09 to 0x0D.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word_value(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, size: int):
        self.size, self.memo = size, HashMemo(_word_value)

    def __call__(self, text: str | None) -> np.ndarray:
        words = np.fromiter(map(self.memo.__getitem__, (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()), np.uint64)
        n = min(self.size, len(words))
        if not n:
            return words
        h = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            h = _mix(h ^ words[j : len(words) - n + 1 + j])
        return np.unique(h)


def differing(n: int, num: int, den: int) -> int:
    """In how many tokens a set of n and a linked one can differ, both sides together."""
    return n * (den - num) // num


def joint(n):
    """How many classes the prefix of a set of n tokens has beyond those that may differ."""
    return np.where(n < LONG, SHARED, np.maximum(SHARED, n // 10))


def class_bits(n: np.ndarray, num: int, den: int, load: float) -> np.ndarray:
    """Leading bits of a token's hash that name its class, for sets of n tokens; EACH where each token is a class.

    The widest classes, of `load` tokens at most, of which so many aren't empty that the prefix ends (by six standard
    deviations).
    """
    n = np.asarray(n, np.int64)
    want = n * (den - num) // num + joint(n)
    out = np.full(len(n), EACH)
    if load <= 0:
        return out
    first = np.ceil(np.log2(np.maximum(n / load, 1)))
    for more in (3, 2, 1, 0):
        m = 2.0 ** (first + more)
        share = np.exp(-n / m)
        filled, spread = m * (1 - share), np.sqrt(np.maximum(m * (share - (1 + n / m) * share * share), 0))
        out = np.where((n >= SHORT) & (filled - 6 * spread >= want), first + more, out).astype(np.int64)
    return out


class Keys:
    """The index keys of sets: (keys, how many any linked pair shares, whether the prefix could be filled)."""

    def __init__(self, num: int, den: int, load: float):
        self.num, self.den, self.load = num, den, load
        self.known = class_bits(np.arange(1 << 16), num, den, load)

    def bits(self, least: int, most: int) -> list[int]:
        own = self.known[least : most + 1] if most < len(self.known) else class_bits(np.arange(least, most + 1), self.num, self.den, self.load)
        return np.unique(own).tolist()

    def __call__(self, s: np.ndarray):
        n, num, den = len(s), self.num, self.den
        d = differing(n, num, den)
        if not d:
            return s[:0], 0, True  # linked with equal sets only
        least, more = -(-n * num // den), int(joint(n))  # the smallest partner
        out, filled = [], True
        for bits in self.bits(n, n * den // num):
            if bits == EACH:
                # Of a set's own tokens n - least are missing from a partner at most.
                out.append(_mix(s[: n - least + more] ^ _B) | np.uint64(1))
                continue
            cls = s >> np.uint64(64 - bits)
            first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
            if len(first) < d + (more if n >= LONG else 1):
                filled = False
            sums = np.add.reduceat(_mix(s), first[: d + more + 1])
            out.append(_mix((sums if len(first) <= d + more else sums[:-1]) ^ np.uint64(bits)) & ~np.uint64(1))
        return np.unique(np.concatenate(out)), int(joint(least)) if least >= LONG else 1, filled


def common_least(n: int, num: int, den: int) -> int:
    """How many of the tokens that two linked short sets index are common, n being the larger set's tokens."""
    small = -(-n * num // den)
    return min(-(-small * num // den), SHARED)


_SETS = [T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())]
_SETS += [T.StructField("need", T.LongType()), T.StructField("alone", T.BooleanType()), T.StructField("filled", T.BooleanType()), T.StructField("keys", T.ArrayType(T.LongType()))]


def _set_kernel(size: int, num: int, den: int, load: float):
    shingles, keys = Shingles(size), Keys(num, den, load)

    def run(ids, texts):
        out = {f.name: [] for f in _SETS}
        for i, t in zip(ids, texts, strict=True):
            s = shingles(t)
            digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            own, need, filled = keys(s)
            alone = common_least(len(s), num, den) < 2  # too few common tokens for a combination of two
            for name, x in (("row", i), ("n", len(s)), ("s1", digest[0]), ("s2", digest[1]), ("need", need), ("alone", alone), ("filled", filled), ("keys", own.view(np.int64))):
                out[name].append(x)
        return out

    return run


def _whole_kernel(size: int):
    shingles = Shingles(size)

    def run(ids, texts):
        return {"row": ids, "tokens": [shingles(t).view(np.int64) for t in texts]}

    return run


def _classes(rows: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(row, n, rep, component) of rows (row, text): the set's size, the smallest row with the same set, the smallest row linked."""
    texts = rows.select("row", "text")
    load = LOAD
    while True:
        sets = written(explode_texts(texts, lambda at=load: _set_kernel(shingle, num, den, at), _SETS, id_col="row"), "sets")
        if load <= 0 or sets.where("not filled").isEmpty():
            break
        discard(sets)  # classes too wide for some set: finer ones, in the end a class for each token
        load = load / 4 if load > 1 else 0.0
    same = ["n", "s1", "s2"]
    first = written(sets.where("n > 0").groupBy(*same).agg(F.min("row").alias("rep"), *[F.any_value(c).alias(c) for c in ("need", "alone", "keys")]), "classes")
    named = written(sets.select("row", *same), "named-sets")  # the keys stay in the classes only
    discard(sets)
    components = connected_components(_links(_entries(first), texts, shingle, num, den), "near")
    classes = first.select(*same, "rep").join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*same, "rep", F.coalesce("component", "rep").alias("component"))
    return named.join(classes, same, "left").select("row", "n", F.coalesce("rep", "row").alias("rep"), F.coalesce("component", "row").alias("component"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, representative (smallest id with the same set) and component_id (smallest id linked)."""
    rows = with_row_key(docs, id_col, text_col)
    named = _classes(rows, shingle, num, den)
    if not hasattr(rows, "_seatrace_path"):  # ids are unique: rows are their ids
        kind = docs.schema[id_col].dataType
        return named.select(F.col("row").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").cast(kind).alias("representative"), F.col("component").cast(kind).alias("component_id"))
    named = written(named.join(rows.select("row", "id"), "row"), "named")
    least = lambda by: written(named.groupBy(by).agg(F.min("id").alias(f"{by}_id")), by)
    out = named.join(least("rep"), "rep").join(least("component"), "component")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep_id").alias("representative"), F.col("component_id"))


def without_near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the smallest id; where ids are repeated or null, one of the class's rows.

    All columns stay; rows without any word are linked with nothing and stay.
    """
    names = docs.columns
    alias = {c: f"__k{i}" for i, c in enumerate(names)}
    renamed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(x) for c, x in alias.items()])
    rows = with_row_key(renamed, "id", "text", list(alias.values()))
    gone = _classes(rows, shingle, num, den).where("component <> row").select("row")
    return rows.join(gone, "row", "left_anti").select(*[F.col(x).alias(c) for c, x in alias.items()])


def _held(index: DataFrame, name: str) -> DataFrame:
    """(rep, need, alone, keys): the keys that other sets hold, too, with how many hold them; sets with too few of them go."""
    held = written(index.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), f"{name}-held")
    kept = index.join(held, "key").groupBy("rep", "need", "alone").agg(F.collect_list(F.struct("key", "df")).alias("keys")).where(F.size("keys") >= F.col("need"))
    out = written(kept, name)
    discard(held)
    return out


def _entries(first: DataFrame) -> DataFrame:
    """(key, rep, need): the index. A set has a bounded number of rows here, D + SHARED for each width of its classes."""
    some = _held(first.select("rep", "need", "alone", F.explode("keys").alias("key")), "some")
    near = _held(some.select("rep", "need", "alone", F.explode("keys.key").alias("key")), "near")
    discard(some)
    # The most frequent keys of a set, but for SHARED of those that linked sets share.
    spare = F.greatest(F.col("need") - SHARED, F.lit(0)).cast("int")
    by_df = F.transform(F.array_sort(F.transform("keys", lambda k: F.struct(k["df"].alias("df"), k["key"].alias("key")))), lambda k: F.struct(k["key"].alias("key"), k["df"].alias("df")))
    near = near.select("rep", "alone", F.least("need", F.lit(SHARED).cast("bigint")).alias("need"), F.slice(by_df, F.lit(1), F.size("keys") - spare).alias("keys"))
    of_short = lambda k: (k["key"].bitwiseAND(F.lit(1)) == 1) & (k["df"] > RARE)
    often = F.transform(F.array_sort(F.filter("keys", of_short)), lambda k: k["key"])
    split = near.select("rep", "need", F.filter("keys", lambda k: ~of_short(k) | F.col("alone"))["key"].alias("plain"), often.alias("often"))
    at = F.when(F.size("often") > 1, F.sequence(F.lit(1), F.size("often") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.slice("often", i + 1, F.size("often")), lambda y: F.xxhash64(F.element_at("often", i), y))))
    return written(split.select("rep", "need", F.explode(F.array_distinct(F.concat("plain", pairs))).alias("key")), "entries")


def _verified(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones among pairs (a, b), each counted once; both joins are plain shuffles, so hot centres are split."""
    own = pairs.join(tokens.select(F.col("row").alias("a"), F.col("tokens").alias("x")), "a")
    both = own.join(tokens.select(F.col("row").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    return both.where(F.lit(den) * common >= F.lit(num) * (F.size("x") + F.size("y") - common)).select("a", "b")


def _links(entries: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b): verified links that connect all linked sets."""
    fields = [T.StructField("row", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    asked = entries.select(F.col("rep").alias("row")).distinct()
    tokens = written(explode_texts(texts.join(asked, "row", "left_semi"), lambda: _whole_kernel(shingle), fields, id_col="row"), "tokens")

    # Each set against its centres.
    centres = written(entries.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high"), "centres")
    held = written(entries.join(centres, "key"), "centred")
    ends = held.select("rep", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("low").alias("c")), F.struct(F.lit(1).alias("kind"), F.col("high").alias("c")))).alias("e")).where("e.c <> rep")
    most = ends.groupBy("rep", "e.kind", "e.c").agg(F.count("*").alias("n")).groupBy("rep", "kind").agg(F.max(F.struct("n", "c")).alias("best"))
    pairs = most.select(F.least("rep", "best.c").alias("a"), F.greatest("rep", "best.c").alias("b")).distinct()
    found = [written(_verified(pairs, tokens, num, den), "to-centres")]

    # Entries that hold sets of several classes are still open; sets in too few of them are done, which may close others.
    label = written(connected_components(found[0], "linked"), "labels")
    told = held.select("key", "rep", "need").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    left = written(told.select("key", "rep", "need", F.coalesce("component", "rep").alias("label")), "told")
    discard(centres, held, label)
    for last in (False, True):
        open_ = written(left.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("sets")).where("l <> h").select("key", "sets"), "open")
        both = written(left.select("key", "rep", "need", "label").join(open_, "key"), "left")
        discard(left, open_)
        left = both
        if not last:
            enough = written(left.groupBy("rep").agg(F.count("*").alias("n"), F.min("need").alias("least")).where("n >= least").select("rep"), "enough")
            both = written(left.join(enough, "rep"), "left")
            discard(left, enough)
            left = both

    # A pair that is in no large open entry shares as many small ones as any linked pair does.
    member = F.sort_array(F.collect_list(F.struct("rep", "label", "need")))
    small = left.where(F.col("sets") <= FEW).groupBy("key").agg(member.alias("m"))
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.transform(F.slice("m", i + 1, F.size("m")), lambda y: F.struct(F.element_at("m", i).alias("x"), y.alias("y")))))
    few = small.select(F.explode(two).alias("p")).where("p.x.label <> p.y.label").groupBy(F.col("p.x.rep").alias("a"), F.col("p.y.rep").alias("b"))
    few = few.agg(F.count("*").alias("n"), F.min(F.least("p.x.need", "p.y.need")).alias("need")).where("n >= need").select("a", "b")
    found.append(written(_verified(few, tokens, num, den), "pairs"))

    large = left.where(F.col("sets") > FEW)
    if not large.isEmpty():
        hubs = written(large.groupBy("key").agg(F.min("rep").alias("a")), "hubs")
        stars = large.join(hubs, "key").where("rep <> a").select(F.col("rep").alias("b"), "a")
        found.append(_in_blocks(connected_components(stars, "groups"), tokens, num, den))
        discard(hubs)
    discard(left)
    return reduce(DataFrame.unionAll, found)


def _in_blocks(groups: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect all linked sets within each group (node, component), found by pairs of blocks."""
    sized = groups.select(F.col("node").alias("row"), "component").join(tokens.select("row", F.size("tokens").alias("n")), "row")
    groups = written(sized.withColumn("weight", F.greatest(F.col("n"), F.lit(LEAST)).cast("bigint")), "groups")
    sizes = written(groups.groupBy("component").agg(F.ceil(F.sum("weight") / BLOCK_TOKENS).alias("blocks"), F.sum("weight").alias("all")), "sizes")
    small = sizes.where("blocks = 1").agg(F.sum("all")).first()[0] or 0
    buckets = max(1, int(small) // BLOCK_TOKENS * 2)
    held = tokens.join(groups.join(sizes, "component").select("row", "component", "blocks"), "row")
    own = F.pmod(F.xxhash64("row"), "blocks")
    zero = F.lit(0).cast("bigint")
    alone = held.where("blocks = 1").select("row", "tokens", "component", F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket"), zero.alias("i"), zero.alias("j"), zero.alias("own"))
    spread = held.where("blocks > 1").withColumn("own", own).withColumn("o", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    spread = spread.select("row", "tokens", "component", F.col("component").alias("bucket"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own")
    ship_package(tokens.sparkSession)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("component"):
            i, j = g["i"].iloc[0], g["j"].iloc[0]
            x, y = g[g["own"] == i], g[g["own"] == j]
            first = [t.view(np.uint64) for t in x["tokens"]]
            second = first if i == j else [t.view(np.uint64) for t in y["tokens"]]
            out += forest(x["row"].tolist(), first, y["row"].tolist(), second, num, den)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    parts = alone.withColumn("big", F.lit(False)).unionAll(spread.withColumn("big", F.lit(True)))
    return written(parts.groupBy("big", "bucket", "i", "j").applyInPandas(link, "a long, b long"), "links")


def common_tokens(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of x has in common with each of y (sorted sets); the diagonal doesn't count if y is x."""
    out = np.zeros((len(x), len(y)), np.float32)
    if not x or not y:
        return out
    tokens, ids = np.unique(np.concatenate(x if y is x else x + y), return_inverse=True)
    cut = sum(map(len, x))
    rows_x, rows_y = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    ids_x, ids_y = ids[:cut], ids if y is x else ids[cut:]
    held_x, held_y = np.bincount(ids_x, minlength=len(tokens)), np.bincount(ids_y, minlength=len(tokens))
    both = np.flatnonzero(held_x > 1 if y is x else (held_x > 0) & (held_y > 0))
    place = np.full(len(tokens), -1)
    place[both] = np.arange(len(both))
    px, py = place[ids_x], place[ids_y]
    in_x, in_y = px >= 0, py >= 0
    px, py, rows_x, rows_y = px[in_x], py[in_y], rows_x[in_x], rows_y[in_y]
    for at in range(0, len(both), 4096):
        width = min(4096, len(both) - at)
        a, b = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        own_x, own_y = (px >= at) & (px < at + 4096), (py >= at) & (py < at + 4096)
        a[rows_x[own_x], px[own_x] - at] = 1
        b[rows_y[own_y], py[own_y] - at] = 1
        some_x, some_y = np.flatnonzero(a.any(1)), np.flatnonzero(b.any(1))
        out[np.ix_(some_x, some_y)] += a[some_x] @ b[some_y].T
    return out


def forest(docs_x, x, docs_y, y, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the sets of two blocks (or of one with itself), as few as connect what they connect."""
    root = {d: d for d in [*docs_x, *docs_y]}

    def top(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    n, m = np.array([len(s) for s in x], np.int64), np.array([len(s) for s in y], np.int64)
    common = common_tokens(x, y).astype(np.int64)
    out = []
    for i, j in zip(*np.nonzero(den * common >= num * (n[:, None] + m[None, :] - common)), strict=True):
        a, b = top(docs_x[i]), top(docs_y[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((docs_x[i], docs_y[j]))
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    """Per document: n_shingles and component_id, for shingles of three words and a similarity of 0.9.

    Texts that are null or have no words have no shingles and are components of their own; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
often AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
sm AS (SELECT r, s FROM sh SEMI JOIN often USING (s)),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sm a JOIN sm b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
sym AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, m.m) AS BIGINT) AS component_id
FROM doc d LEFT JOIN n USING (r) LEFT JOIN (SELECT reach.x, min(o.doc_id) AS m FROM reach JOIN doc o ON o.r = reach.y GROUP BY reach.x) m ON m.x = d.r
"""
