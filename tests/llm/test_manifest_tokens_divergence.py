"""Merkle manifest, token files and source audit: brute force, round trips and hard tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrace.llm import divergence, manifest, queries, token_files

from .test_contracts import prose, tables, texts  # noqa: F401

public = pytest.importorskip("public_tokenizers")
H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard_rows():
    own = [(i, t, [None, "en", "de", ""][i % 4] if i % 9 else "en", ["hot", None, "b"][i % 3], None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts())]
    own += [own[4], own[4], (None, "x", "fr", "a", 1), (None, None, "fr", "a", 1), (7, "again", "en", "hot", 5)]
    return own


def plain_tree(nodes: list[str], arity: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return levels


def plain_proof(levels: list[list[str]], at: int, arity: int) -> list[tuple[list[str], int]]:
    out = []
    for level in levels[:-1]:
        run = level[at // arity * arity :][:arity]
        out.append((run, at % arity))
        at //= arity
    return out


@pytest.mark.parametrize("arity, levels", [(2, 4), (2, 1), (3, 2), (5, 1)])
def test_manifest_equals_a_plain_tree(spark, arity, levels):
    rows = hard_rows() + [(1000 + i, prose(i, 3), "big", "s", 9) for i in range(70)]
    random.Random(1).shuffle(rows)
    m = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), arity=arity, levels=levels)
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups: dict = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((-math.inf if i is None else i, H("".join(map(part, (i, source, lang, n, text))))))
    trees = {g: plain_tree([h for _, h in sorted(own)], arity) for g, own in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = plain_tree([trees[g][-1][0] for g in order], arity)
    want = Counter()
    for g, own in groups.items():
        for at, _ in enumerate(own):
            path = plain_proof(trees[g], at, arity) + plain_proof(top, order.index(g), arity)
            want[trees[g][0][at], trees[g][-1][0], top[-1][0], H("".join(x for run, k in path for j, x in enumerate(run) if j != k))] += 1
    held = manifest.proofs(m)
    got = Counter(map(tuple, held.select("hash", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256)).collect()))
    assert got == want
    ok = held.select(manifest.folded(F.col("hash"), F.col("path")).alias("f"), manifest.folded(F.lit(H("other")), F.col("path")).alias("g"), "root").collect()
    assert all(r["f"] == r["root"] != r["g"] for r in ok)


def test_a_manifest_is_saved_and_changes_are_found(spark, tmp_path):
    rows = [(i, prose(i, 5), ["en", "de"][i % 2], "s", i) for i in range(200)]
    a = manifest.manifest(spark.createDataFrame(rows, SCHEMA))
    manifest.save(a, str(tmp_path / "m"))
    back = manifest.load(spark, str(tmp_path / "m"))
    one = lambda m: sorted(map(tuple, manifest.proofs(m).select("id", "hash", "subroot", "root", manifest.siblings(F.col("path"))).collect()))
    assert one(back) == one(a)
    assert manifest.changed_chunks(a, back).count() == 0
    changed = [(i, t + "!" if i == 101 else t, g, s, n) for i, t, g, s, n in rows]
    b = manifest.manifest(spark.createDataFrame(changed, SCHEMA))
    assert [tuple(r) for r in manifest.changed_chunks(a, b).collect()] == [("vde", 50 // 2**manifest.LEVELS)]


@pytest.mark.parametrize("bits", [1, 3, 8, 12, 16, 20, 32])
def test_tokens_are_found_without_decoding_others(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 7, 512, 513, 5000):
        ids = np.minimum(rng.zipf(1.3, n), (1 << bits) - 1).astype(np.uint32)
        sizes = rng.multinomial(n, np.ones(5) / 5)
        data = token_files.token_file([3, None, 5, 5, -1], np.cumsum(sizes).tolist(), ids)
        asked = []
        file = token_files.TokenFile(lambda at, k, data=data, asked=asked: (asked.append(k), data[at : at + k])[1])
        assert (file.tokens(0, n) == ids).all() and file.documents()[0] == [3, None, 5, 5, -1]
        for i in rng.integers(0, n, 40).tolist():
            asked.clear()
            assert file.token(i) == ids[i]
            assert sum(asked) <= len(file.widths) * (8 + 8 + 1 + token_files.BLOCK // 8)
            j = int(rng.integers(i, n + 1))
            assert (file.tokens(i, j) == ids[i:j]).all()
        with pytest.raises(IndexError):
            file.token(n)
    with pytest.raises(ValueError):
        token_files.TokenFile(lambda at, k: b"x" * k)


def test_no_widths_cost_fewer_bits():
    rng = random.Random(5)

    def cost(ids_by_bits, widths):
        at, total = 0, 0
        for k, w in enumerate(widths):
            n = sum(ids_by_bits[at + 1 :]) if at else sum(ids_by_bits)
            total += n * (w + (k + 1 < len(widths)))
            at += w
        return total

    def splits(n):
        return [[n]] + [[k, *rest] for k in range(1, n) for rest in splits(n - k)]

    for _ in range(40):
        counts = [rng.randrange(0, 50) for _ in range(rng.randrange(2, 11))]
        counts[-1] += 1
        best = token_files.chunk_widths(counts, 6)
        assert sum(best) == len(counts) - 1
        assert cost(counts, best) == min(cost(counts, w) for w in splits(len(counts) - 1) if len(w) <= 6)


ODD = ["İstanbul ǅ ŉx", "don't 's''s !'s x's", "a\x1cb\x85c d", "é café Σας ΣΑΣ.", "<|endoftext|> a<|startoftext|>b <|", " x 12,34 ½ ²", "ſs ÿ Þ÷×", "naïve ÀÉÎ’s l’eau", "日本 語 ﬁ", " 'LL 'D", "a b c", "x" * 5000]


def test_ids_are_the_librarys(spark, tables):  # noqa: F811
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path(token_files.TOKENIZER))
    rows = {r["doc_id"]: r for r in queries.queries()["op12_token_files"](spark, tables).collect()}
    at = 0
    for i, t in enumerate(texts() if rows else []):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    kernel = token_files.word_encoder(public.path(token_files.TOKENIZER), 1)
    for t in ODD:
        assert kernel([t, None, t])["ids"].to_pylist() == [(own := [*tokenizer.encode(t, add_special_tokens=False).ids, 1]), [1], own]


def test_known_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "_KNOWN", 20)
    monkeypatch.setattr(token_files, "_KEPT", 5)
    kernel = token_files.word_encoder(public.path(token_files.TOKENIZER), 1)
    first = [kernel([prose(i, 60)])["ids"].to_pylist() for i in range(4)]
    assert first == [kernel([prose(i, 60)])["ids"].to_pylist() for i in range(4)]


def test_files_are_added_to_in_order_of_ids(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = [(i * 3 % 50, prose(i, i % 7)) for i in range(50)] + [(None, "null id"), (None, None), (9, "twice")]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("body", T.StringType())])
    token_files.write_tokens(spark.createDataFrame(rows, schema).repartition(6), path, id_col="key", text_col="body")
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, *sorted([r[0] for r in rows if r[0] is not None])]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    token_files.write_tokens(spark.createDataFrame([(99, "later")], schema), path, id_col="key", text_col="body")
    more = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in more[:-1]] == [tuple(r) for r in got] and more[-1]["start"] == sum(r["n_tokens"] for r in got)
    first = next((tmp_path / "tokens").glob("*.dac"))
    file = token_files.open_token_file(str(first))
    keys, bounds = file.documents()
    held = {(r["doc_id"], tuple(r["ids"])) for r in got} | {(99, tuple(more[-1]["ids"]))}
    assert all((k, tuple(file.tokens(int(a), int(b)).tolist())) in held for k, a, b in zip(keys, bounds, bounds[1:], strict=False))


def test_a_sketch_is_never_below_the_frequency(spark):
    docs = spark.createDataFrame([(i, t, lang or "", source or "") for i, t, lang, source, _ in hard_rows()], "doc_id long, text string, lang string, source string").repartition(4)
    true = Counter((r["lang"], w) for r in docs.collect() for w in set(divergence.terms(r["text"])))
    for width in (7, 1 << 10, 1 << 18):
        table = divergence.sketch(docs, min_docs=3, depth=2, width=width)
        for lang in {g for g, _ in true}:
            own = [w for g, w in true if g == lang]
            got = divergence.estimate(table, divergence.cells(lang, own, 2, width))
            assert (got >= np.minimum(3, [true[lang, w] for w in own])).all()
        if width == 1 << 18:
            assert sum(got) <= sum(min(3, true[lang, w]) for w in own) * 1.2
    with pytest.raises(ValueError):
        divergence.sketch(docs, min_docs=0, depth=1, width=8)


@pytest.mark.parametrize("width, held", [(3, 50), (1 << 12, 1 << 21)])
def test_audit_is_the_same_for_any_sketch(spark, monkeypatch, width, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [(t, lang, source) for _, t, lang, source, _ in hard_rows()]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = {(g, w) for t, g, _ in rows for w in divergence.terms(t)}
    df = Counter((g or "", w) for t, g, _ in rows for w in set(divergence.terms(t)))
    kept = {(g or "", w) for g, w in found if df[g or "", w] >= 3}
    count = Counter((g or "", s or "", w) for t, g, s in rows for w in divergence.terms(t) if (g or "", w) in kept)
    groups = {(g or "", s or "") for _, g, s in rows}
    want = set()
    for g, s in groups:
        own = sorted(w for x, w in kept if x == g)
        total = {x: sum(count[g, x, w] for w in own) for y, x in groups if y == g}
        p = {x: {w: 1 + 10**9 * (count[g, x, w] + 1) // (total[x] + len(own)) for w in own} for x in total}
        q = {w: 1 + 10**9 * (sum(count[g, x, w] for x in total) + 1) // (sum(total.values()) + len(own)) for w in own}
        pairs = sorted((-sum((p[s][w] - p[x][w]) ** 2 // p[x][w] for w in own), x.encode()) for x in total if x != s)
        want |= {(g, s, "pair", x.decode(), -v, k + 1) for k, (v, x) in enumerate(pairs)}
        marks = sorted((-((p[s][w] - q[w]) ** 2 // q[w]), w) for w in own if count[g, s, w] and p[s][w] > q[w])
        want |= {(g, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(marks[:200])}
    got = divergence.audit(docs, width=width).select("lang", "source", "part", "item", "value", "rank")
    assert set(map(tuple, got.collect())) == want
