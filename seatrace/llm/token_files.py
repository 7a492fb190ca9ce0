"""Token ids in directly addressable codes, as a Spark data source, and the encoder in front of it.

A file holds the ids of consecutive documents. Every id is cut into chunks, lowest bits first: level 0 has the lowest chunk
of every id, level k the next chunk of those ids that go on. A bitmap for each level but the last says which go on, and a
rank directory (set bits before each block of 512) gives an id's place in the next level. So any token is found by reading,
for each level, one chunk, one directory entry and at most 64 bytes of bitmap; nothing before it is decoded. The widths of
the chunks are those with the fewest bits in all for the file's own ids.

    header       magic, 8 bytes | number of sections, uint64 | (begin, length) of each, uint64
    sections     shape (documents, tokens, widths of the levels), uint64 | document ids, int64 | which ids are null, bits |
                 token bounds of the documents, uint64 | for each level: chunks, packed | bitmap | rank directory, uint64

Everything is little-endian, sections begin at multiples of 8. `_manifest.json` beside the files, written when all tasks are
done, names them in order with their documents, tokens and first token; files that it doesn't name (of lost attempts) don't
count. The writer takes rows (doc_id, ids) in the order in which they come, one file for each task that has rows; the reader
gives doc_id, start (tokens of all documents before), n_tokens and ids.

Edge cases: null ids (of documents) come first and are kept as null; a null or empty text has only its end; rows with equal
ids are documents of their own, in order of a hash of their texts; an empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from seatrace.shipping import ship_package

from .common import bounded_batches, checkpoint_dir, map_texts, release_memory

MAGIC = b"DACTOK01"
BLOCK = 512
#: Tokens that the reader decodes at a time.
READ_TOKENS = 1 << 20
#: Bytes of text that are encoded at a time: the more, the fewer words are new to a slice.
SLICE_TEXT = 4 << 20
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def chunk_widths(ids_by_bits: Sequence[int], most: int = 6) -> list[int]:
    """Widths of the levels with the fewest bits in all, where ids_by_bits[b] ids need b bits (0 counts as 1)."""
    top = max([b for b, n in enumerate(ids_by_bits) if n] + [1])
    longer = [sum(ids_by_bits[b + 1 :]) if b else sum(ids_by_bits) for b in range(top)]  # ids that go on past b bits
    best: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for begin in range(top - 1, -1, -1):
        for levels in range(1, most + 1):
            options = [(longer[begin] * (top - begin), [top - begin])]
            if levels > 1:
                for end in range(begin + 1, top):
                    cost, rest = best[end, levels - 1]
                    options.append((longer[begin] * (end - begin + 1) + cost, [end - begin, *rest]))
            best[begin, levels] = min(options, key=lambda o: (o[0], len(o[1])))
    return best[0, most][1]


def _bits_at(k: int, width: int, skip: int = 0) -> tuple[int, int, int]:
    """Of the k-th of eight values: its first byte, its first bit there and how many bytes it touches."""
    byte, bit = divmod(skip + k * width, 8)
    return byte, bit, (bit + width + 7) // 8


def packed(values: np.ndarray, width: int) -> bytes:
    """Values of width bits each, one behind the other. Eight of them are width bytes, so they are shifted column by column."""
    out = []
    for at in range(0, len(values), 1 << 19):  # a multiple of 8 values ends on a whole byte
        part = values[at : at + (1 << 19)]
        wide = np.zeros((-(-len(part) // 8), 8), np.uint32 if width <= 25 else np.uint64)
        wide.reshape(-1)[: len(part)] = part
        bits = np.zeros((len(wide), width), np.uint8)
        for k in range(8):
            byte, bit, touched = _bits_at(k, width)
            own = wide[:, k] << wide.dtype.type(bit)
            for j in range(touched):
                bits[:, byte + j] |= (own >> wide.dtype.type(8 * j)).astype(np.uint8)
        out.append(bits.tobytes()[: -(-len(part) * width // 8)])
    return b"".join(out)


def unpacked(data: bytes, skip: int, width: int, n: int) -> np.ndarray:
    """n values of width bits, of which the first begins at bit skip (below 8)."""
    rows, kind = -(-n // 8), np.dtype(np.uint32 if width <= 25 else np.uint64)
    raw = np.frombuffer(data + bytes(max(0, (rows + 1) * width + 8 - len(data))), np.uint8)
    out = np.empty((rows, 8), np.uint32)
    for k in range(8):
        byte, bit, touched = _bits_at(k, width, skip)
        own = np.zeros(rows, kind)
        for j in range(touched):
            own |= raw[byte + j :: width][:rows].astype(kind) << kind.type(8 * j)
        out[:, k] = (own >> kind.type(bit)) & kind.type((1 << width) - 1)
    return out.reshape(-1)[:n]


def _counts_by_bits(ids: np.ndarray) -> list[int]:
    """How many ids need how many bits, by way of how often each id stands there where ids are small."""
    if len(ids) and ids.max() < 1 << 20:
        n = np.bincount(ids)
        return np.bincount(np.frexp(np.arange(len(n), dtype=np.float64))[1], n, minlength=33).astype(np.int64).tolist()
    return np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=33).tolist()


def encoded(ids: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Widths, and the sections of all levels."""
    rest = ids.astype(np.uint32)
    widths = chunk_widths(_counts_by_bits(rest))
    out: list[bytes] = []
    for level, width in enumerate(widths):
        out.append(packed(rest & np.uint32((1 << width) - 1), width))
        more = (rest >> np.uint32(width)) > 0 if level + 1 < len(widths) else np.zeros(0, bool)
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        out += [np.packbits(more, bitorder="little").tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype("<u8").tobytes()]
        if level + 1 < len(widths):
            rest = rest[more] >> np.uint32(width)
    return widths, out


def token_file(doc_ids: Sequence[int | None], ends: Sequence[int], ids: np.ndarray) -> bytes:
    """The bytes of one file; ends are the bounds of the documents in ids, without the first 0."""
    widths, levels = encoded(ids)
    shape = np.array([len(doc_ids), len(ids), *widths], "<u8").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little").tobytes()
    sections = [shape, keys, nulls, np.array([0, *ends], "<u8").tobytes(), *levels]
    at = len(MAGIC) + 8 + 16 * len(sections)
    head = [MAGIC, struct.pack("<Q", len(sections))]
    for s in sections:
        head.append(struct.pack("<QQ", at, len(s)))
        at += -(-len(s) // 8) * 8
    return b"".join([*head, *(s + bytes(-len(s) % 8) for s in sections)])


class TokenFile:
    """Reads tokens of one file; fetch(begin, length) gives its bytes, and only those that an answer needs are asked for."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        magic, n = struct.unpack("<8sQ", fetch(0, 16))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.sections = list(struct.iter_unpack("<QQ", fetch(16, 16 * n)))
        shape = np.frombuffer(fetch(*self.sections[0]), "<u8").tolist()
        self.n_docs, self.n_tokens, self.widths = shape[0], shape[1], shape[2:]

    def _part(self, section: int, begin: int, length: int) -> bytes:
        return self.fetch(self.sections[section][0] + begin, length)

    def _numbers(self, section: int, begin: int, end: int, kind: str = "<u8") -> np.ndarray:
        return np.frombuffer(self._part(section, 8 * begin, 8 * (end - begin)), kind)

    def _rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before place i."""
        block = i // BLOCK
        before = int(self._numbers(6 + 3 * level, block, block + 1)[0])
        if i % BLOCK:
            bits = self._part(5 + 3 * level, block * BLOCK // 8, -(-(i % BLOCK) // 8))
            before += (int.from_bytes(bits, "little") & ((1 << i % BLOCK) - 1)).bit_count()
        return before

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level, width in enumerate(self.widths):
            bit = i * width
            chunk = int.from_bytes(self._part(4 + 3 * level, bit // 8, (bit % 8 + width + 7) // 8), "little")
            value |= (chunk >> bit % 8 & ((1 << width) - 1)) << shift
            if level + 1 == len(self.widths) or not self._part(5 + 3 * level, i // 8, 1)[0] >> i % 8 & 1:
                break
            i, shift = self._rank(level, i), shift + width
        return value

    def tokens(self, begin: int, end: int, level: int = 0) -> np.ndarray:
        """Tokens begin to end, from the matching stretch of each level."""
        width, n = self.widths[level], end - begin
        if n <= 0:
            return np.zeros(0, np.uint32)
        bit = begin * width
        out = unpacked(self._part(4 + 3 * level, bit // 8, (bit % 8 + width * n + 7) // 8), bit % 8, width, n)
        if level + 1 < len(self.widths):
            map_ = self._part(5 + 3 * level, begin // 8, (begin % 8 + n + 7) // 8)
            more = np.flatnonzero(np.unpackbits(np.frombuffer(map_, np.uint8), count=begin % 8 + n, bitorder="little")[begin % 8 :])
            first = self._rank(level, begin)
            out = out.copy()
            out[more] |= self.tokens(first, first + len(more), level + 1) << np.uint32(width)
        return out

    def documents(self, begin: int = 0, end: int | None = None) -> tuple[list[int | None], np.ndarray]:
        """Ids and token bounds of the documents begin to end."""
        end = self.n_docs if end is None else end
        nulls = np.unpackbits(np.frombuffer(self._part(2, 0, -(-self.n_docs // 8)), np.uint8), bitorder="little")[begin:end]
        keys = self._numbers(1, begin, end, "<i8").tolist()
        return [None if off else k for k, off in zip(keys, nulls, strict=False)], self._numbers(3, begin, end + 1)


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Any store that Arrow knows; a path without a scheme is a file, and `file:/x` (as Hadoop writes it) the same as `file:///x`."""
    if uri.startswith("/"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    docs: int
    tokens: int


@dataclass
class OneFile(InputPartition):
    name: str
    first: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        doc_ids, ends, ids, at = [], [], [], 0
        for batch in iterator:
            lists = batch.column(batch.schema.get_field_index("ids"))
            bounds = lists.offsets.to_numpy()
            doc_ids += batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            ends.append(bounds[1:].astype(np.int64) - int(bounds[0]) + at)
            # ids below 2 ** 16 are held in half the memory
            own = lists.values.to_numpy()[bounds[0] : bounds[-1]]
            ids.append(own.astype(np.uint16 if len(own) and own.min() >= 0 and own.max() < 1 << 16 else np.uint32))
            at += int(bounds[-1] - bounds[0])
        part = TaskContext.get().partitionId()
        if not doc_ids:
            return Written(part, "", 0, 0)
        fs, path = _place(self.path)
        fs.create_dir(path, recursive=True)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.dac"
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(token_file(doc_ids, np.concatenate(ends).tolist(), np.concatenate(ids)))
        release_memory()
        return Written(part, name, len(doc_ids), at)

    def commit(self, messages) -> None:
        fs, path = _place(self.path)
        fs.create_dir(path, recursive=True)
        manifest = f"{path}/_manifest.json"
        held = fs.get_file_info(manifest).type == pa.fs.FileType.File
        files = json.loads(fs.open_input_file(manifest).readall()) if held and not self.overwrite else []
        first = sum(f["tokens"] for f in files)
        for m in sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.part):
            files.append({"name": m.name, "docs": m.docs, "tokens": m.tokens, "first": first})
            first += m.tokens
        with fs.open_output_stream(manifest) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        fs, path = _place(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{path}/{m.name}")


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        fs, path = _place(self.path)
        # Without a file there is one partition with no rows: no partition at all would make Spark ask for one that is None.
        return [OneFile(f["name"], f["first"]) for f in json.loads(fs.open_input_file(f"{path}/_manifest.json").readall())] or [OneFile("", 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, path = _place(self.path)
        with fs.open_input_file(f"{path}/{partition.name}") as f:
            file = TokenFile(lambda at, n: f.read_at(n, at))
            doc_ids, bounds = file.documents()
            begin = 0
            while begin < file.n_docs:
                end = max(begin + 1, min(begin + 1000, int(np.searchsorted(bounds, bounds[begin] + np.uint64(READ_TOKENS), "right")) - 1))
                a, b = int(bounds[begin]), int(bounds[end])
                own = bounds[begin : end + 1].astype(np.int64)
                values = pa.array(file.tokens(a, b).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array((own - a).astype(np.int32)), values)
                cols = [pa.array(doc_ids[begin:end], pa.int64()), pa.array(own[:-1] + partition.first), pa.array(np.diff(own)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])
                begin = end
        release_memory()


class TokenSource(DataSource):
    """spark.read.format("token_codes").load(path); df.write.format("token_codes").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "token_codes"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids array<int>"

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenWriter:
        if not {"doc_id", "ids"} <= set(schema.names):
            raise ValueError("columns doc_id and ids are needed")
        return TokenWriter(self.options["path"], overwrite)

    def reader(self, schema: T.StructType) -> TokenReader:
        return TokenReader(self.options["path"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TokenSource)


#: Tokenizers, and what pieces have been encoded as: a Python worker keeps both from task to task.
_loaded: dict[str, tuple] = {}
#: When more pieces are known than this, only those that came first are kept: frequent ones are met early.
_KNOWN, _KEPT = 800_000, 300_000
#: Texts that the tokenizer's normaliser only puts in lower case: ASCII and the Latin letters that are no sequences.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
#: What the tokenizer's own pattern cuts such a text in lower case into, besides letters. Fixed by its file.
_OTHER, _DIGIT, _SHORT = r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+", r"[0-9]", r"'s|'t|'re|'ve|'m|'ll|'d"
_ONE = re.compile(rf"[a-zß-öø-įı-ſ]+|{_SHORT}|{_DIGIT}|{_OTHER}")
_CUT, _CUT_OTHER, _CUT_DIGIT = (re.compile(f"({x})") for x in (f"{_SHORT}|{_DIGIT}|{_OTHER}", _OTHER, _DIGIT))


def cut(text: str | None) -> str:
    """A plain text in lower case with spaces around all that isn't letters; other texts as they are."""
    if not text or not (text.isascii() or _PLAIN.fullmatch(text)) or "<|" in text:
        return text or ""
    text = text.lower()
    if "'" in text:
        return _CUT.sub(r" \1 ", text)
    text = _CUT_OTHER.sub(r" \1 ", text)  # two passes over sets of characters are faster than one over alternatives
    return _CUT_DIGIT.sub(r" \1 ", text) if _CUT_DIGIT.search(text) else text


def word_encoder(path: str, end_id: int):
    """Lists of ids of texts, each with the end id behind it.

    White space leaves no token and nothing reaches across it, so a text's ids are those of its words, and each distinct
    word is encoded once. In plain Latin texts words are first cut as the tokenizer's pattern does it, so that they are
    the pieces that many words share; other texts, and those with the name of a special token, keep their words. What is
    new is encoded together, in lines of some hundred: a piece ends with its only token that closes a word, another
    word's tokens are found by their offsets. Splitting, making distinct and spreading the ids is done in arrays.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _loaded:
        made = Tokenizer.from_file(path)
        closing = np.zeros(made.get_vocab_size(with_added_tokens=True), bool)
        closing[[i for w, i in made.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True
        _loaded[path] = (made, closing, {"": b""})
    tokenizer, closing, known = _loaded[path]
    kind = np.dtype("<u2" if max(len(closing), end_id + 1) <= 1 << 16 else "<u4")
    end = np.array([end_id], kind).tobytes()

    def keep(line: list[str], ids: np.ndarray, at: list[int]) -> None:
        data, n = ids.astype(kind).tobytes(), kind.itemsize
        for k, x in enumerate(line):
            known[x] = data[n * at[k] : n * at[k + 1]]

    def learn(new: list[str]) -> None:
        is_piece = [_ONE.fullmatch(w) is not None for w in new]
        one, other = ([w for w, p in zip(new, is_piece, strict=True) if p is q] for q in (True, False))
        lines = [one[i : i + 256] for i in range(0, len(one), 256)]
        for line, got in zip(lines, tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int64)
            keep(line, ids, [0, *(np.flatnonzero(closing[ids]) + 1).tolist()])
        for i in range(0, len(other), 256):
            line = other[i : i + 256]
            got = tokenizer.encode(" ".join(line), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in line[:-1]])
            keep(line, np.array(got.ids, np.int64), np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), begins).tolist() + [len(got.ids)])

    def kernel(texts: list[str | None]) -> dict:
        if len(known) > _KNOWN:
            for x in list(known)[_KEPT:]:
                del known[x]
        lists = pc.ascii_split_whitespace(pa.array(map(cut, texts), pa.large_string()))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        learn([w for w in distinct if w not in known])
        rows = pa.array([*map(known.__getitem__, distinct), end], pa.large_binary())
        # Every occurrence of a word, and an end behind each text, takes the distinct word's ids as bytes.
        which = np.insert(coded.indices.to_numpy(), bounds[1:] - bounds[0], len(distinct))
        _, offsets, data = rows.take(pa.array(which)).buffers()
        stop = np.frombuffer(offsets, np.int64, len(which) + 1) // kind.itemsize
        ids = np.frombuffer(data or b"", kind, int(stop[-1])).astype("<i4")
        ends = stop[1 + bounds[1:] - bounds[0] + np.arange(len(texts))]
        return {"ids": pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))}

    return kernel


def tokenizer_path(spark: SparkSession, tokenizer: str) -> str:
    """A file that executors have: their own installed copy of a public one by name, or any path that they share."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes them in ascending order of id.

    Texts are dealt to ranges of (id, hash of the text, row), so no id or text, however frequent, makes one task large,
    and are encoded behind the shuffle: ids are wider than the texts that they come from.
    """
    spark = docs.sparkSession
    register(spark)
    where = tokenizer_path(spark, tokenizer)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = src.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = map_texts(dealt, lambda: word_encoder(where, end_id), [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)], slice_chars=SLICE_TEXT)
    ids.write.format("token_codes").mode("append").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the files."""
    register(spark)
    return spark.read.format("token_codes").load(path)


def open_token_file(path: str) -> TokenFile:
    """One file, for reading single tokens and documents."""
    fs, where = _place(path)
    f = fs.open_input_file(where)
    return TokenFile(lambda at, n: f.read_at(n, at))


def with_crc(tokens: DataFrame) -> DataFrame:
    """The documents' ids as one checksum each: crc32 of little-endian unsigned 32-bit integers."""
    ship_package(tokens.sparkSession)
    bounded_batches(tokens.sparkSession)

    def run(batches):
        for batch in batches:
            *rest, lists = batch.columns
            at = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            data = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            sums = pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op12(spark, sf_dir: str) -> DataFrame:
    """Per document, read back from the files: where its tokens start, how many they are, their checksum.

    Null and empty texts have their end only; equal ids are documents of their own; an empty table gives no rows.
    """
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return with_crc(read_tokens(spark, path))
