"""Zip archives: their members as a data source, read as a stream, and extraction that does nothing twice.

Archives are opened through Arrow's file systems (local, HDFS, object stores), which can seek: a task reads an archive's
directory and its own member, never the whole archive, and holds some blocks of the member at a time (the CSV parser reads
about 32 ahead).
"""

from __future__ import annotations

import csv
import fnmatch
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seatrace.shipping import ship_package

from .ais import CANONICAL, KEY, NEEDED, canonical, nan_to_null

BLOCK = 1 << 18
#: Rows from which types are guessed.
SNIFFED = 1000


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Any store that Arrow knows; a path without a scheme is a file, `file:/x` the same as `file:///x`."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def find_archives(path: str) -> list[str]:
    """Archives at a path: a file, or all `.zip` files below a folder, by name."""
    fs, where = file_system(path)
    prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
    info = fs.get_file_info(where)
    if info.type == pa.fs.FileType.File:
        return [path]
    found = fs.get_file_info(pa.fs.FileSelector(where, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == pa.fs.FileType.File and f.path.lower().endswith(".zip"))


def members(archive: str, pattern: str = "*") -> list[zipfile.ZipInfo]:
    fs, where = file_system(archive)
    with fs.open_input_file(where) as f, zipfile.ZipFile(f) as z:
        return [i for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, pattern)]


@dataclass
class Member(InputPartition):
    archive: str
    name: str


def header_names(stream) -> list[str]:
    """The names in the first line of a CSV stream, none in an empty one."""
    head = stream.readline()
    return [n.strip() for n in next(csv.reader([head.decode("utf-8-sig").strip("\r\n")]))] if head.strip() else []


def csv_batches(stream, columns: Sequence[str], block: int = BLOCK, renames: dict[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    """A CSV stream with a header as batches of text columns; lines of another length are left out, absent columns null.

    renames: what columns are called instead; of several columns that get one name the first counts.
    """
    names = header_names(stream)
    if not names:
        return
    try:
        reader = pa.csv.open_csv(
            pa.PythonFile(stream, mode="r"),
            read_options=pa.csv.ReadOptions(column_names=[str(i) for i in range(len(names))], block_size=block),
            parse_options=pa.csv.ParseOptions(invalid_row_handler=lambda row: "skip"),
            convert_options=pa.csv.ConvertOptions(column_types={str(i): pa.string() for i in range(len(names))}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid as e:
        if "Empty CSV" in str(e):  # a header alone
            return
        raise
    at: dict[str, int] = {}
    for i, n in enumerate(names):
        at.setdefault((renames or {}).get(n, n), i)
    for batch in reader:
        yield pa.RecordBatch.from_arrays([batch.column(at[c]) if c in at else pa.nulls(len(batch), pa.string()) for c in columns], list(columns))


class ZippedCsvReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, columns: list[str], renames: dict[str, str]):
        self.path, self.pattern, self.columns, self.renames = path, pattern, columns, renames

    def partitions(self) -> Sequence[InputPartition]:
        return [Member(a, i.filename) for a in find_archives(self.path) for i in members(a, self.pattern)] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, where = file_system(partition.archive)
        own = [c for c in self.columns if c not in ("archive", "member")]
        with fs.open_input_file(where) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as stream:
            for batch in csv_batches(stream, own, renames=self.renames):
                fixed = {"archive": partition.archive, "member": partition.name}
                cols = [pa.array([fixed[c]] * len(batch), pa.string()) if c in fixed else batch.column(own.index(c)) for c in self.columns]
                yield pa.RecordBatch.from_arrays(cols, self.columns)


class ZippedCsv(DataSource):
    """spark.read.format("zipped_csv").load(path): CSV members of zip archives, one partition each, all columns text.

    Option `member` is a pattern of member names (`*.csv`). Without a schema the columns are those of the first member's
    header; columns named archive and member say where a row is from. Option `renames` is JSON, a name to another.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        for a in find_archives(self.options["path"]):
            for i in members(a, self.options.get("member", "*.csv")):
                fs, where = file_system(a)
                with fs.open_input_file(where) as f, zipfile.ZipFile(f) as z, z.open(i) as stream:
                    names = header_names(stream)
                quoted = ["`" + n.replace("`", "``") + "` string" for n in names if n]
                if quoted:
                    return ", ".join([*quoted, "archive string", "member string"])
        return "archive string, member string"

    def reader(self, schema: T.StructType) -> ZippedCsvReader:
        if any(not isinstance(f.dataType, T.StringType) for f in schema.fields):
            raise ValueError("zipped_csv gives text columns; cast them afterwards")
        return ZippedCsvReader(self.options["path"], self.options.get("member", "*.csv"), schema.names, json.loads(self.options.get("renames", "{}")))


def read_zipped(spark: SparkSession, path: str, *, member: str = "*.csv", columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of the CSV members of zip archives as text."""
    ship_package(spark)
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format("zipped_csv").option("member", member)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.load(path)


def guessed_types(df: DataFrame, *, rows: int = SNIFFED) -> dict[str, T.DataType]:
    """Types of text columns by their first values: mmsi is a number, then numbers, times, text; a column without values is text."""
    kinds = {"double": T.DoubleType(), "time": T.TimestampNTZType()}
    tests = {"double": lambda c: c.try_cast("double").isNotNull(), "time": lambda c: F.try_to_timestamp(c).isNotNull()}
    held = df.limit(rows)
    asked = [F.coalesce(F.min(F.when(F.col(f"`{c}`").isNotNull(), test(F.trim(F.col(f"`{c}`"))))), F.lit(False)).alias(f"{k}:{c}") for c in df.columns for k, test in tests.items()]
    row = held.agg(*asked).first() if asked else {}
    out: dict[str, T.DataType] = {}
    for c in df.columns:
        held_by = next((k for k in tests if row[f"{k}:{c}"]), None)
        out[c] = T.LongType() if c.lower() == "mmsi" else kinds.get(held_by, T.StringType())
    return out


def typed(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Text columns cast to types; what can't be cast is null."""

    def one(c: str) -> Column:
        text = F.trim(F.col(f"`{c}`"))
        if isinstance(types[c], T.StringType):
            return F.col(f"`{c}`")
        if isinstance(types[c], T.TimestampNTZType):
            return F.try_to_timestamp(text).cast("timestamp_ntz").alias(c)
        return (text.try_cast("double").try_cast("bigint") if isinstance(types[c], T.LongType) else text.try_cast(types[c])).alias(c)

    return df.select(*map(one, df.columns))


def read_reports(spark: SparkSession, path: str, *, member: str = "*.csv", types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Position reports of zipped CSV: types guessed, names made canonical, one row for each complete ship and time."""
    raw = read_zipped(spark, path, member=member).drop("archive", "member")
    df = nan_to_null(canonical(typed(raw, types or guessed_types(raw))))
    absent = [c for c in NEEDED if c not in df.columns]
    if absent:
        raise ValueError(f"no column for {absent}; known names are {sorted(CANONICAL)}")
    return df.dropna(how="any", subset=list(NEEDED)).dropDuplicates(list(KEY))


_LISTED = "archive string, member string, bytes bigint, crc bigint"


def list_members(spark: SparkSession, path: str, *, member: str = "*") -> DataFrame:
    """(archive, member, bytes, crc) from the archives' directories; an archive that can't be read fails the job."""
    ship_package(spark)
    found = find_archives(path)
    if not found:
        return spark.createDataFrame([], _LISTED)

    def run(batches):
        for batch in batches:
            rows = [(a, i.filename, i.file_size, i.CRC) for a in batch.column(0).to_pylist() for i in members(a, member)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "member", "bytes", "crc"])

    return spark.createDataFrame([(a,) for a in found], "archive string").repartition(min(len(found), 1000)).mapInArrow(run, _LISTED)


def extract(spark: SparkSession, path: str, out: str, *, member: str = "*") -> DataFrame:
    """Extracts what hasn't been extracted yet, and gives (archive, member, bytes, crc, file) of what is new.

    Files lie under out/<archive name>/<member>. The table out/_extracted names what is done; it is joined left_anti, so a
    second run opens no member. A member whose content has changed counts as new. A file is written beside its place and
    moved there when it is whole, so a repeated task does no harm; the table is written last.
    """
    listed = list_members(spark, path, member=member)
    fs, where = file_system(out)
    done = f"{out.rstrip('/')}/_extracted"
    schema = _LISTED + ", file string"
    if fs.get_file_info(f"{where.rstrip('/')}/_extracted").type == pa.fs.FileType.Directory:
        listed = listed.join(spark.read.schema(schema).parquet(done), ["archive", "member", "bytes", "crc"], "left_anti")

    def run(batches):
        store, root = file_system(out)
        for batch in batches:
            for row in batch.to_pylist():
                source, at = file_system(row["archive"])
                folder = row["archive"].rsplit("/", 1)[-1].removesuffix(".zip")
                parts = [p for p in row["member"].replace("\\", "/").split("/") if p not in ("", ".", "..")]  # stays below out
                target = "/".join([root.rstrip("/"), folder, *parts])
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with source.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(row["member"]) as stream, store.open_output_stream(beside := f"{target}.{uuid.uuid4().hex}") as o:
                    while block := stream.read(BLOCK):
                        o.write(block)
                store.move(beside, target)
                yield pa.RecordBatch.from_pylist([{**row, "file": target[len(root.rstrip("/")) + 1 :]}], schema=pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("crc", pa.int64()), ("file", pa.string())]))

    # A task for each member, up to a bound; members behind it share tasks one after the other.
    new = listed.repartition(1000, "archive", "member").mapInArrow(run, schema)
    label = f"{done}/run={uuid.uuid4().hex}"
    new.write.parquet(label)
    return spark.read.schema(schema).parquet(label)
