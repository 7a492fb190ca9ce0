"""Headers that drift between files: names that mean the same become one, until a file has as many names as most files.

Names are merged in falling order of likeness times how often the other name occurs, so rare spellings go to frequent ones.
Only names that share a pair of letters are compared, found by a join on these pairs; names that share single letters at
most are compared only if the others didn't bring the number of names down far enough.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrace.shipping import ship_package

from .archives import ZippedCsv, file_system, header_names, list_members


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def likeness(a: str, b: str) -> float:
    """Twice the common letters over all letters: 0 to 1."""
    return 2 * common_letters(a, b) / (len(a) + len(b)) if a or b else 1.0


def merged_names(counts: dict[str, int], pairs: Iterable[tuple[str, str]], width: int) -> dict[str, str]:
    """What each name is called, merging pairs (in both directions) in order until `width` names are left or pairs end."""
    called = {n: n for n in counts}
    left = len(called)
    ranked = sorted(((-likeness(a, b) * counts[b], a, b) for x, y in pairs for a, b in ((x, y), (y, x)) if x != y))
    for _, a, b in ranked:
        if left <= width:
            break
        old, new = called[a], called[b]
        if old != new:
            called = {n: new if c == old else c for n, c in called.items()}
            left -= 1
    return called


def _candidates(names: DataFrame, size: int) -> DataFrame:
    text = F.concat(F.lit(" ") if size > 1 else F.lit(""), F.lower("name"), F.lit(" ") if size > 1 else F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substring(text, i, F.lit(size)))
    by = names.select("name", F.explode(F.array_distinct(grams)).alias("gram"))
    return by.join(by.withColumnRenamed("name", "other"), "gram").where("name < other").select("name", "other").distinct()


def renames(headers: DataFrame) -> dict[str, str]:
    """Names to their common name, from headers (file, name). The distinct names of all files are bounded by the headers that
    people have written, not by rows; they and their candidate pairs come to the driver."""
    held = headers.where("name is not null and name <> ''").select("file", "name").distinct()
    counts = {r["name"]: r["n"] for r in held.groupBy("name").agg(F.count("*").alias("n")).collect()}
    sizes = held.groupBy("file").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "n").first()
    if sizes is None or len(counts) <= sizes["n"]:
        return {n: n for n in counts}
    names = held.select("name").distinct()
    out: dict[str, str] = {}
    for size in (2, 1):
        pairs = [tuple(r) for r in _candidates(names, size).collect()]
        out = merged_names(counts, pairs, sizes["n"])
        if len(set(out.values())) <= sizes["n"]:
            break
    return out


def read_headers(spark: SparkSession, path: str, *, member: str = "*.csv") -> DataFrame:
    """(file, name) of the header of each CSV member of zip archives."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                fs, where = file_system(row["archive"])
                with fs.open_input_file(where) as f, zipfile.ZipFile(f) as z, z.open(row["member"]) as stream:
                    rows += [(f"{row['archive']}/{row['member']}", n) for n in header_names(stream)]
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["file", "name"])

    return list_members(spark, path, member=member).select("archive", "member").mapInArrow(run, "file string, name string")


def read_drifted(spark: SparkSession, path: str, *, member: str = "*.csv") -> DataFrame:
    """All rows of CSV members with drifted headers as one table of text, under the common names, and where they are from."""
    called = renames(read_headers(spark, path, member=member))
    spark.dataSource.register(ZippedCsv)
    columns = [*sorted(set(called.values())), "archive", "member"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("zipped_csv").option("member", member).option("renames", json.dumps(called)).schema(schema).load(path)
