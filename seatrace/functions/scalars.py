"""Scalar functions of feature preparation and text cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x held within bounds; None leaves a side open; null stays null."""
    if low is not None:
        x = F.when(x < low, F.lit(float(low))).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(float(high))).otherwise(x)
    return x


def normalise(x: Column, low: float, high: float) -> Column:
    """[low, high] onto [-1, 1]."""
    return (x - (low + high) / 2) / ((high - low) / 2)


def is_outside(x: Column, low: float | None, high: float | None) -> Column:
    out = F.lit(False)
    if low is not None:
        out = out | F.coalesce(x < low, F.lit(False))
    if high is not None:
        out = out | F.coalesce(x > high, F.lit(False))
    return out


def is_special(x: Column, value) -> Column:
    return F.coalesce(x == F.lit(value), F.lit(False))


def datetime_parts(ts: Column) -> dict[str, Column]:
    """Parts of a time, scaled to about [0, 1]."""
    return {"year": F.year(ts) / 3000, "month": F.month(ts) / 12, "day": F.day(ts) / 31, "hour": F.hour(ts) / 24, "minute": F.minute(ts) / 60, "second": F.second(ts) / 60}


def fill_by_type(df: DataFrame, number: float = -1, text: str = "NoEntry") -> DataFrame:
    """Nulls (and NaN) of numeric columns become number, those of text columns text."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.coalesce(F.nanvl(F.col(f.name), F.lit(None)), F.lit(number)).cast(f.dataType)
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(number)).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(text))
    return df.withColumns(out)


def numbers(s: Column, kind: str = "double") -> Column:
    """Numbers among the tokens between white space."""
    return F.filter(F.transform(F.split(s, r"\s+"), lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$" if kind == "double" else r"^[+-]?\d+$"), t.cast(kind))), lambda v: v.isNotNull())


def iso_time(s: Column) -> Column:
    """ISO text to a time; null for short or unreadable text."""
    return F.when(F.length(s) > 5, F.try_to_timestamp(s).cast("timestamp_ntz"))


#: Fixed phrases that the cleaners take out, as patterns.
TYPE_PHRASES = ("all ships of this type", "not available or no ship, default", r"\(.*\)", "for assignment to local vessel", "reserved for future use", "no additional information", "reserved for regional use", "null", "no designation")
STATUS_PHRASES = ("reserved for future amendment of navigational status for ships.*", "undefined.*", r"\xa0")


def clean_text(s: Column, phrases: Sequence[str] = TYPE_PHRASES) -> Column:
    """Lower case, without the phrases and the commas and stops around them, single spaces, SAR in capitals; null becomes empty."""
    shorter = F.regexp_replace(F.lower(s), rf"[\s,.]*(?:{'|'.join(phrases)})[\s,.]*", " ")
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(shorter, r"\s+", " "), r"\bsar\b", "SAR")), F.lit(""))


def short_type(s: Column) -> Column:
    """A type's short name: without what stands in brackets and after a comma, if it ends with a bracket."""
    return F.when(s.endswith(")"), F.trim(F.regexp_replace(F.regexp_replace(s, r"\(.*\)", ""), ",.*", ""))).otherwise(s)


def aspect_ratio(width: Column, length: Column) -> Column:
    return F.try_divide(width, length)


def crc_bucket(x: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(x.cast("string").cast("binary")), F.lit(buckets))


def base2(code: Column, bits: int) -> list[Column]:
    """Bits of a code, the highest first."""
    return [F.shiftright(code, b).bitwiseAND(F.lit(1)).cast("int") for b in range(bits - 1, -1, -1)]


def one_hot(value: Column, categories: Sequence) -> list[Column]:
    return [F.coalesce(value == F.lit(c), F.lit(False)).cast("int") for c in categories]


def det2(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * d - b * c


def inverse2_mod(m: Sequence[int], modulus: int) -> tuple[int, ...] | None:
    """Inverse of a 2 by 2 integer matrix modulo a number, or None where there is none."""
    a, b, c, d = m
    try:
        inv = pow((a * d - b * c) % modulus, -1, modulus)
    except ValueError:
        return None
    return tuple(x * inv % modulus for x in (d, -b, -c, a))


def flatten_schema(schema: T.StructType, prefix: str = "") -> list[tuple[Column, str]]:
    """Leaf columns of nested structs, named by their path with an underscore after every part."""
    out = []

    def walk(path: Column, name: str, kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(path[f.name], f"{name}{f.name}_", f.dataType)
        else:
            out.append((path, name))

    for f in schema.fields:
        walk(F.col(f.name), f"{prefix}{f.name}_", f.dataType)
    return out


def flatten_json(value, prefix: str = "") -> dict:
    """A parsed JSON value as a flat dict; list indexes are parts of the path, too."""
    if isinstance(value, dict):
        items = value.items()
    elif isinstance(value, list):
        items = enumerate(value)
    else:
        return {prefix: value}
    out: dict = {}
    for k, v in items:
        out |= flatten_json(v, f"{prefix}{k}_")
    return out


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
