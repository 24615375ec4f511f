"""Delimited text with positional keys and values, judged by the selected columns only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import composite
from .schemas import LINEITEM, YELLOW_TAXI, YELLOW_TRIPS

_WHOLE = r"^[+-]?[0-9]+$"
_REAL = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
_DATE = r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$"
#: Never in a text file.
_NEVER, _QUOTE = "\x01", "\x02"


def parsed(c: Column, kind: T.DataType) -> Column:
    """A field as its type; null where it doesn't parse. Blanks round a number are no number."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BinaryType):
        return F.encode(c, "UTF-8")
    if isinstance(kind, T.IntegerType | T.LongType):
        return F.when(c.rlike(_WHOLE), c.try_cast(kind))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(c.rlike(_REAL), c.try_cast(kind))
    if isinstance(kind, T.DateType):
        return F.when(c.rlike(_DATE), c.try_cast(kind))
    raise ValueError(f"unsupported column type {kind.simpleString()}")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, keys: list[int], values: list[int], delimiter: str = ",", header: bool = True) -> DataFrame:
    """Key columns, then value columns, by position.

    Ascending splits of the file are read by different tasks. A row stays if each selected column is there and
    parses; an empty field is an empty text but no number. Other columns, even surplus ones, don't matter, nor
    do blank lines. Quotes protect delimiters, doubled quotes stand for one; a line end always ends a row.
    """
    if not keys or not values:
        raise ValueError("key and value columns are needed")
    if bad := [k for k in (*keys, *values) if not 0 <= k < len(schema)]:
        raise ValueError(f"no columns {bad}")
    fields = schema.fields
    for k in (*keys, *values):
        parsed(F.lit(""), fields[k].dataType)  # raises for a type that no field can have
    # The reader only cuts lines, skips each file's header and blank lines: it can't tell an empty field from a missing one.
    lines = spark.read.schema("line string").options(sep=_NEVER, header=header, quote="", escape=_NEVER, mode="PERMISSIVE", enforceSchema=True, multiLine=False).csv(path)
    row = lines.select(tokens(F.col("line"), delimiter).alias("t"))
    picked = {k: parsed(F.get("t", F.lit(k)), fields[k].dataType) for k in dict.fromkeys((*keys, *values))}
    out = row.select(*(c.alias(fields[k].name) for k, c in picked.items()))
    for k in picked:
        out = out.where(F.col(fields[k].name).isNotNull())
    return out


def tokens(line: Column, delimiter: str = ",") -> Column:
    """Fields of a line. Quotes protect delimiters; two quotes inside quotes are one."""
    plain = re.escape(delimiter)
    line = F.regexp_replace(line, "\r$", "")
    quoted = F.split(line, plain + '(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)

    def unquote(f: Column) -> Column:
        whole = f.rlike('^".*"$')
        inner = F.when(whole, F.substr(f, F.lit(2), F.length(f) - 2)).otherwise(f)
        return F.translate(F.replace(F.replace(inner, F.lit('""'), F.lit(_QUOTE)), F.lit('"'), F.lit("")), _QUOTE, '"')

    return F.when(F.instr(line, '"') > 0, F.transform(quoted, unquote)).otherwise(F.split(line, plain, -1))


def read_lineitem(spark: SparkSession, path: str, keys=(8, 9, 13, 14, 15), values=(0, 3), delimiter: str = ",", header: bool = True) -> DataFrame:
    return read_delimited(spark, path, LINEITEM, list(keys), list(values), delimiter, header)


def read_yellow_taxi(spark: SparkSession, path: str, keys=(2,), values=(0,), delimiter: str = ",", header: bool = True) -> DataFrame:
    return read_delimited(spark, path, YELLOW_TAXI, list(keys), list(values), delimiter, header)


def as_key_value(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``key, value`` as composite bytes."""
    kinds = dict(df.dtypes)
    return df.select(composite([(F.col(c), kinds[c]) for c in keys]).alias("key"), composite([(F.col(c), kinds[c]) for c in values]).alias("value"))


#: Bytes that a selected column takes in an estimate, by type; text takes its length and two.
_WIDTHS = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}


def selected_bytes(schema: T.StructType, columns: list[str]) -> Column:
    """Estimated bytes of a row's selected columns: fixed width and one, text its length and two."""
    out = F.lit(0).cast("long")
    for f in schema:
        if f.name in columns:
            out = out + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 2 if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(_WIDTHS[type(f.dataType)] + 1)).cast("long")
    return out


def estimate_mb(sample_selected: float, sample_line: float, file_bytes: int) -> float:
    """Mean selected bytes times the rows that the file should hold, in MB."""
    return sample_selected * (file_bytes / max(sample_line, 1e-9)) / (1 << 20)


def normalise_trips(tables: list[DataFrame], start_year: int = 2011) -> DataFrame:
    """Trip tables of several vintages as one: names in lower case, 19 columns, cast where they can be, null where missing, from ``start_year``."""
    out = None
    for t in tables:
        have = {c.lower(): c for c in t.columns}
        t = t.select(*((F.col(f"`{have[f.name]}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in YELLOW_TRIPS))
        out = t if out is None else out.unionByName(t)
    return out.where(F.year("tpep_pickup_datetime") >= start_year)
