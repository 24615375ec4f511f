"""Offset-value codes of sorted byte keys, as window expressions.

A code says where a key leaves its predecessor and with which bytes; comparing codes mostly replaces
comparing keys, and the shared prefix need not be stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Flags, in their order.
EARLY_FENCE, DUPLICATE, NORMAL, INITIAL, LATE_FENCE = range(5)
MAX_OFFSET = 8191
#: Bytes of value in a code of 32 and of 64 bits.
CHUNK = {32: 2, 64: 6}


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two binary columns."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.filter(F.sequence(F.lit(1), n + 1), lambda j: (j > n) | (F.substr(a, j, F.lit(1)) != F.substr(b, j, F.lit(1))))
    return F.coalesce(F.array_min(at) - 1, F.lit(0)).cast("int")


def offset(key: Column, before: Column, bits: int = 32) -> Column:
    """Common prefix with the predecessor, down to a whole chunk."""
    c = CHUNK[bits]
    return (F.floor(common_prefix(key, before) / c) * c).cast("int")


def _chunk(key: Column, at: Column, bits: int) -> Column:
    """The bytes of ``key`` that a code holds, as a number; zeros follow a key that ends."""
    c = CHUNK[bits]
    return F.conv(F.rpad(F.hex(F.substr(key, at + 1, F.lit(c))), 2 * c, "0"), 16, 10).cast("long")


def code(key: Column, before: Column, bits: int = 32) -> Column:
    """Code of ``key`` after ``before`` (null: the first of its run); null if the key is smaller. Offsets stop at 8191."""
    c, shift = CHUNK[bits], 8 * CHUNK[bits]
    at = offset(key, before, bits)
    value = _chunk(key, at, bits)
    flag = lambda k: F.lit(k << (shift + 13) if k << (shift + 13) < 1 << 63 else (k << (shift + 13)) - (1 << 64)).cast("long")
    normal = value.bitwiseOR(F.shiftleft((F.lit(MAX_OFFSET) - F.least(at, F.lit(MAX_OFFSET))).cast("long"), shift)).bitwiseOR(flag(NORMAL))
    return F.when(before.isNull(), flag(INITIAL)).when(key == before, flag(DUPLICATE)).when(key > before, normal)


def with_codes(df: DataFrame, key: str, run: list[str], tiebreak: list[str], bits: int = 32) -> DataFrame:
    """Adds ``ovc`` and ``ovc_offset`` to the rows of each run (a partition of the window), in key order."""
    w = Window.partitionBy(*run).orderBy(key, *tiebreak)
    out = df.withColumn("_before", F.lag(key).over(w))
    k, b = F.col(key), F.col("_before")
    shared = F.when(b.isNull() | (k == b), F.lit(0)).otherwise(offset(k, b, bits))
    return out.withColumns({"ovc": code(k, b, bits), "ovc_offset": shared}).drop("_before")


def flag_of(code_column: Column, bits: int = 32) -> Column:
    return F.shiftrightunsigned(code_column, 8 * CHUNK[bits] + 13).cast("int")


def offset_of(code_column: Column, bits: int = 32) -> Column:
    """Offset in a normal code, 0 for the others."""
    at = F.lit(MAX_OFFSET) - F.shiftrightunsigned(code_column, 8 * CHUNK[bits]).bitwiseAND(F.lit(MAX_OFFSET).cast("long"))
    return F.when(flag_of(code_column, bits) == NORMAL, at).otherwise(0).cast("int")


def describes(key: Column, before: Column, code_column: Column, bits: int = 32) -> Column:
    """Whether what a code says of ``key`` after ``before`` is true, be its offset as far as it could be or not."""
    at = offset_of(code_column, bits)
    start = lambda k: F.substr(k, F.lit(1), at)
    value = code_column.bitwiseAND(F.lit((1 << 8 * CHUNK[bits]) - 1).cast("long"))
    normal = (at <= F.octet_length(key)) & (at <= F.octet_length(before)) & (start(key) == start(before)) & (value == _chunk(key, at, bits))
    flag = flag_of(code_column, bits)
    known = F.when(before.isNull(), flag == INITIAL).when(flag == DUPLICATE, key == before).when(flag == NORMAL, normal)
    return F.coalesce(known, F.lit(False))


def consistency(df: DataFrame, key: str, run: list[str], tiebreak: list[str], bits: int = 32) -> DataFrame:
    """Per run: rows, whether every given ``ovc`` is true of its key (``consistent``) and is the one its predecessor gives (``optimal``)."""
    w = Window.partitionBy(*run).orderBy(key, *tiebreak)
    k, b = F.col(key), F.lag(key).over(w)
    seen = df.withColumns({"_want": code(k, b, bits), "_true": describes(k, b, F.col("ovc"), bits)})
    return seen.groupBy(*run).agg(F.count("*").alias("n_rows"), F.bool_and("_true").alias("consistent"), F.bool_and(F.col("ovc").eqNullSafe(F.col("_want"))).alias("optimal"))


def max_code(a: Column, b: Column) -> Column:
    """The greater code, unsigned. For keys x <= y <= z the codes of y after x and of z after y give that of z after x."""
    flip = F.lit(-(1 << 63))
    return F.when(a.bitwiseXOR(flip) >= b.bitwiseXOR(flip), a).otherwise(b)


def compare(a: Column, code_a: Column, b: Column, code_b: Column, bits: int = 32) -> Column:
    """Compares two keys by their codes after one common base, and by their bytes where the codes are equal.

    Struct: ``order`` (-1, 0, 1), ``by_code`` (no byte was needed), ``bytes_compared`` and ``loser_code``, the code of the
    greater key (of ``b`` if they are equal) after the smaller one. Codes whose offset stopped at 8191 are told apart by bytes.
    """
    capped = (offset_of(code_a, bits) == MAX_OFFSET) | (offset_of(code_b, bits) == MAX_OFFSET)
    twice = (code_a == code_b) & (flag_of(code_a, bits) == DUPLICATE)
    by_code = (code_a != code_b) & ~capped | twice
    smaller = F.when((code_a == code_b) | capped, a <= b).otherwise(max_code(code_a, code_b) == code_b)
    order = F.when(twice | (~by_code & (a == b)), 0).when(smaller, -1).otherwise(1)
    fresh = F.when(a <= b, code(b, a, bits)).otherwise(code(a, b, bits))
    spent = F.when(by_code, 0).otherwise(F.greatest(F.lit(0), common_prefix(a, b) + 1 - F.least(offset_of(code_a, bits), offset_of(code_b, bits))))
    return F.struct(order.alias("order"), by_code.alias("by_code"), spent.cast("int").alias("bytes_compared"), F.when(by_code, max_code(code_a, code_b)).otherwise(fresh).alias("loser_code"))


def stored_bytes(key: Column, value: Column, code_column: Column, shared: Column, bits: int = 32) -> tuple[Column, Column]:
    """Bytes of a record stored plain (lengths, key, value) and with its code instead of the shared prefix."""
    k, v = F.octet_length(key), F.octet_length(value)
    return (k + v + 8).cast("long"), F.when(flag_of(code_column, bits) == DUPLICATE, v + 8).otherwise(k - shared + v + 12).cast("long")
