"""Order-preserving byte encodings: unsigned byte order of the result is the order of the values.

Integers and dates are expressions; IEEE bits and 128-bit integers need Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Days from 0001-01-01 (day 1) to 1970-01-01.
DAYS_TO_EPOCH = 719163
SEPARATOR = b"\x00"


def encode_i32(c: Column) -> Column:
    """4 bytes, big-endian, sign bit flipped."""
    flipped = (c.cast("long") + F.lit(1 << 31)).cast("long")
    return F.unhex(F.lpad(F.hex(flipped), 8, "0"))


def encode_i64(c: Column) -> Column:
    """8 bytes, big-endian, sign bit flipped."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"))


def encode_date(c: Column) -> Column:
    """Days counted from 0001-01-01, as a 32-bit integer."""
    return encode_i32(F.unix_date(c) + DAYS_TO_EPOCH)


def encode_text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _float_bytes(a: np.ndarray) -> pa.Array:
    n, size = len(a), a.dtype.itemsize
    bits = a.view(f"u{size}")
    top = bits.dtype.type(1 << (8 * size - 1))
    out = np.where(bits & top, ~bits, bits | top).astype(f">u{size}")
    return pa.Array.from_buffers(pa.binary(size), n, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _masked(out: pa.Array, like: pa.Array) -> pa.Array:
    return out if not like.null_count else pa.compute.if_else(like.is_valid(), out, pa.scalar(None, pa.binary()))


@arrow_udf(T.BinaryType())
def encode_f64(c: pa.Array) -> pa.Array:
    """8 bytes: negative values all bits flipped, others the sign bit; tells -0.0 from 0.0, NaN by its sign goes to an end."""
    return _masked(_float_bytes(np.ascontiguousarray(c.fill_null(0.0).to_numpy(zero_copy_only=False), np.float64)), c)


@arrow_udf(T.BinaryType())
def encode_f32(c: pa.Array) -> pa.Array:
    """4 bytes, as ``encode_f64``."""
    return _masked(_float_bytes(np.ascontiguousarray(c.fill_null(0.0).to_numpy(zero_copy_only=False), np.float32)), c)


@arrow_udf(T.BinaryType())
def encode_i128(c: pa.Array) -> pa.Array:
    """16 bytes of a decimal(38, 0), sign bit flipped."""
    return pa.array([None if x is None else ((int(x) + (1 << 127)) & ((1 << 128) - 1)).to_bytes(16, "big") for x in c.to_pylist()], pa.binary())


def _checked(c: Column, size: int) -> Column:
    return F.when(c.isNull() | (F.octet_length(c) == size), c).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} bytes, got "), F.octet_length(c).cast("string"))).cast("binary"))


def decode_i32(c: Column) -> Column:
    return (F.conv(F.hex(_checked(c, 4)), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")


def decode_i64(c: Column) -> Column:
    c = _checked(c, 8)
    high, low = (F.conv(F.hex(F.substring(c, k, 4)), 16, 10).cast("long") for k in (1, 5))
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def decode_date(c: Column) -> Column:
    return F.date_from_unix_date(decode_i32(c) - DAYS_TO_EPOCH)


def decode_text(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def _from_float_bytes(rows: list, size: int) -> np.ndarray:
    if bad := next((len(b) for b in rows if b is not None and len(b) != size), None):
        raise ValueError(f"expected {size} bytes, got {bad}")
    bits = np.frombuffer(b"".join(b or bytes(size) for b in rows), f">u{size}").astype(f"u{size}")
    top = bits.dtype.type(1 << (8 * size - 1))
    return np.where(bits & top, bits ^ top, ~bits).astype(f"u{size}").view(f"f{size}")


@arrow_udf(T.DoubleType())
def decode_f64(c: pa.Array) -> pa.Array:
    rows = c.to_pylist()
    return pa.array(_from_float_bytes(rows, 8), pa.float64(), mask=np.array([b is None for b in rows], bool))


@arrow_udf(T.FloatType())
def decode_f32(c: pa.Array) -> pa.Array:
    rows = c.to_pylist()
    return pa.array(_from_float_bytes(rows, 4), pa.float32(), mask=np.array([b is None for b in rows], bool))


@F.pandas_udf(T.DecimalType(38, 0))
def decode_i128(c: pd.Series) -> pd.Series:
    from decimal import Decimal

    return c.map(lambda b: None if b is None else Decimal(int.from_bytes(b, "big") - (1 << 127)))


#: Kind of a column's encoding: encoder, decoder, width in bytes (None: up to the separator).
CODECS = {
    "int": (encode_i32, decode_i32, 4),
    "bigint": (encode_i64, decode_i64, 8),
    "float": (encode_f32, decode_f32, 4),
    "double": (encode_f64, decode_f64, 8),
    "date": (encode_date, decode_date, 4),
    "decimal(38,0)": (encode_i128, decode_i128, 16),
    "string": (encode_text, decode_text, None),
    "binary": (lambda c: c, lambda c: c, None),
}


def encode(c: Column, kind: str) -> Column:
    if kind not in CODECS:
        raise ValueError(f"no order-preserving encoding for {kind}")
    return CODECS[kind][0](c)


def decode_any(c: Column, kind: str) -> Column:
    """Text of an encoded value; an unknown kind gives ``<n bytes>``."""
    if kind in ("binary",):
        return F.hex(c)
    if kind not in CODECS:
        return F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    return CODECS[kind][1](c).cast("string")


def composite(columns: list[tuple[Column, str]]) -> Column:
    """Encoded columns joined by one zero byte. Its order is the columns' order if no text holds a zero byte."""
    parts: list[Column] = []
    for k, (c, kind) in enumerate(columns):
        parts += ([F.lit(SEPARATOR)] if k else []) + [encode(c, kind)]
    return F.concat(*parts)


def split_composite(key: bytes, kinds: list[str]) -> list[bytes]:
    """Encoded columns of a composite key: fixed widths by kind, others up to the next separator."""
    out, at = [], 0
    for k, kind in enumerate(kinds):
        width = CODECS[kind][2]
        end = at + width if width else len(key) if k == len(kinds) - 1 else key.index(SEPARATOR, at)
        out.append(key[at:end])
        at = end + 1
    return out


def composite_parts(key: Column, kinds: list[str]) -> Column:
    """Array of the encoded columns of a composite key."""

    @arrow_udf(T.ArrayType(T.BinaryType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else split_composite(x, kinds) for x in b.to_pylist()], pa.list_(pa.binary()))

    return run(key)
