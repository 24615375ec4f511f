"""Skewed data sets, as functions of the row number: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zeta(n: int, theta: float) -> float:
    return sum(i**-theta for i in range(1, n + 1))


def zeta_fast(n: int, theta: float, head: int = 100_000) -> float:
    """The sum for large ``n``: its head, and the integral with end corrections for the rest."""
    if n <= head:
        return zeta(n, theta)
    whole = lambda x: x ** (1 - theta) / (1 - theta)
    return zeta(head, theta) + whole(n) - whole(head) + (n**-theta - head**-theta) / 2


def zipf(u: Column, n: int, theta: float) -> Column:
    """Zipf-distributed rank, from 0, of a uniform number; closed form for theta in [0, 1)."""
    if not 0 <= theta < 1:
        raise ValueError("theta must be in [0, 1)")
    zn = zeta_fast(n, theta)
    alpha = 1 / (1 - theta)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / zn) if n > 2 else 1.0
    tail = F.floor(n * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(u * zn < 1, 0).when(u * zn < 1 + 0.5**theta, 1).otherwise(F.least(tail, F.lit(n - 1))).cast("long")


def _digits(seed: int, salt: int) -> Column:
    """Hexadecimal digits of a hash of the row ``id``; any engine with MD5 makes the same."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("id")).cast("binary"))


def uniform(seed: int, salt: int) -> Column:
    """Uniform number in [0, 1) of the row ``id``."""
    return F.conv(F.substring(_digits(seed, salt), 1, 13), 16, 10).cast("long") / float(1 << 52)


def random_u64(seed: int, salt: int) -> Column:
    """64 random bits of the row ``id``, as a signed number."""
    return F.conv(F.substring(_digits(seed, salt), 1, 16), 16, -10).cast("long")


def little_endian(c: Column) -> Column:
    """8 bytes of a 64-bit number, lowest first; byte order is then not the order of the numbers."""
    h = F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8))))


def big_endian(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def payload(n: Column | int, seed: int) -> Column:
    """``n`` bytes: a hash of the row, repeated."""
    unit = F.hex(F.xxhash64("id", F.lit(seed), F.lit(99)))
    unit = F.lpad(unit, 16, "0")
    n = F.lit(n) if isinstance(n, int) else n
    return F.encode(F.substr(F.repeat(unit, F.ceil(n / 16).cast("int")), F.lit(1), n.cast("int")), "UTF-8")


def zipf_gensort(spark: SparkSession, rows: int, theta: float, seed: int = 1) -> DataFrame:
    """Ten-digit decimal keys with Zipf ranks over ``rows``, 90 bytes of payload."""
    return spark.range(rows).select(F.encode(F.lpad(zipf(uniform(seed, 1), rows, theta).cast("string"), 10, "0"), "UTF-8").alias("key"), payload(90, seed).alias("value"))


def _numbered(key: Column, value: Column, order: str) -> list[Column]:
    return [key.alias("key_num"), (little_endian if order == "little" else big_endian)(key).alias("key"), value.alias("value")]


def freq_key(spark: SparkSession, rows: int, heavy: int = 42, fraction: float = 0.5, value_bytes: int = 512, seed: int = 1, order: str = "little") -> DataFrame:
    """``fraction`` of the rows have one key, all payloads are alike in size. ``key_num`` is the key as a number."""
    other = random_u64(seed, 2)
    key = F.when(uniform(seed, 1) < fraction, F.lit(heavy).cast("long")).otherwise(F.when(other == heavy, other + 1).otherwise(other))
    return spark.range(rows).select(*_numbered(key, payload(value_bytes, seed), order))


def heavy_key(spark: SparkSession, rows: int, heavy: int = 42, fraction: float = 0.1, heavy_bytes: int = 32 << 10, light_bytes: int = 128, seed: int = 1, order: str = "little") -> DataFrame:
    """One key has ``fraction`` of the rows and far larger payloads."""
    hot, other = uniform(seed, 1) < fraction, random_u64(seed, 2)
    key = F.when(hot, F.lit(heavy).cast("long")).otherwise(F.when(other == heavy, other + 1).otherwise(other))
    return spark.range(rows).select(*_numbered(key, payload(F.when(hot, heavy_bytes).otherwise(light_bytes), seed), order))


def heavy_range(spark: SparkSession, rows: int, hot_range: int = 1 << 16, fraction: float = 0.2, heavy_bytes: int = 32 << 10, light_bytes: int = 128, seed: int = 1, order: str = "little") -> DataFrame:
    """``fraction`` of the rows have keys below ``hot_range`` and large payloads. With ``order="big"`` they are neighbours in byte order too."""
    hot, r = uniform(seed, 1) < fraction, random_u64(seed, 2)
    cold = F.when((r >= 0) & (r < hot_range), r + hot_range).otherwise(r)
    key = F.when(hot, F.pmod(r, F.lit(hot_range))).otherwise(cold)
    return spark.range(rows).select(*_numbered(key, payload(F.when(hot, heavy_bytes).otherwise(light_bytes), seed), order))


def prefix_skew(spark: SparkSession, rows: int, heavy_cap: int = 32 << 10, seed: int = 1) -> DataFrame:
    """Long keys that share long heads: 60 % in 16 heavy groups, 30 % in 1000 medium ones, 10 % random.

    Heavy: a 192-byte head, 8-byte tag of the group, 8-byte tail; payload 8 KiB to ``heavy_cap``. Medium: a 96-byte
    head, then filler and the group's 4-byte number, 128 to 200 bytes together, and 8 to 40 bytes more;
    256 B to 2 KiB. Random: 256 bytes of key, 64 to 256 B.
    """
    u, pick = uniform(seed, 1), F.pmod(random_u64(seed, 2), F.lit(1 << 40))
    byte_text = lambda n, salt: F.unhex(F.substr(F.repeat(F.concat(*(F.lpad(F.hex(F.xxhash64(*salt, F.lit(k))), 16, "0") for k in range(2))), F.ceil(n / 16).cast("int")), F.lit(1), (n * 2).cast("int")))
    fixed = lambda n, salt: byte_text(F.lit(n), [F.lit(seed), F.lit(salt)])
    own = lambda n, salt: byte_text(n if isinstance(n, Column) else F.lit(n), [F.col("id"), F.lit(seed), F.lit(salt)])
    between = lambda lo, hi, salt: (lo + F.pmod(random_u64(seed, salt), F.lit(hi - lo + 1))).cast("int")
    h, m = (pick % 16).cast("long"), (pick % 1000).cast("int")
    by_group = lambda g, n, salt: byte_text(n if isinstance(n, Column) else F.lit(n), [g, F.lit(seed), F.lit(salt)])
    heavy = F.concat(fixed(192, 10), big_endian(h), own(8, 11))
    filler = 28 + F.pmod(F.xxhash64(m, F.lit(seed), F.lit(12)), F.lit(73))
    medium = F.concat(fixed(96, 13), by_group(m, filler, 14), F.unhex(F.lpad(F.hex(m), 8, "0")), own(between(8, 40, 15), 16))
    size = F.when(u < 0.6, between(8 << 10, heavy_cap, 17)).when(u < 0.9, between(256, 2 << 10, 18)).otherwise(between(64, 256, 19))
    kind = F.when(u < 0.6, "heavy").when(u < 0.9, "medium").otherwise("random")
    return spark.range(rows).select(kind.alias("kind"), F.when(u < 0.6, heavy).when(u < 0.9, medium).otherwise(own(256, 20)).alias("key"), payload(size, seed).alias("value"))
