"""Is the output in order, and is it the input again?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import encode


def order_violations(positions: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``n_rows, violations``: neighbours by ``pos`` of which the second has the smaller key.

    Each row meets the one before it by position in ranges of 2^16, plus the row that ends the range before, so that no
    window spans the table.
    """
    block = F.shiftright("pos", 16)
    rows = positions.select("pos", *keys)
    both = rows.withColumns({"_b": block, "_own": F.lit(True)}).union(rows.where(F.col("pos").bitwiseAND(0xFFFF) == 0xFFFF).withColumns({"_b": block + 1, "_own": F.lit(False)}))
    w = Window.partitionBy("_b").orderBy("pos")
    prev = F.lag(F.struct(*keys)).over(w)
    met = both.withColumns({"_prev": prev})
    return met.where("_own").agg(F.count("*").alias("n_rows"), F.count_if(F.col("_prev").isNotNull() & (F.struct(*keys) < F.col("_prev"))).alias("violations"))


def checksum(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Sum of row hashes, as a decimal: the same for the same rows in any order, repeats counted."""
    return F.sum(F.xxhash64(*(columns or df.columns)).cast("decimal(38,0)"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, in whatever order: count and checksum."""
    x, y = (df.agg(F.count("*").alias("n"), checksum(df, sorted(df.columns)).alias("h")).first() for df in (a, b))
    return tuple(x) == tuple(y)


def verify_sort(before: DataFrame, after: DataFrame, keys: list[str], edge: int = 5) -> dict:
    """Order, completeness, and the first and last rows of a sorted table with ``pos``."""
    seen = order_violations(after, keys).first()
    first = after.orderBy("pos").limit(edge).collect()
    last = after.orderBy(F.desc("pos")).limit(edge).collect()[::-1]
    return {"rows": seen.n_rows, "violations": seen.violations, "complete": same_rows(before, after.select(*before.columns)), "first": first, "last": last}


def size_stats(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row: rows, total and mean bytes of keys and values."""
    k, v = F.octet_length(key), F.octet_length(value)
    return df.agg(F.count("*").alias("n_rows"), F.sum(k).alias("key_bytes"), F.sum(v).alias("value_bytes"), F.avg(k).alias("avg_key"), F.avg(v).alias("avg_value"))


def decoded_edges(after: DataFrame, key: str, kinds: list[str], edge: int = 10) -> DataFrame:
    """First and last ``edge`` rows of a table sorted by a composite ``key``: ``pos`` and the key's parts as text."""
    ends = after.orderBy("pos").limit(edge).union(after.orderBy(F.desc("pos")).limit(edge)).dropDuplicates(["pos"])
    parts = encode.composite_parts(F.col(key), kinds)
    return ends.select("pos", F.array(*(encode.decode_any(parts[i], k) for i, k in enumerate(kinds))).alias("parts"))
