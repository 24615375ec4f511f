"""Range partitioning that withstands skew: three policies for where partitions may be cut.

Bounds are picked on the driver from a weighted sample of ``(keys, tie-break)`` and written into the
plan as a balanced tree of comparisons, so the partition of a row is a function of its values
alone: counting and sorting agree without keeping the data, and lost tasks rerun alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..names import refuse, unused
from ..spec import COUNT, KEY, SIZE, SortSpec

#: Sampled rows for each partition: a bound is then off by a few per cent of a share; with many partitions fewer do.
SAMPLES_PER_PARTITION, SAMPLES, LEAST_SAMPLES = 400, 20_000, 60


def sample_size(parts: int) -> int:
    return min(SAMPLES_PER_PARTITION * parts, max(SAMPLES, LEAST_SAMPLES * parts))


def target_ratio(parts: int, imbalance: float, bound: int) -> float | None:
    """Share of the total before bound number ``bound`` (1 to parts - 1); the first part gets ``imbalance`` even shares."""
    if not 1 <= bound < parts:
        return None
    r = imbalance if imbalance > 0 else 1.0
    heavy = min(max(r, 1.0) / parts, 1.0)
    each = (1.0 - heavy) / (parts - 1)
    return heavy + (bound - 1) * each


def target(parts: int, imbalance: float, bound: int, total: int) -> int | None:
    """That share of ``total``, rounded down; None where it takes everything."""
    ratio = target_ratio(parts, imbalance, bound)
    if ratio is None:
        return None
    t = math.floor(total * ratio)
    return None if t >= total else t


def targets(parts: int, imbalance: float, total: int) -> list[int]:
    return [t for b in range(1, parts) if (t := target(parts, imbalance, b, total)) is not None]


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Bytes of a row's columns: text and binary by length, others by their width. Null counts 0."""
    out = F.lit(0).cast("long")
    for f in df.schema:
        if columns is None or f.name in columns:
            kind = f.dataType
            if isinstance(kind, T.StringType | T.BinaryType):
                size: Column = F.octet_length(f.name)
            else:
                width = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}.get(type(kind), 8)
                size = F.when(F.col(f.name).isNotNull(), width)
            out = out + F.coalesce(size, F.lit(0)).cast("long")
    return out


@dataclass(frozen=True)
class Bounds:
    """Cuts in ascending order; a row's partition is the number of cuts at or before it."""

    columns: tuple[str, ...]
    cuts: tuple[tuple, ...]

    def partition(self, df: DataFrame) -> Column:
        kinds = {f.name: f.dataType for f in df.schema}
        row = F.struct(*self.columns)

        def lit(cut):
            return F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(self.columns, cut, strict=True)))

        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(row < lit(self.cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

        return tree(0, len(self.cuts)).cast("int")


def bounds_from_sample(rows: list[tuple], weights: list[float], n_keys: int, policy: str, parts: int, imbalance: float = 1.0) -> list[tuple]:
    """Cuts from sorted rows with weights (1 each for counts, bytes for sizes).

    A cut is the first row whose weight before it reaches the target. Under "key" it is cut down to the key, so
    equal keys stay together; cuts that fall together are one.
    """
    total = sum(weights)
    wanted = [r * total for b in range(1, parts) if (r := target_ratio(parts, imbalance, b)) is not None and r < 1]
    cuts, before, k = [], 0.0, 0
    for row, w in zip(rows, weights, strict=True):
        while k < len(wanted) and before >= wanted[k] - 1e-9:
            cuts.append(row[:n_keys] if policy == KEY else row)
            k += 1
        before += w
    return list(dict.fromkeys(cuts))


def _order(row: tuple):
    """Spark's ascending order of a row: null first, NaN last."""
    return [(0, 0) if v is None else (2, 0) if isinstance(v, float) and v != v else (1, v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, bytearray) else v) for v in row]


def choose_bounds(df: DataFrame, spec: SortSpec, weight: Column | None = None, seed: int = 17) -> Bounds:
    """Bounds for ``spec.n_partitions`` partitions. Reads keys, tie-break and what the weight needs, twice, and no shuffle.

    The driver gets ``sample_size`` rows or so, whatever the size of the data.
    """
    if spec.partition == SIZE and weight is None:
        weight = row_bytes(df)
    columns = spec.keys if spec.partition == KEY else (*spec.keys, *spec.tiebreak)
    (w,) = unused(df, "w")
    thin = df.select(*columns, (weight if spec.partition == SIZE else F.lit(1)).cast("double").alias(w))
    n = df.count()
    want = sample_size(spec.n_partitions)
    if spec.partition == SIZE and n > want:
        # Heavy rows matter most: each is taken with odds in proportion to its weight, and then stands for an even share.
        mean = thin.agg(F.avg(w)).first()[0] or 1.0
        odds = F.least(F.lit(1.0), F.col(w) / (mean * n / want))
        thin = thin.where(F.rand(seed) < odds).withColumn(w, F.greatest(F.col(w), F.lit(mean * n / want)))
    elif n > want:
        thin = thin.sample(want / n, seed)
    sample = sorted((tuple(r) for r in thin.collect()), key=lambda r: _order(r[:-1]))
    cuts = bounds_from_sample([r[:-1] for r in sample], [r[-1] for r in sample], len(spec.keys), spec.partition, spec.n_partitions, spec.imbalance)
    return Bounds(tuple(columns), tuple(cuts))


def partition_by_range(df: DataFrame, spec: SortSpec, weight: Column | None = None, bounds: Bounds | None = None, pid: str = "pid") -> DataFrame:
    """``df`` with a last column ``pid`` (or another name), each pid in the physical partition of that number. One shuffle.

    Even shares of rows or keys are what Spark's own range partitioning gives, with a compiled search over any
    number of bounds; bytes, imbalance and given bounds go by the tree of comparisons.
    """
    refuse(df, pid)
    if bounds is None and spec.partition != SIZE and spec.imbalance == 1.0:
        columns = spec.keys if spec.partition == KEY else (*spec.keys, *spec.tiebreak)
        return df.repartitionByRange(spec.n_partitions, *columns).withColumn(pid, F.spark_partition_id())
    bounds = bounds or choose_bounds(df, spec, weight)
    return df.withColumn(pid, bounds.partition(df)).repartitionById(len(bounds.cuts) + 1, F.col(pid))


def metrics(df: DataFrame, pid: str | None = None, weight: Column | None = None) -> DataFrame:
    """Rows and bytes per partition: ``pid, n_rows, n_bytes``."""
    weight = row_bytes(df) if weight is None else weight
    return df.select((F.spark_partition_id() if pid is None else F.col(pid)).alias("pid"), weight.alias("_b")).groupBy("pid").agg(F.count("*").alias("n_rows"), F.sum("_b").alias("n_bytes"))


def spread(per_partition: DataFrame) -> DataFrame:
    """One row: least, mean, greatest and greatest over mean, of rows and of bytes."""
    def of(c):
        return [F.min(c).alias(f"min_{c}"), F.avg(c).alias(f"avg_{c}"), F.max(c).alias(f"max_{c}"), (F.max(c) / F.avg(c)).alias(f"ratio_{c}")]

    return per_partition.agg(*of("n_rows"), *of("n_bytes"))


def exact_partitions(positions: DataFrame, spec: SortSpec, n_rows: int, n_bytes: int) -> Column:
    """Partition of each row under the exact rule, from its ``pos`` (1 on) and the bytes ``before`` it.

    "count": row target + 1 opens the next partition; "size": the first row with the target's bytes before it; "key" has
    to look up the opening rows' keys, see ``exact_key_partitions``.
    """
    if spec.partition == COUNT:
        cuts, at = targets(spec.n_partitions, spec.imbalance, n_rows), lambda t: F.col("pos") > t
    else:
        cuts, at = targets(spec.n_partitions, spec.imbalance, n_bytes), lambda t: F.col("before") >= t
    out = F.lit(0)
    for t in cuts:
        out = out + at(t).cast("int")
    return out


def exact_key_partitions(positions: DataFrame, spec: SortSpec, n_rows: int) -> Column:
    """As above for "key": all rows from the first of the opening row's key on. The driver gets one key per bound."""
    cuts = targets(spec.n_partitions, spec.imbalance, n_rows)
    opening = positions.where(F.col("pos").isin([t + 1 for t in cuts])).select(*spec.keys).distinct().collect() if cuts else []
    return Bounds(spec.keys, tuple(sorted({tuple(r) for r in opening}, key=_order))).partition(positions)


def sparse_index(positions: DataFrame, stride: int, unit: str = "rows") -> DataFrame:
    """Rows of a sparse index: the first, then the first at or past each further stride of rows or bytes.

    Wants ``pos``; for bytes ``before`` too (bytes before the row), where a row opens a stride if it is the
    first that begins in it.
    """
    if unit == "rows":
        return positions.where((F.col("pos") - 1) % stride == 0)
    step, k = unused(positions, "step", "k")
    first = Window.partitionBy(step).orderBy("pos")
    out = positions.withColumn(step, F.floor(F.col("before") / stride)).withColumn(k, F.row_number().over(first))
    return out.where(F.col(k) == 1).drop(k, step)


def joined_index(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sparse indexes of several segments as one: adds ``entry`` (number from 0) and ``global_before`` (bytes before it).

    ``index`` has ``segment`` and ``before`` (bytes before the entry in its segment), ``sizes`` a row ``segment, n_bytes``
    for each segment in their order; only that table, a row a segment, meets a window over all of it.
    """
    refuse(index, "entry", "global_before")
    at, opens, first = unused(index, "at", "opens", "first")
    ahead = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("segment", "n_bytes").join(index.groupBy("segment").agg(F.count("*").alias("n")), "segment", "left")
    base = sizes.select("segment", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(a) for c, a in (("n_bytes", opens), ("n", first))))
    out = index.withColumn(at, F.row_number().over(Window.partitionBy("segment").orderBy("before"))).join(base, "segment")
    return out.withColumns({"entry": F.col(first) + F.col(at) - 1, "global_before": F.col(opens) + F.col("before")}).drop(at, opens, first)


def index_bounds(index: DataFrame, key: str, wanted: list) -> DataFrame:
    """For each wanted key, the entries before it (``lower``) and up to it (``upper``) in a joined index, counted in one pass."""
    spark = index.sparkSession
    kind = index.schema[key].dataType.simpleString()
    ask = spark.createDataFrame([(k, w) for k, w in enumerate(wanted)], f"_k int, wanted {kind}")
    n = index.agg(F.array(*(F.struct(F.count_if(F.col(key) < F.lit(w)).alias("lower"), F.count_if(F.col(key) <= F.lit(w)).alias("upper")) for w in wanted)).alias("n"))
    found = n.select(F.posexplode("n").alias("_k", "found"))
    return ask.join(found, "_k").select("wanted", "found.lower", "found.upper")


def mean_sizes(runs: list[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean key and record size over runs given as (rows, mean key, mean record), weighed by rows; (0, 0) without a row."""
    n = sum(r[0] for r in runs)
    return (sum(r[0] * r[1] for r in runs) / n, sum(r[0] * r[2] for r in runs) / n) if n else (0.0, 0.0)


def dynamic_stride(total_bytes: int, mean_key: float, mean_record: float, budget_bytes: int, unit: str = "rows") -> int:
    """Stride for an index of ``budget_bytes``: 14 bytes and the key for each entry."""
    entries = max(1, int(budget_bytes / (14 + mean_key)))
    if unit == "rows":
        return max(1, math.ceil(math.ceil(total_bytes / max(mean_record, 1e-9)) / entries))
    return max(1, math.ceil(total_bytes / entries))


def by_distinct_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, most first: which keys a "key" policy can't split."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), *keys)
