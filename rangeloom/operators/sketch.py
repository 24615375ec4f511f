"""Quantile sketches, cumulative distributions and equi-depth bounds.

Numbers use Spark's own KLL aggregates. Text and bytes use ``Kll`` below: a sketch per input partition,
merged on the driver, where only sketches (a few hundred items each) arrive.
"""

from __future__ import annotations

import bisect
import math
import pickle
import random
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Cdf:
    """Values in order with the share of items up to and including each."""

    values: tuple
    shares: tuple[float, ...]

    def query(self, p: float):
        """Smallest value with a share of at least ``p``, else the greatest."""
        if not self.values:
            raise ValueError("empty distribution")
        return self.values[min(bisect.bisect_left(self.shares, p), len(self.values) - 1)]

    def quantile(self, x) -> float:
        """Share of items up to ``x``; 0 below the least."""
        k = bisect.bisect_right(self.values, x)
        return self.shares[k - 1] if k else 0.0

    def __len__(self) -> int:
        return len(self.values)


class Kll:
    """Mergeable sketch of any ordered values. Level h stands for 2^h items each; the lowest level is the largest."""

    def __init__(self, k: int = 200, seed: int | None = None):
        self.k, self.levels, self.rng = k, [[]], random.Random(seed)

    def _room(self, level: int) -> int:
        return math.ceil(self.k * (2 / 3) ** level)

    def update(self, x) -> None:
        self.levels[0].append(x)
        self._squeeze()

    def merge(self, other: Kll) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append([])
        for mine, theirs in zip(self.levels, other.levels, strict=False):
            mine.extend(theirs)
        self._squeeze()

    def _squeeze(self) -> None:
        while sum(map(len, self.levels)) >= sum(self._room(h) for h in range(len(self.levels))):
            h = next((h for h, items in enumerate(self.levels) if len(items) >= self._room(h)), None)
            if h is None:
                return
            items = sorted(self.levels[h])
            odd = [items.pop()] if len(items) % 2 else []
            if h + 1 == len(self.levels):
                self.levels.append([])
            self.levels[h + 1].extend(items[self.rng.randrange(2) :: 2])
            self.levels[h] = odd

    def items(self) -> list[tuple]:
        return sorted(((x, 1 << h) for h, level in enumerate(self.levels) for x in level), key=lambda p: p[0])

    def count(self) -> int:
        return sum(len(level) << h for h, level in enumerate(self.levels))

    def rank(self, x) -> int:
        return sum(w for v, w in self.items() if v <= x)

    def quantile(self, x) -> float:
        return self.rank(x) / self.count() if self.count() else 0.0

    def cdf(self) -> Cdf:
        values, shares, seen, n = [], [], 0, self.count()
        for v, w in self.items():
            seen += w
            if values and values[-1] == v:
                shares[-1] = seen / n
            else:
                values.append(v)
                shares.append(seen / n)
        return Cdf(tuple(values), tuple(shares))

    def histogram(self, bins: int) -> list[tuple[float, float, int]]:
        """Bins of equal width: (from, to, items)."""
        items = self.items()
        if not items:
            return []
        lo, hi = items[0][0], items[-1][0]
        width = (hi - lo) / bins or 1.0
        out = [0] * bins
        for v, w in items:
            out[min(int((v - lo) / width), bins - 1)] += w
        return [(lo + i * width, lo + (i + 1) * width, n) for i, n in enumerate(out)]


class Reservoir:
    """The ``k`` items of greatest random priority: a uniform sample that merges."""

    def __init__(self, k: int, seed: int | None = None):
        self.k, self.total, self.kept, self.rng = k, 0, [], random.Random(seed)

    def update(self, x) -> None:
        self.total += 1
        self.kept.append((self.rng.random(), x))
        if len(self.kept) >= 2 * self.k:
            self._cut()

    def _cut(self) -> None:
        self.kept = sorted(self.kept, key=lambda p: -p[0])[: self.k]

    def merge(self, other: Reservoir) -> None:
        self.total += other.total
        self.kept += other.kept
        self._cut()

    def count(self) -> int:
        return self.total

    def rank(self, x) -> float:
        self._cut()
        return sum(v <= x for _, v in self.kept) * self.total / len(self.kept) if self.kept else 0.0

    def quantile(self, x) -> float:
        return self.rank(x) / self.total if self.total else 0.0

    def cdf(self) -> Cdf:
        self._cut()
        xs = sorted(v for _, v in self.kept)
        last = {v: i for i, v in enumerate(xs, 1)}
        return Cdf(tuple(last), tuple(i / len(xs) for i in last.values()))


KINDS = {"kll": Kll, "reservoir": Reservoir, "reservoir-sampling": Reservoir, "reservoir_sampling": Reservoir}


def new_sketch(kind: str, k: int, seed: int | None = None):
    if kind.lower() not in KINDS:
        raise ValueError(f"unknown sketch {kind!r}")
    return KINDS[kind.lower()](k, seed)


def merge_sketches(sketches: list):
    if len({type(s) for s in sketches}) > 1:
        raise TypeError("sketches of different kinds don't merge")
    out = sketches[0]
    for s in sketches[1:]:
        out.merge(s)
    return out


def sketch_column(df: DataFrame, column: str, kind: str = "kll", k: int = 200, seed: int = 0, fan_in: int = 64):
    """Sketch of any ordered column: one per partition, merged ``fan_in`` at a time in tasks until few are left."""

    def build(batches):
        s, any_rows = new_sketch(kind, k, seed), False
        for b in batches:
            for x in b.column(0).to_pylist():
                if x is not None:
                    s.update(x)
                    any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(s)], pa.binary())], ["sketch"])

    def join(batches):
        found = [pickle.loads(x) for b in batches for x in b.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(merge_sketches(found))], pa.binary())], ["sketch"])

    parts, n = df.select(column).mapInArrow(build, "sketch binary"), df.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.coalesce(n).mapInArrow(join, "sketch binary")
    found = [pickle.loads(r.sketch) for r in parts.collect()]
    return merge_sketches(found) if found else new_sketch(kind, k, seed)


def kll(df: DataFrame, column: str, k: int = 200, by: list[str] | None = None) -> DataFrame:
    """Spark's KLL sketch of a number column, per group if ``by``: column ``sketch``."""
    kind = dict(df.dtypes)[column]
    agg = F.kll_sketch_agg_bigint if kind in ("tinyint", "smallint", "int", "bigint") else F.kll_sketch_agg_float if kind == "float" else F.kll_sketch_agg_double
    return (df.groupBy(*by) if by else df.groupBy()).agg(agg(F.col(column), F.lit(k)).alias("sketch"))


def exact_cdf(df: DataFrame, column: str) -> DataFrame:
    """``value, n_rows, n_upto, share`` for each distinct value: counted first, summed over distinct values only.

    Running sums go by ranges of values: inside each, then over the ranges.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    parts = counts.repartitionByRange("value").withColumn("_p", F.spark_partition_id())
    inside = F.sum("n_rows").over(Window.partitionBy("_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_in", inside)
    per = parts.groupBy("_p").agg(F.max("_in").alias("_t"))
    ahead = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    per = per.withColumns({"_before": F.coalesce(ahead, F.lit(0)), "_total": F.sum("_t").over(Window.partitionBy())})
    out = parts.join(F.broadcast(per), "_p").withColumn("n_upto", F.col("_in") + F.col("_before"))
    return out.select("value", "n_rows", "n_upto", (F.col("n_upto") / F.col("_total")).alias("share"))


def cdf_query(cdf: DataFrame, shares: list[float]) -> DataFrame:
    """``p, value``: smallest value whose share reaches each ``p``."""
    aggs = [F.min(F.when(F.col("share") >= p, F.col("value"))).alias(f"q{i}") for i, p in enumerate(shares)]
    row = F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"q{i}").alias("value")) for i, p in enumerate(shares)))
    return cdf.agg(*aggs).select(F.explode(row).alias("r")).select("r.p", "r.value")


def equi_depth_bounds(cdf: Cdf, parts: int) -> list:
    """``parts - 1`` bounds at even shares."""
    return [cdf.query(i / parts) for i in range(1, parts)]


def bucket_of(column: Column, bounds: list) -> Column:
    """Bucket (0 on) of a value; bucket i holds ``(bound i-1, bound i]``."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def bucket_balance(df: DataFrame, column: str, bounds: list, weight: Column | None = None) -> DataFrame:
    """One row: buckets, items, greatest bucket, imbalance |max - even| / even, and variance, of given bounds."""
    per = df.groupBy(bucket_of(F.col(column), bounds).alias("b")).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    even = F.sum("n") / (len(bounds) + 1)
    n = len(bounds) + 1
    return per.agg(F.lit(n).alias("buckets"), F.sum("n").alias("items"), F.max("n").alias("largest"), (F.abs(F.max("n") - even) / even).alias("imbalance"), (F.sum(F.col("n") * F.col("n")) / n - even * even).alias("variance"))


def distinct_per_chunk(df: DataFrame, column: str, chunk: Column) -> DataFrame:
    """Values counted inside their chunk first: ``chunk, value, n_rows``."""
    return df.groupBy(chunk.alias("chunk"), F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))


def top_frequencies(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "value").limit(k)


def reservoir(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows drawn uniformly without replacement: those of greatest random priority, picked per partition first."""
    return df.withColumn("_r", F.rand(seed)).orderBy(F.desc("_r")).limit(k).drop("_r")
