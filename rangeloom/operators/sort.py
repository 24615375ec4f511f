"""Total-order sort, positions, the two-phase form of it, range scans and discard."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.encode import encode_f32, encode_f64
from ..names import refuse, unused
from ..plans.planner import merge_passes
from ..spec import SortSpec
from ..storage import materialize
from .partition import Bounds, partition_by_range, row_bytes
from .stats import MergeStats, RunGenerationStats, SortStats, io_by_stage, io_since


def order_columns(df: DataFrame, spec: SortSpec) -> list[Column]:
    """Ascending order; float keys by their bits where the spec wants that."""
    kinds = dict(df.dtypes)
    bits = {"double": encode_f64, "float": encode_f32}
    return [bits[kinds[c]](F.col(c)) if spec.strict_float_order and kinds[c] in bits else F.col(c) for c in (*spec.keys, *spec.tiebreak)]


def project(df: DataFrame, spec: SortSpec) -> DataFrame:
    return df if spec.values is None else df.select(*dict.fromkeys((*spec.keys, *spec.tiebreak, *spec.values)))


def _prepared(df: DataFrame, spec: SortSpec) -> tuple[DataFrame, SortSpec, list[str]]:
    """Strict float keys become helper columns, so that bounds and order use the same values."""
    df = project(df, spec)
    if not spec.strict_float_order:
        return df, spec, []
    order = order_columns(df, spec)
    names, n = unused(df, *(f"k{i}" for i in range(len(order)))), len(spec.keys)
    helpers = dict(zip(names, order, strict=True))
    return df.withColumns(helpers), SortSpec(names[:n], None, names[n:], spec.partition, spec.n_partitions, spec.imbalance), list(names)


def global_sort(df: DataFrame, spec: SortSpec, weight: Column | None = None) -> DataFrame:
    """``df`` in total order: partition i holds what precedes partition i + 1, each sorted. All duplicates stay."""
    df, by, helpers = _prepared(df, spec)
    (pid,) = unused(df, "pid")
    return partition_by_range(df, by, weight, pid=pid).sortWithinPartitions(*by.keys, *by.tiebreak).drop(pid, *helpers)


def with_position(df: DataFrame, spec: SortSpec, weight: Column | None = None, before: Column | None = None) -> DataFrame:
    """The rows with ``pos``, their place in total order from 1, and, if ``before`` is a weight, its sum over the rows before.

    The rows are sorted once and stored with their place in their partition; rows (and weight) per partition are counted
    from the stored table, and what comes before a partition, a row for each, is joined to it. No window over
    the whole table, and no bound in the plan where Spark's range partitioning does.
    """
    refuse(df, "pos", *(() if before is None else ("before",)))
    df, by, helpers = _prepared(df, spec)
    pid, at, w, n, first, sum_before = unused(df, "pid", "at", "w", "n", "first", "sum")
    if before is not None:
        df = df.withColumn(w, before)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = partition_by_range(df, by, weight, pid=pid).sortWithinPartitions(*by.keys, *by.tiebreak)
    rows = materialize(rows.withColumn(at, place).drop(*helpers), "positions")
    per = rows.groupBy(pid).agg(F.count("*").alias(n), (F.lit(0).cast("long") if before is None else F.sum(w)).alias(w)).orderBy(pid).collect()
    offsets, so_far, weight_so_far = [], 0, 0
    for r in per:
        offsets.append((r[pid], so_far, weight_so_far))
        so_far, weight_so_far = so_far + r[n], weight_so_far + (r[w] or 0)
    kind = "long" if before is None else per and rows.agg(F.sum(w)).schema[0].dataType.simpleString() or "long"
    table = df.sparkSession.createDataFrame(offsets, f"{pid} int, {first} long, {sum_before} {kind}")
    out = rows.join(F.broadcast(table), pid).withColumn("pos", F.col(at) + 1 + F.col(first))
    if before is not None:
        inside = F.sum(w).over(Window.partitionBy(pid).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("before", F.coalesce(inside, F.lit(0)) + F.col(sum_before))
    return out.drop(pid, at, w, first, sum_before)


def run_generation(df: DataFrame, spec: SortSpec, n_runs: int) -> tuple[DataFrame, RunGenerationStats]:
    """First phase: ``n_runs`` runs, each sorted by itself and stored, with column ``run``; not yet a total order."""
    began = time.time()
    df = project(df, spec)
    refuse(df, "run")
    rows = df.repartition(n_runs).withColumn("run", F.spark_partition_id()).sortWithinPartitions(*order_columns(df, spec))
    runs = materialize(rows, "runs")
    weight = row_bytes(df)
    per = runs.groupBy("run").agg(F.count("*").alias("n_rows"), F.sum(weight).alias("n_bytes")).orderBy("run").collect()
    return runs, RunGenerationStats([(r.run, r.n_rows, r.n_bytes) for r in per], time.time() - began)


def merge_runs(runs: DataFrame, spec: SortSpec, bounds: Bounds | None = None) -> DataFrame:
    """Second phase: each task takes its key range out of every run and gives it in order. The run breaks no ties."""
    df, by, helpers = _prepared(runs, spec)
    (pid,) = unused(df, "pid")
    return partition_by_range(df, by, bounds=bounds, pid=pid).sortWithinPartitions(*by.keys, *by.tiebreak).drop(pid, *helpers)


def merge_in_passes(runs: DataFrame, spec: SortSpec, fan_in: int) -> tuple[DataFrame, int]:
    """Stored runs (column ``run``) merged at most ``fan_in`` at a time, the smallest first; the sorted rows and the number of passes before the last.

    Merges that wait for none of each other are one pass: a table of rows with their new run, each run in order and
    in one task. The driver has a row for each run. What is left at the end, ``fan_in`` runs at most, is merged by key range.
    """
    if fan_in < 2:
        raise ValueError("fan-in must be at least 2")
    spark, passes = runs.sparkSession, 0
    sizes = {r.run: r.n for r in runs.groupBy("run").agg(F.count("*").alias("n")).collect()}
    while len(sizes) > fan_in:
        spare = merge_passes(len(sizes), fan_in)["dummies"]
        todo, moves, merged = sorted(sizes.items(), key=lambda r: (r[1], r[0])), [], {}
        while len(todo) + len(merged) > fan_in and len(todo) > 1:
            # A run that this pass makes is taken by the next one, unless one of the old runs is smaller.
            take = fan_in - spare if spare else fan_in
            group, todo, spare = todo[:take], todo[take:], 0
            moves += [(run, len(merged)) for run, _ in group]
            merged[len(merged)] = sum(n for _, n in group)
        moves += [(run, len(merged) + k) for k, (run, _) in enumerate(todo)]
        sizes = merged | {len(merged) + k: n for k, (_, n) in enumerate(todo)}
        names = runs.columns
        (to,) = unused(runs, "to")
        table = F.broadcast(spark.createDataFrame(moves, f"run int, {to} int"))
        rows = runs.join(table, "run").withColumn("run", F.col(to)).select(*names)
        runs = materialize(rows.repartitionById(len(sizes), F.col("run")).sortWithinPartitions(*order_columns(runs, spec)), "merged-runs")
        passes += 1
    return merge_runs(runs.drop("run"), spec), passes


def sort_with_stats(df: DataFrame, spec: SortSpec, n_runs: int) -> tuple[DataFrame, SortStats]:
    """Both phases with their statistics. The result is stored, with its partition as ``pid``, so that reading it again doesn't sort again."""
    refuse(project(df, spec), "pid")
    spark = df.sparkSession
    seen = io_by_stage(spark)
    runs, first = run_generation(df, spec, n_runs)
    first_io, seen = io_since(spark, seen), io_by_stage(spark)
    began = time.time()
    sorted_rows = materialize(merge_runs(runs.drop("run"), spec).withColumn("pid", F.spark_partition_id()), "sorted")
    merge_io = io_since(spark, seen)
    per = sorted_rows.groupBy("pid").agg(F.count("*").alias("n_rows"), F.sum(row_bytes(df)).alias("n_bytes")).orderBy("pid").collect()
    merged = MergeStats(len(first.runs), [(r.n_rows, r.n_bytes) for r in per], time.time() - began)
    return sorted_rows, SortStats(first, [merged], first_io, merge_io)


def range_scan(df: DataFrame, key: str, lower=None, upper=None) -> DataFrame:
    """Rows with ``lower <= key < upper``. On sorted Parquet the bounds reach the scan and skip row groups."""
    if lower is not None:
        df = df.where(F.col(key) >= F.lit(lower))
    return df if upper is None else df.where(F.col(key) < F.lit(upper))


def discard(df: DataFrame, name: str = "discard") -> int:
    """Runs everything, writes nothing, and returns the number of rows."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]
