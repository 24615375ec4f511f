"""Command line: sort files, measure scans and sketches, write skewed data sets.

    python -m rangeloom.cli sort lineitem.csv --format lineitem --keys 8,9,13,14,15 --values 0,3 --verify
    python -m rangeloom.cli sort data.gensort --format gensort --partition size --discard --runs 3
    python -m rangeloom.cli plan --dataset-mb 204800 --memory-mb 28800 --threads 16
    python -m rangeloom.cli scan lineitem.csv --format lineitem --partitions 2,4,8
    python -m rangeloom.cli sketch --rows 1000000
    python -m rangeloom.cli generate heavy_key --rows 100000 --output out
"""

from __future__ import annotations

import argparse
import os
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import partition, sketch, sort, stats, verify
from .plans import planner
from .sources import binary, delimited, generate, schemas
from .spec import COUNT, KEY, SIZE, SortSpec
from .storage import fresh_path

FORMATS = ("lineitem", "taxi", "gensort", "kvbin", "parquet")


def columns(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def read(spark: SparkSession, a) -> DataFrame:
    """The input as ``key, value`` bytes; Parquet keeps its own columns."""
    if a.format == "gensort":
        return binary.read_gensort(spark, a.input, a.partitions)
    if a.format == "kvbin":
        return binary.read_kvbin(spark, a.input, a.partitions)
    if a.format == "parquet":
        return spark.read.parquet(a.input)
    schema = schemas.LINEITEM if a.format == "lineitem" else schemas.YELLOW_TAXI
    keys, values = columns(a.keys), columns(a.values)
    df = delimited.read_delimited(spark, a.input, schema, keys, values, a.delimiter, not a.no_header)
    return delimited.as_key_value(df, [schema[k].name for k in keys], [schema[k].name for k in values])


def estimate(spark: SparkSession, a) -> float:
    """MB of the selected columns; of binary formats the files' own size."""
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(a.input) for f in fs) if os.path.isdir(a.input) else os.path.getsize(a.input)
    if a.format in ("gensort", "kvbin", "parquet"):
        return size / (1 << 20)
    schema = schemas.LINEITEM if a.format == "lineitem" else schemas.YELLOW_TAXI
    df = delimited.read_delimited(spark, a.input, schema, columns(a.keys), columns(a.values), a.delimiter, not a.no_header).limit(1000)
    line = spark.read.text(a.input).limit(1000).agg(F.avg(F.octet_length("value") + 1)).first()[0] or 1.0
    return delimited.estimate_mb(df.agg(F.avg(delimited.selected_bytes(df.schema, df.columns))).first()[0] or 0.0, line, size)


def spec_of(df: DataFrame, a) -> SortSpec:
    names = df.columns
    keys = ("key",) if "key" in names else tuple(names[k] for k in columns(a.keys))
    return SortSpec(keys, None, tuple(c for c in names if c not in keys), {"KeyOnly": KEY, "CountBalanced": COUNT, "SizeBalanced": SIZE}.get(a.partition, a.partition), a.merge, a.imbalance)


def run_sort(spark: SparkSession, a) -> None:
    if a.estimate_size or a.plan or a.print_plan:
        size = estimate(spark, a)
        print(f"Estimated size: {size:.2f} MB")
        if a.estimate_size:
            return
        p = planner.plan(planner.PlannerConfig(max(size, 1e-6), a.memory_mb, a.threads))
        print("\n".join(f"{k}: {v}" for k, v in asdict(p).items()))
        if a.print_plan:
            return
        a.runs_of, a.merge = p.run_gen_threads, p.merge_threads
    done = []
    for k in range(a.warmup + a.runs):
        df = read(spark, a)
        spec, began = spec_of(df, a), time.time()
        if a.discard:
            n = sort.discard(sort.global_sort(df, spec), f"run{k}")
            took = time.time() - began
            print(f"run {k}: {n:,} rows, {stats.throughput(n, 0, took)}")
        else:
            out, s = sort.sort_with_stats(df, spec, a.runs_of)
            if k >= a.warmup:
                done.append((f"{a.format} run {k - a.warmup}", s))
                print(s)
            if a.verify and k == a.warmup:
                report = verify.verify_sort(df, sort.with_position(out.drop("pid"), spec), list(spec.keys))
                print(f"verified: {report['rows']:,} rows, {report['violations']} out of order, complete: {report['complete']}")
            if a.output and k == a.warmup + a.runs - 1:
                out.drop("pid").write.mode("overwrite").parquet(a.output)
        if a.cooldown and k + 1 < a.warmup + a.runs:
            time.sleep(a.cooldown)
    if done:
        print(stats.summary_table(done))


def run_convert(spark: SparkSession, a) -> None:
    binary.write_kvbin(read(spark, a), a.output or binary.kvbin_name(a.input, columns(a.keys), columns(a.values)))


def run_scan(spark: SparkSession, a) -> None:
    """Rows per second of a bare scan, and how even its partitions are."""
    for n in columns(a.splits):
        a.partitions = n
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1 << 16, os.path.getsize(a.input) // n)))
        df, began = read(spark, a), time.time()
        rows = sort.discard(df, f"scan{n}")
        took = time.time() - began
        s = partition.spread(partition.metrics(df)).first()
        print(f"{n} asked, {df.rdd.getNumPartitions()} partitions: {stats.throughput(rows, 0, took)}; rows max/mean {s.ratio_n_rows or 1:.2f}")


def run_sketch(spark: SparkSession, a) -> None:
    print("theta,sketch,items,largest,imbalance,variance")
    for theta in (0.5, 0.6, 0.7, 0.8, 0.9, 0.99):
        df = spark.range(a.rows).select(generate.zipf(generate.uniform(a.seed, 1), 100_000, theta).alias("v"))
        for name, kind, k, rows in (("kll", "kll", 200, df), ("reservoir", "reservoir", 600, df), ("kll-preagg", "kll", 200, df.distinct()), ("reservoir-preagg", "reservoir", 600, df.distinct())):
            r = sketch.bucket_balance(df, "v", sketch.equi_depth_bounds(sketch.sketch_column(rows, "v", kind, k).cdf(), 40)).first()
            print(f"{theta},{name},{r['items']},{r.largest},{r.imbalance:.4f},{r.variance:.1f}")


def run_generate(spark: SparkSession, a) -> None:
    make = {"freq_key": generate.freq_key, "heavy_key": generate.heavy_key, "heavy_range": generate.heavy_range, "prefix_skew": generate.prefix_skew}
    df = generate.zipf_gensort(spark, a.rows, a.theta, a.seed) if a.kind == "zipf_gensort" else make[a.kind](spark, a.rows, seed=a.seed)
    binary.write_kvbin(df, a.output or fresh_path(spark, a.kind))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rangeloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def source(name: str, run):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        s.add_argument("input")
        s.add_argument("--format", choices=FORMATS, default="parquet")
        s.add_argument("--keys", default="8,9,13,14,15")
        s.add_argument("--values", default="0,3")
        s.add_argument("--delimiter", default=",")
        s.add_argument("--no-header", action="store_true")
        s.add_argument("--partitions", type=int, default=8)
        s.add_argument("--output")
        return s

    s = source("sort", run_sort)
    s.add_argument("--partition", default=SIZE, choices=[KEY, COUNT, SIZE, "KeyOnly", "CountBalanced", "SizeBalanced"])
    s.add_argument("--imbalance", type=float, default=1.0)
    s.add_argument("--runs-of", type=int, default=8, help="runs of the first phase")
    s.add_argument("--merge", type=int, default=8, help="partitions of the second phase")
    s.add_argument("--memory-mb", type=float, default=2048)
    s.add_argument("--threads", type=int, default=8)
    for flag in ("--plan", "--print-plan", "--estimate-size", "--discard", "--verify"):
        s.add_argument(flag, action="store_true")
    for flag, default in (("--warmup", 0), ("--runs", 1), ("--cooldown", 0)):
        s.add_argument(flag, type=int, default=default)
    source("convert", run_convert)
    source("scan", run_scan).add_argument("--splits", default="1,2,4,8")
    s = sub.add_parser("plan")
    s.set_defaults(run=lambda spark, a: print("\n".join(f"{k}: {v}" for k, v in asdict(planner.plan(planner.PlannerConfig(a.dataset_mb, a.memory_mb, a.threads))).items())), no_spark=True)
    for flag, kind in (("--dataset-mb", float), ("--memory-mb", float), ("--threads", int)):
        s.add_argument(flag, type=kind, required=True)
    s = sub.add_parser("sketch")
    s.set_defaults(run=run_sketch)
    s.add_argument("--rows", type=int, default=1_000_000)
    s.add_argument("--seed", type=int, default=1)
    s = sub.add_parser("generate")
    s.set_defaults(run=run_generate)
    s.add_argument("kind", choices=["zipf_gensort", "freq_key", "heavy_key", "heavy_range", "prefix_skew"])
    s.add_argument("--rows", type=int, default=100_000)
    s.add_argument("--theta", type=float, default=0.9)
    s.add_argument("--seed", type=int, default=1)
    s.add_argument("--output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(None if getattr(a, "no_spark", False) else spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
