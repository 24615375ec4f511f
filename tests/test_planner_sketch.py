import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import encode
from rangeloom.operators import partition, sketch, stats, verify
from rangeloom.plans import planner
from rangeloom.sources import generate


@pytest.mark.parametrize(
    "given, want",
    [
        ((204800, 28800, 16), ("ThreadBound", 16, 16, 40, 21887, 5120, True)),
        ((204800, 256, 16), ("MemoryBound", 5, 1, 40.96, 3111, 5000, False)),
        ((204800, 200, 16), ("MemoryBound", 4, 1, 40, 2431, 5120, False)),
        ((10000, 2048, 8), ("ThreadBound", 8, 8, 40, 3111, 250, True)),
        ((199659.46, 29491, 16), ("ThreadBound", 16, 16, 40, 22412, 4992, True)),
    ],
)
def test_plans(given, want):
    p = planner.plan(planner.PlannerConfig(*given))
    assert (p.regime, p.run_gen_threads, p.merge_threads, round(p.buffer_mb, 9), p.fan_in, p.runs, p.single_step) == want
    assert p.run_gen_memory_mb <= given[1] and p.spark_settings()["spark.sql.shuffle.partitions"] == str(p.merge_threads)


def test_merge_passes_and_schedule():
    assert planner.merge_passes(0, 4) == planner.merge_passes(1, 4) == {"dummies": 0, "merges": 0}
    assert planner.merge_passes(4, 4) == {"dummies": 0, "merges": 1}
    assert planner.merge_passes(6, 4) == {"dummies": 1, "merges": 2}
    with pytest.raises(ValueError):
        planner.merge_passes(5, 1)
    for n in range(2, 40):
        steps = planner.merge_schedule(list(range(1, n + 1)), 5)
        assert sum(steps[-1]) == n * (n + 1) // 2
    assert planner.single_pass_memory_mb(10_000, 4) == pytest.approx(100)
    lo, hi = planner.run_size_window_mb(10_000, 100, 4)
    assert lo == pytest.approx(25) and hi == 25


def test_kll_and_reservoir_on_numbers_and_text():
    rng = random.Random(1)
    for kind in ("kll", "reservoir"):
        parts = [sketch.new_sketch(kind, 200, s) for s in range(8)]
        xs = [rng.random() for _ in range(20_000)]
        for i, x in enumerate(xs):
            parts[i % 8].update(x)
        whole = sketch.merge_sketches(parts)
        assert whole.count() == 20_000
        for p in (0.1, 0.5, 0.9):
            assert abs(whole.quantile(p) - p) < (0.03 if kind == "kll" else 0.12)
            assert abs(whole.cdf().query(p) - p) < (0.03 if kind == "kll" else 0.12)
    text = sketch.Kll(50, 1)
    for i in rng.sample(range(5000), 5000):
        text.update(f"{i:05}")
    assert abs(int(text.cdf().query(0.5)) - 2500) < 400 and text.count() == 5000
    assert sum(n for _, _, n in parts[0].histogram(10)) if isinstance(parts[0], sketch.Kll) else True


def test_sketch_errors_and_empty():
    with pytest.raises(TypeError):
        sketch.merge_sketches([sketch.Kll(10), sketch.Reservoir(10)])
    with pytest.raises(ValueError):
        sketch.new_sketch("tdigest", 10)
    with pytest.raises(ValueError):
        sketch.Kll(10).cdf().query(0.5)
    assert sketch.Kll(10).quantile(3) == 0 and sketch.Kll(10).histogram(4) == []


def test_cdf_rules():
    cdf = sketch.Cdf((1, 5, 9), (0.2, 0.6, 1.0))
    assert [cdf.query(p) for p in (0, 0.2, 0.21, 0.6, 0.99, 1.0)] == [1, 1, 5, 5, 9, 9]
    assert [cdf.quantile(x) for x in (0, 1, 4, 5, 100)] == [0, 0.2, 0.2, 0.6, 1.0]


def test_histogram_counts_all():
    s = sketch.Kll(100, 2)
    for i in range(1000):
        s.update(float(i))
    bins = s.histogram(10)
    assert sum(n for _, _, n in bins) == 1000 and all(60 < n < 140 for _, _, n in bins)


def test_column_sketch_and_buckets(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v")).repartition(70)
    s = sketch.sketch_column(df, "v", "kll", 200, fan_in=8)
    assert s.count() == 20_000
    bounds = sketch.equi_depth_bounds(s.cdf(), 10)
    row = sketch.bucket_balance(df, "v", bounds).first()
    assert row["items"] == 20_000 and row.imbalance < 0.25
    assert sketch.sketch_column(df.where("v < 0"), "v").count() == 0
    assert df.groupBy(sketch.bucket_of(F.col("v"), [5, 9]).alias("b")).count().orderBy("b").first()["count"] == 6
    empty = sketch.exact_cdf(df.where("v < 0"), "v")
    assert empty.count() == 0


def test_zipf_follows_its_law(spark):
    n = 1000
    df = spark.range(50_000).select(generate.zipf(generate.uniform(1, 1), n, 0.8).alias("v"))
    got = {r.v: r["count"] / 50_000 for r in df.groupBy("v").count().collect()}
    z = generate.zeta(n, 0.8)
    assert abs(got[0] - 1 / z) < 0.01 and abs(got[1] - 2**-0.8 / z) < 0.01 and max(got) < n
    assert abs(generate.zeta_fast(200_000, 0.8) - generate.zeta(200_000, 0.8)) < 1e-6 * generate.zeta(200_000, 0.8)


def test_generators_have_their_shares_and_repeat(spark):
    f = generate.freq_key(spark, 4000)
    assert abs(f.where("key_num = 42").count() / 4000 - 0.5) < 0.05
    assert f.agg(F.min(F.octet_length("value")), F.max(F.octet_length("value")), F.min(F.octet_length("key"))).first()[:] == (512, 512, 8)
    h = generate.heavy_key(spark, 4000)
    assert abs(h.where(F.octet_length("value") == 32768).count() / 4000 - 0.1) < 0.03
    r = generate.heavy_range(spark, 4000)
    assert abs(r.where("key_num >= 0 and key_num < 65536").count() / 4000 - 0.2) < 0.03
    assert bytes(f.where("key_num = 42").first().key) == (42).to_bytes(8, "little")
    p = generate.prefix_skew(spark, 4000)
    kinds = {k["kind"]: k for k in p.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(F.substring("key", 1, 200)).alias("heads"), F.min(F.octet_length("key")).alias("lo"), F.max(F.octet_length("key")).alias("hi")).collect()}
    assert abs(kinds["heavy"].n / 4000 - 0.6) < 0.05 and kinds["heavy"].heads == 16 and kinds["heavy"].lo == kinds["heavy"].hi == 208
    assert 96 + 32 + 8 - 4 <= kinds["medium"].lo and kinds["medium"].hi <= 96 + 200 + 40 and kinds["random"].lo == 256
    z = generate.zipf_gensort(spark, 500, 0.9)
    assert z.agg(F.min(F.octet_length("key")), F.max(F.octet_length("value"))).first()[:] == (10, 90)
    assert generate.freq_key(spark, 100).exceptAll(generate.freq_key(spark, 100).repartition(3)).count() == 0


def test_reports():
    assert stats.human_bytes(512) == "512 B" and stats.human_bytes(1536) == "1.50 KB"
    assert stats.throughput(2_000_000, 1 << 30, 2.0) == "1.00 M rows/s, 512.00 MB/s" and stats.throughput(1, 1, 0) == "n/a"
    s = stats.SortStats(stats.RunGenerationStats([(0, 10, 100)], 1.0), [stats.MergeStats(1, [(5, 50), (5, 50)], 1.0)], stats.IoStats(write_bytes=100), stats.IoStats(read_bytes=150) + stats.IoStats())
    assert s.read_amplification() == 1.5 and "1.50" in str(s) and "base" in stats.summary_table([("base", s)])


def test_reports_of_runs_merges_and_io():
    g = stats.RunGenerationStats([(0, 10, 100), (1, 30, 300)], 2.0)
    io = stats.IoStats(1024, 5, 2048, 6, 0)
    s = stats.SortStats(g, [stats.MergeStats(2, [(30, 300), (10, 100)], 1.5)], io, None)
    assert stats.run_generation_table([("a", s)]).split("\n")[2].split() == ["a", "2", "40", "10", "20.0", "30", "400", "B", "2.00"]
    assert stats.merge_table([("a", s)]).split("\n")[2].split() == ["a", "1", "2", "2", "40", "1.50", "1.50", "1.50"]
    assert stats.io_table([("a", s)]).split("\n")[2].split() == ["a", "run", "generation", "1.00", "KB", "5", "2.00", "KB", "6", "0", "B"]
    assert len(stats.merge_table([]).split("\n")) == len(stats.io_table([("a", s)]).split("\n")) - 1 == 2


def test_mean_sizes_of_runs():
    assert partition.mean_sizes([(1, 4.0, 10.0), (3, 8.0, 30.0)]) == (7.0, 25.0)
    assert partition.mean_sizes([]) == partition.mean_sizes([(0, 9.0, 9.0)]) == (0.0, 0.0)


def test_joined_index_counts_segments_without_entries(spark):
    index = spark.createDataFrame([(1, "a", 0), (1, "d", 128), (3, "h", 0)], "segment int, key string, before long")
    sizes = spark.createDataFrame([(1, 200), (2, 50), (3, 90)], "segment int, n_bytes long")
    out = partition.joined_index(index, sizes)
    assert [(r.key, r.entry, r.global_before) for r in out.orderBy("entry").collect()] == [("a", 0, 0), ("d", 1, 128), ("h", 2, 250)]
    found = partition.index_bounds(out, "key", ["", "d", "z", "d"]).orderBy("wanted").collect()
    assert [tuple(r) for r in found] == [("", 0, 0), ("d", 1, 2), ("d", 1, 2), ("z", 3, 3)]
    assert partition.index_bounds(out.where("false"), "key", ["a"]).collect()[0].upper == 0


def test_edges_with_decoded_keys(spark):
    df = spark.createDataFrame([(k, f"n{k}", k - 5) for k in range(1, 31)], "pos long, name string, v int")
    df = df.withColumn("key", encode.composite([(F.col("name"), "string"), (F.col("v"), "int")]))
    out = {r.pos: list(r.parts) for r in verify.decoded_edges(df, "key", ["string", "int"], 2).collect()}
    assert out == {1: ["n1", "-4"], 2: ["n2", "-3"], 29: ["n29", "24"], 30: ["n30", "25"]}
    assert verify.decoded_edges(df.limit(3), "key", ["string", "int"], 2).count() == 3
