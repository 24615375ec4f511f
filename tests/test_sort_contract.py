"""The behaviour that any total-order sort of key and value bytes must show, for each partition policy."""

import random

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import sort, verify
from rangeloom.sources.binary import in_memory
from rangeloom.spec import COUNT, KEY, SIZE, SortSpec

POLICIES = [KEY, COUNT, SIZE]


def run(spark, rows, policy=SIZE, n=4, tiebreak=("value",), **more):
    df = in_memory(spark, rows) if rows else spark.createDataFrame([], "key binary, value binary")
    out = sort.with_position(df, SortSpec(("key",), None, tiebreak, policy, n, **more))
    got = [(bytes(r.key), bytes(r.value)) for r in out.orderBy("pos").collect()]
    assert [r.pos for r in out.select("pos").orderBy("pos").collect()] == list(range(1, len(rows) + 1))
    assert [k for k, _ in got] == sorted(k for k, _ in rows)
    assert sorted(got) == sorted(rows)
    return got


def shapes():
    rng = random.Random(11)
    shuffled = list(range(1, 501))
    rng.shuffle(shuffled)
    dup = [(f"key_{i:03}".encode(), f"value_{i}_{j}".encode()) for i in range(100) for j in range(10)]
    rng.shuffle(dup)
    return {
        "basic": [(b"z", b"26"), (b"a", b"1"), (b"m", b"13")],
        "shuffled": [(f"{i:06}".encode(), f"value_{i:06}".encode()) for i in shuffled],
        "empty": [],
        "single": [(b"only", b"one")],
        "permutation": [(f"{i * 7919 % 5000:08}".encode(), f"value_{i}".encode()) for i in range(5000)],
        "descending": [(f"{i:05}".encode(), b"v" * 20) for i in range(1999, -1, -1)],
        "duplicates": dup,
        "variable": [(f"{'k' * (i % 3 * 5)}{i:04}".encode(), b"x" * (i % 100 + 1)) for i in range(1000)],
        "nul bytes": [(bytes([i, 0, 255 - i]), bytes([0, i, 0, 255 - i])) for i in range(256)],
        "large values": [(c, b"x" * 500) for c in (b"c", b"a", b"b")],
        "binary": [(bytes([a, b, 255]), b"l") for a, b in ((255, 0), (0, 0), (128, 1), (127, 255), (1, 1))],
        "prefixes": [(k, b"v") for k in (b"zzz", b"a", b"bb", b"aaaa", b"aaa")],
        "growing": [(b"a" * (i + 1), str(i).encode()) for i in rng.sample(range(100), 100)],
        "identical": [(b"same", str(i).encode()) for i in range(2000)],
        "pathological": [(b"one_very_common_long_key_0000", str(i).encode()) for i in range(300)] + [(f"b{i:04}".encode(), b"") for i in range(300, 0, -1)] + [(b"same_key", str(i).encode()) for i in range(300)],
        "random binary": [(rng.randbytes(rng.randrange(1, 50)), rng.randbytes(rng.randrange(1, 100))) for _ in range(1000)],
        "alternating": [(f"{i:04}".encode(), b"v" * (500 if i % 2 else 1)) for i in range(600)],
        "empty key": [(b"", b"1"), (b"\x00", b"2"), (b"", b"3")],
        "unicode": [(w.encode(), b"") for w in ("Apple", "apple", "Zebra", "zebra", "éclair", "Éclair", "naïve", "日本", "中文", "한국", "🎉", "🚀", "Привет", "привет", "ß")],
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_order_and_completeness(spark, name):
    run(spark, shapes()[name])


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("n", [1, 7])
def test_policies_and_partition_counts(spark, policy, n):
    for name in ("duplicates", "identical", "pathological"):
        run(spark, shapes()[name], policy, n)


@pytest.mark.parametrize("imbalance", [0.0, 2.5, 50.0])
def test_imbalance_never_changes_the_result(spark, imbalance):
    run(spark, shapes()["permutation"], COUNT, 5, imbalance=imbalance)


def test_physical_order_is_the_total_order(spark):
    df = in_memory(spark, shapes()["permutation"], 6)
    out = sort.global_sort(df, SortSpec(("key",), None, ("value",), SIZE, 5))
    got = [bytes(r.key) for r in out.toLocalIterator()]
    assert got == sorted(got) and len(got) == 5000
    assert out.rdd.getNumPartitions() == 5


def test_two_phases_with_stats(spark):
    rows = shapes()["duplicates"]
    df = in_memory(spark, rows)
    spec = SortSpec(("key",), None, (), COUNT, 3)
    out, stats = sort.sort_with_stats(df, spec, 4)
    assert sum(r[1] for r in stats.run_generation.runs) == stats.merges[0].rows == 1000
    assert len(stats.run_generation.runs) == 4 and stats.seconds > 0
    assert stats.merges[0].imbalance()["rows"] < 1.2
    assert stats.run_generation_io.write_records >= 1000 and stats.merge_io.read_bytes > 0 and stats.read_amplification() > 0
    assert "Merge 1" in str(stats) and verify.same_rows(df, out.drop("pid"))


def test_discard_counts_every_row(spark):
    df = in_memory(spark, shapes()["descending"])
    assert sort.discard(sort.global_sort(df, SortSpec(("key",), None, (), KEY, 3)), "d1") == 2000
    assert sort.discard(in_memory(spark, shapes()["single"]), "d2") == 1


def test_range_scan_is_half_open(spark):
    df = in_memory(spark, shapes()["shuffled"])
    scan = lambda lo, hi: sorted(bytes(r.key) for r in sort.range_scan(df, "key", lo, hi).collect())
    assert scan(b"000010", b"000013") == [b"000010", b"000011", b"000012"]
    assert scan(None, b"000002") == [b"000001"]
    assert scan(b"0005", None) == [b"000500"]
    assert scan(b"3", b"2") == []


def test_range_scan_prunes_row_groups(spark, tmp_path):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    sort.global_sort(df, SortSpec(("k",), None, (), COUNT, 8)).write.parquet(str(tmp_path / "t"))
    plan = sort.range_scan(spark.read.parquet(str(tmp_path / "t")), "k", 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,10)" in plan and "LessThan(k,20)" in plan


def test_nulls_first_and_floats_in_total_order(spark):
    inf, nan = float("inf"), float("nan")
    values = [nan, inf, 1.0, 0.0, -0.0, -1.0, -inf, None, 1000.0, -1000.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "key double, i int")
    order = lambda strict: [r.i for r in sort.with_position(df, SortSpec(("key",), None, ("i",), COUNT, 3, 1.0, strict)).orderBy("pos").collect()]
    assert [values[i] for i in order(False)][:1] == [None]
    strict = order(True)
    assert strict.index(4) + 1 == strict.index(3)  # -0.0 just before 0.0
    assert strict[-1] == 0 and strict[0] == 7 and strict[1] == 6


def test_multi_type_keys_with_nulls(spark):
    rows = [(None, 1, "b"), ("x", None, "a"), ("x", 2, None), (None, None, "z"), ("a", 5, "q"), ("x", 2, "a")] * 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a string, b int, c string, i int")
    out = sort.with_position(df, SortSpec(("a", "b", "c"), None, ("i",), COUNT, 4)).orderBy("pos").collect()
    want = sorted(enumerate(rows), key=lambda p: [(v is not None, v) for v in p[1]] + [p[0]])
    assert [r.i for r in out] == [i for i, _ in want]


def test_values_are_projected(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert sort.global_sort(df, SortSpec(("a",), ("c",), (), COUNT, 1)).columns == ["a", "c"]


HELPERS = ["pid", "pos_", "_w", "_k0", "_pid_0", "_k0_0", "_at_0", "_w_0", "_n_0", "_first_0", "_sum_0", "n", "w", "_step", "_k"]


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("strict", [False, True])
def test_columns_may_have_the_names_of_helpers(spark, policy, strict):
    """Sorted by a column called pid, with every other helper's name beside it: order and values are the input's own."""
    rng = random.Random(3)
    rows = [(float(rng.randrange(50)), i, *(f"{c}{i}" for c in HELPERS[1:])) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(["pid double", "v int", *(f"{c} string" for c in HELPERS[1:])]))
    spec = SortSpec(("pid",), None, ("v",), policy, 5, 1.0, strict)
    out = sort.with_position(df, spec, before=F.lit(2)).orderBy("pos").collect()
    want = sorted(rows, key=lambda r: r[:2])
    assert [tuple(r)[: len(rows[0])] for r in out] == want and [r.before for r in out] == [2 * k for k in range(400)]
    got = sort.global_sort(df, spec)
    assert got.columns == df.columns and [tuple(r) for r in got.toLocalIterator()] == want
    assert sort.merge_runs(df, spec).columns == df.columns


def test_output_names_are_not_taken_from_the_input(spark):
    spec = SortSpec(("a",), None, (), COUNT, 2)
    for name, f in (("pos", sort.with_position), ("PID", sort.sort_with_stats), ("run", sort.run_generation)):
        with pytest.raises(ValueError):
            f(spark.createDataFrame([(1, 2)], f"a int, {name} int"), spec, *([2] if f is not sort.with_position else []))


def test_verify_finds_disorder_and_loss(spark):
    df = spark.range(70_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("pos"))
    assert tuple(verify.order_violations(df, ["k"]).first()) == (70_000, 0)
    broken = df.withColumn("k", F.when(F.col("pos") == 65_536, 0).when(F.col("pos") == 10, 99).otherwise(F.col("k")))
    assert tuple(verify.order_violations(broken, ["k"]).first()) == (70_000, 2)
    assert not verify.same_rows(df, broken)
    report = verify.verify_sort(df.select("k"), df, ["k"])
    assert report["complete"] and report["violations"] == 0 and report["first"][0].k == 0 and report["last"][-1].k == 69_999


def test_bad_specs():
    for bad in (dict(keys=()), dict(keys=("a",), partition="x"), dict(keys=("a",), n_partitions=0)):
        with pytest.raises(ValueError):
            SortSpec(**bad)


@pytest.mark.parametrize("n_runs, fan_in, passes", [(1, 2, 0), (3, 3, 0), (4, 3, 1), (11, 3, 2), (9, 2, 3)])
def test_merge_in_passes(spark, n_runs, fan_in, passes):
    rows = shapes()["permutation"]
    spec = SortSpec(("key",), None, ("value",), COUNT, 4)
    runs, _ = sort.run_generation(in_memory(spark, rows), spec, n_runs)
    out, done = sort.merge_in_passes(runs, spec, fan_in)
    assert [(bytes(r.key), bytes(r.value)) for r in out.toLocalIterator()] == sorted(rows) and done == passes
    with pytest.raises(ValueError):
        sort.merge_in_passes(runs, spec, 1)
