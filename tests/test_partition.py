import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import partition, sort
from rangeloom.sources import generate
from rangeloom.spec import COUNT, KEY, SIZE, SortSpec


def balance(spark, df, policy, n=4):
    weight = F.octet_length("key") + F.octet_length("value")
    out = partition.partition_by_range(df, SortSpec(("key",), None, ("id",), policy, n), weight)
    return partition.spread(partition.metrics(out, "pid", weight)).first(), partition.metrics(out, None, weight).count()


def numbered(df):
    return df.withColumn("id", F.monotonically_increasing_id())


def test_one_key_with_half_the_rows(spark):
    df = numbered(generate.freq_key(spark, 20_000, value_bytes=64))
    key, count, size = (balance(spark, df, p)[0] for p in (KEY, COUNT, SIZE))
    assert key.ratio_n_rows > 1.4 and count.ratio_n_rows < 1.3 and size.ratio_n_rows < 1.3


def test_one_key_with_large_payloads(spark):
    df = numbered(generate.heavy_key(spark, 20_000, heavy_bytes=8192))
    key, count, size = (balance(spark, df, p)[0] for p in (KEY, COUNT, SIZE))
    assert key.ratio_n_bytes > 2.5 and count.ratio_n_bytes > 1.5 and size.ratio_n_bytes < 1.3


def test_a_hot_range_in_byte_order(spark):
    df = numbered(generate.heavy_range(spark, 20_000, heavy_bytes=8192, order="big"))
    key, count, size = (balance(spark, df, p)[0] for p in (KEY, COUNT, SIZE))
    assert size.ratio_n_bytes < 1.3 < count.ratio_n_bytes


def test_key_policy_keeps_equal_keys_together(spark):
    df = numbered(generate.freq_key(spark, 5000, value_bytes=8))
    out = partition.partition_by_range(df, SortSpec(("key",), None, ("id",), KEY, 6))
    assert out.groupBy("key").agg(F.count_distinct("pid").alias("n")).where("n > 1").count() == 0


def test_targets():
    assert partition.targets(4, 1.0, 100) == [25, 50, 75]
    assert partition.targets(4, 2.0, 121) == [60, 80, 100]
    assert partition.targets(4, 100.0, 120) == []
    assert partition.target_ratio(4, 0.0, 1) == 0.25 and partition.target_ratio(4, 1.0, 4) is None and partition.target_ratio(1, 1.0, 1) is None


def plain_bounds(rows, weights, wanted):
    """First row whose weight before it reaches each target."""
    out = []
    for t in wanted:
        before = 0
        for r, w in zip(rows, weights, strict=True):
            if before >= t - 1e-9:
                out.append(r)
                break
            before += w
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("imbalance", [1.0, 1.7])
def test_bounds_equal_a_plain_scan(imbalance):
    rng = random.Random(5)
    for _ in range(50):
        rows = sorted((rng.choice("abcde"), i) for i in range(rng.randrange(1, 40)))
        weights = [rng.randrange(1, 100) for _ in rows]
        parts = rng.randrange(2, 8)
        wanted = [partition.target_ratio(parts, imbalance, b) * sum(weights) for b in range(1, parts)]
        assert partition.bounds_from_sample(rows, weights, 1, SIZE, parts, imbalance) == plain_bounds(rows, weights, wanted)
        by_key = partition.bounds_from_sample(rows, weights, 1, KEY, parts, imbalance)
        assert by_key == sorted({r[:1] for r in plain_bounds(rows, weights, wanted)})


def test_sparse_index_and_strides(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7 + 1).alias("w"))
    rows = sort.with_position(df, SortSpec(("k",), None, (), COUNT, 3), before=F.col("w"))
    assert [r.k for r in partition.sparse_index(rows, 250).orderBy("pos").collect()] == [0, 250, 500, 750]
    at = [r.before for r in partition.sparse_index(rows, 500, "bytes").orderBy("pos").collect()]
    assert at[0] == 0 and all(b // 500 == i for i, b in enumerate(at)) and len(at) == math.ceil(sum(i % 7 + 1 for i in range(1000)) / 500)
    assert partition.dynamic_stride(1_000_000, 10, 100, 24 * 50) == 200
    assert partition.dynamic_stride(1_000_000, 10, 100, 24 * 50, "bytes") == 20_000
    assert partition.dynamic_stride(10, 10, 100, 0) == 1


def test_bounds_far_beyond_the_sample(spark):
    """Over as many rows as make it sample, shares stay close."""
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"))
    out = partition.partition_by_range(df, SortSpec(("k",), None, (), COUNT, 20))
    assert partition.spread(partition.metrics(out, "pid")).first().ratio_n_rows < 1.3
