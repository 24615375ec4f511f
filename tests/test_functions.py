import random
import struct
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import encode, ovc


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


VALUES = {
    "int": [0, 1, -1, 2**31 - 1, -(2**31), 12345],
    "bigint": [0, 1, -1, 2**63 - 1, -(2**63), 987654321987],
    "double": [float("-inf"), -1000.0, -1.0, -0.0, 0.0, 1.0, 1000.0, float("inf"), 1e-300],
    "float": [float("-inf"), -1000.0, -1.0, -0.0, 0.0, 1.5, float("inf")],
    "date": [date(1970, 1, 1), date(1, 1, 1), date(2024, 2, 29), date(1969, 12, 31)],
    "decimal(38,0)": [Decimal(0), Decimal(-1), Decimal(10) ** 37, -(Decimal(10) ** 37)],
    "string": ["", "a", "aé", "z", "日本"],
    "binary": [b"", b"\x00", b"\xff", b"ab"],
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_round_trip_and_order(spark, kind):
    values = [*VALUES[kind], None]
    df = column(spark, values, kind)
    enc, dec, width = encode.CODECS[kind]
    rows = df.select("i", "v", enc(F.col("v")).alias("e")).withColumn("back", dec(F.col("e"))).collect()
    for r in rows:
        assert r.v == r.back and (r.e is None) == (r.v is None)
        assert r.e is None or width is None or len(r.e) == width
    known = [r for r in rows if r.v is not None]
    by_bytes = [r.i for r in sorted(known, key=lambda r: bytes(r.e))]
    assert by_bytes == [r.i for r in sorted(known, key=lambda r: (r.v.encode() if isinstance(r.v, str) else r.v, str(r.v) != "-0.0"))]


def test_bits_equal_the_plain_rule(spark):
    rng = random.Random(2)
    xs = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)]
    xs = [x for x in xs if x == x] + [-0.0]
    got = {r.i: bytes(r.e) for r in column(spark, xs, "double").select("i", encode.encode_f64("v").alias("e")).collect()}
    for i, x in enumerate(xs):
        b = struct.unpack(">Q", struct.pack(">d", x))[0]
        assert got[i] == struct.pack(">Q", b ^ ((1 << 64) - 1) if b >> 63 else b | 1 << 63)


def test_wrong_length_and_unknown_kind(spark):
    df = column(spark, [b"abc"], "binary")
    for f in (encode.decode_i32, encode.decode_i64, encode.decode_f64):
        with pytest.raises(Exception, match="expected"):
            df.select(f(F.col("v"))).collect()
    assert df.select(encode.decode_any(F.col("v"), "interval")).first()[0] == "<3 bytes>"
    with pytest.raises(ValueError):
        encode.encode(F.col("v"), "interval")


def test_composite_order_and_parts(spark):
    rows = [("a", -5, "x"), ("a", 3, ""), ("ab", 0, "y"), ("", 7, "z"), ("a", 3, "b")]
    df = spark.createDataFrame(rows, "a string, b int, c string")
    kinds = ["string", "int", "string"]
    key = encode.composite([(F.col("a"), "string"), (F.col("b"), "int"), (F.col("c"), "string")])
    out = df.select("a", "b", "c", key.alias("k")).withColumn("p", encode.composite_parts(F.col("k"), kinds)).collect()
    assert [tuple(r)[:3] for r in sorted(out, key=lambda r: bytes(r.k))] == sorted(rows)
    assert all(bytes(r.p[0]).decode() == r.a and bytes(r.p[2]).decode() == r.c for r in out)


def plain_code(key, before, bits):
    c = ovc.CHUNK[bits]
    s = 8 * c
    if before is None:
        return 3 << (s + 13)
    if key == before:
        return 1 << (s + 13)
    n = 0
    while n < min(len(key), len(before)) and key[n] == before[n]:
        n += 1
    off = n // c * c
    return 2 << (s + 13) | (8191 - off) << s | int.from_bytes(key[off : off + c].ljust(c, b"\0"), "big")


@pytest.mark.parametrize("bits", [32, 64])
def test_codes_equal_the_plain_rule_and_keep_order(spark, bits):
    rng = random.Random(bits)
    keys = [bytes(rng.choice(b"\x00a\xff") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [b"", b""]
    df = spark.createDataFrame([(k, i, i % 3) for i, k in enumerate(keys)], "key binary, id int, run int")
    coded = ovc.with_codes(df, "key", ["run"], ["id"], bits).collect()
    for run in range(3):
        rows = sorted((r for r in coded if r.run == run), key=lambda r: (bytes(r.key), r.id))
        for k, r in enumerate(rows):
            assert r.ovc == plain_code(bytes(r.key), bytes(rows[k - 1].key) if k else None, bits)
    check = spark.createDataFrame(coded)
    assert all(r.consistent for r in ovc.consistency(check, "key", ["run"], ["id"], bits).collect())
    broken = check.withColumn("ovc", F.when(F.col("id") == 7, 0).otherwise(F.col("ovc")))
    assert sorted(r.consistent for r in ovc.consistency(broken, "key", ["run"], ["id"], bits).collect()) == [False, True, True]


@pytest.mark.parametrize("bits", [32, 64])
def test_compare_by_codes(spark, bits):
    rng = random.Random(bits + 1)
    some = lambda: bytes(rng.choice(b"\x00a\xff") for _ in range(rng.randrange(0, 14)))
    rows = []
    for k in range(400):
        start = some() if k % 3 else b""
        x = [start + some() for _ in range(3)] + [start + b"a"] * (k % 2)
        rows.append((min(x), *rng.sample(x, 2)))
    df = spark.createDataFrame(rows, "base binary, a binary, b binary")
    df = df.withColumns({"ca": ovc.code(F.col("a"), F.col("base"), bits), "cb": ovc.code(F.col("b"), F.col("base"), bits)})
    out = df.withColumn("m", ovc.compare(F.col("a"), F.col("ca"), F.col("b"), F.col("cb"), bits)).collect()
    for r in out:
        a, b = bytes(r.a), bytes(r.b)
        assert r.m.order == (a > b) - (a < b)
        assert r.m.loser_code == plain_code(max(a, b), min(a, b), bits)
        assert r.m.by_code == (r.ca != r.cb or ovc.DUPLICATE == r.ca >> (8 * ovc.CHUNK[bits] + 13))
        assert (r.m.bytes_compared == 0) or not r.m.by_code
    assert {r.m.by_code for r in out} == {True, False} and {r.m.order for r in out} == {-1, 0, 1}


def test_true_codes_need_not_be_the_best(spark):
    near = 2 << 29 | 8191 << 16 | int.from_bytes(b"ab", "big")
    df = spark.createDataFrame([(b"abcd", 1, 3 << 29), (b"abce", 2, near), (b"abcf", 3, near + 1)], "key binary, id int, ovc long").withColumn("run", F.lit(0))
    seen = lambda last: ovc.consistency(df.where(F.col("id") <= last), "key", ["run"], ["id"]).first()
    assert tuple(seen(1)) == (0, 1, True, True) and tuple(seen(2)) == (0, 2, True, False) and tuple(seen(3)) == (0, 3, False, False)


def test_stored_bytes(spark):
    df = spark.createDataFrame([(b"abcdef", 1), (b"abcdef", 2), (b"abcdxx", 3)], "key binary, id int").withColumn("run", F.lit(0))
    out = ovc.with_codes(df, "key", ["run"], ["id"])
    plain, coded = ovc.stored_bytes(F.col("key"), F.lit(b"vv"), F.col("ovc"), F.col("ovc_offset"))
    assert [tuple(r) for r in out.orderBy("id").select(plain, coded).collect()] == [(16, 20), (16, 10), (16, 16)]
