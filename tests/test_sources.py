import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.operators.sort import with_position
from rangeloom.sources import binary, delimited, schemas
from rangeloom.spec import COUNT, SortSpec

TWO = T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())])
MIXED = T.StructType([T.StructField("s", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("f", T.DoubleType()), T.StructField("d", T.DateType()), T.StructField("l", T.LongType())])


def lines(tmp_path, text, name="t.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def test_header_and_projection(spark, tmp_path):
    path = lines(tmp_path, "id,value\n" + "".join(f"{i:02},val_{i:02}\n" for i in range(20)))
    rows = delimited.read_delimited(spark, path, TWO, [1], [0]).collect()
    assert sorted((r.id, r.value) for r in rows) == [(f"{i:02}", f"val_{i:02}") for i in range(20)]
    assert rows[0].__fields__ == ["value", "id"]
    assert delimited.read_delimited(spark, path, TWO, [0], [1], header=False).count() == 21


def test_rows_are_judged_by_selected_columns(spark, tmp_path):
    text = 's,i,f,d,l\nok,1,1.5,2024-02-29,7\nextra,2,2,2024-01-01,8,surplus,more\nshort,3\n\nbad,x,1,2024-01-01,9\nempty,,1,2024-01-01,9\n,4,-.5,2024-01-02,10\n"q,""x",5,1e3,2024-01-03,11\r\nblank, 6,1,2024-01-01,12\nday,7,1,2024-02-30,13\n'
    path = lines(tmp_path, text)
    got = lambda keys, values: sorted(tuple(r) for r in delimited.read_delimited(spark, path, MIXED, keys, values).collect())
    assert got([0], [1]) == [("", 4), ("day", 7), ("extra", 2), ("ok", 1), ('q,"x', 5), ("short", 3)]
    assert [r[0] for r in got([0], [3])] == ["", "bad", "blank", "empty", "extra", "ok", 'q,"x']
    assert sorted(r[1] for r in got([0], [2])) == [-0.5, 1.0, 1.0, 1.0, 1.0, 1.5, 2.0, 1000.0]


def test_other_delimiter_and_splits(spark, tmp_path):
    path = lines(tmp_path, "id|value\n" + "".join(f"{i}|{'x' * (i % 50)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = delimited.read_delimited(spark, path, TWO, [0], [1], "|")
        assert df.rdd.getNumPartitions() > 3 and df.count() == 5000 and df.select("id").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bad_requests(spark, tmp_path):
    path = lines(tmp_path, "a,b\n")
    for keys, values in (([], [1]), ([0], []), ([0], [9])):
        with pytest.raises(ValueError):
            delimited.read_delimited(spark, path, TWO, keys, values)
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, path, T.StructType([T.StructField("a", T.BooleanType()), T.StructField("b", T.StringType())]), [0], [1])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        delimited.read_delimited(spark, str(tmp_path / "none.csv"), TWO, [0], [1]).count()


def test_presets(spark, tmp_path):
    assert len(schemas.LINEITEM) == 16 and len(schemas.YELLOW_TAXI) == 51 and len(schemas.YELLOW_TRIPS) == 19
    row = "1,2,3,4,5.0,6.0,0.1,0.2,N,O,1996-03-13,1996-02-12,1996-03-22,DELIVER IN PERSON,TRUCK,some comment"
    df = delimited.read_lineitem(spark, lines(tmp_path, row + "\n"), header=False)
    assert df.columns == ["l_returnflag", "l_linestatus", "l_shipinstruct", "l_shipmode", "l_comment", "l_orderkey", "l_linenumber"]
    kv = delimited.as_key_value(df, df.columns[:5], df.columns[5:]).first()
    assert bytes(kv.key) == b"N\0O\0DELIVER IN PERSON\0TRUCK\0some comment" and bytes(kv.value) == b"\x80" + bytes(6) + b"\x01\0" + b"\x80\0\0\x04"
    taxi = ",".join(str(k) if f.dataType.simpleString() in ("int", "bigint", "double") else f"t{k}" for k, f in enumerate(schemas.YELLOW_TAXI))
    assert delimited.read_yellow_taxi(spark, lines(tmp_path, taxi + "\n", "x.csv"), header=False).first()[:] == ("t2", 0)
    assert delimited.estimate_mb(10, 100, 100 << 20) == pytest.approx(10)


def test_gensort(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randbytes(10), rng.randbytes(90)) for _ in range(1000)]
    path = tmp_path / "g.dat"
    path.write_bytes(b"".join(k + v for k, v in rows))
    df = binary.read_gensort(spark, str(path), 7)
    assert df.rdd.getNumPartitions() == 7
    assert sorted((bytes(r.key), bytes(r.value)) for r in df.collect()) == sorted(rows)
    out = with_position(df, SortSpec(("key",), None, ("value",), COUNT, 3)).orderBy("pos").collect()
    assert [bytes(r.key) for r in out] == sorted(k for k, _ in rows)
    path.write_bytes(b"x" * 150)
    with pytest.raises(ValueError, match="whole number"):
        binary.read_gensort(spark, str(path))
    (tmp_path / "empty.dat").write_bytes(b"")
    assert binary.read_gensort(spark, str(tmp_path / "empty.dat")).count() == 0
    with pytest.raises(ValueError):
        binary.read_gensort(spark, str(tmp_path / "none.dat"))


def record(k, v):
    return struct.pack("<I", len(k)) + k + struct.pack("<I", len(v)) + v


def test_kvbin_file_with_index(spark, tmp_path):
    rows = [(bytes([97 + i]), str(i + 1).encode()) for i in range(6)]
    data = [record(*r) for r in rows]
    path = tmp_path / "d.kvbin"
    path.write_bytes(b"".join(data))
    with pytest.raises(ValueError, match="no index"):
        binary.read_kvbin(spark, str(path))
    points = [sum(map(len, data[:i])) for i in (2, 4)]
    (tmp_path / "d.kvbin.idx").write_bytes(struct.pack("<2Q", *points))
    df = binary.read_kvbin(spark, str(path), 3)
    assert df.rdd.getNumPartitions() == 3 and sorted((bytes(r.key), bytes(r.value)) for r in df.collect()) == rows
    path.write_bytes(b"".join(data)[:-1])
    with pytest.raises(Exception, match="cut short"):
        binary.read_kvbin(spark, str(path)).collect()
    assert binary.read_kvbin(spark, str(path), truncated="ignore").count() == 5
    assert binary.kvbin_ranges([10, 20, 30], 40, 2) == [(0, 20), (20, 40)] and binary.kvbin_ranges([], 0, 4) == []


def test_kvbin_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.randrange(300))) for _ in range(3000)] + [(b"", b""), (b"big", b"x" * 300_000)]
    path = str(tmp_path / "out")
    binary.write_kvbin(binary.in_memory(spark, rows, 3), path, 10_000)
    back = binary.read_kvbin(spark, path, 16)
    assert back.rdd.getNumPartitions() > 8
    assert sorted((bytes(r.key), bytes(r.value)) for r in back.collect()) == sorted(rows)
    assert binary.kvbin_name("/x/lineitem.csv", [8, 9], [0, 3]) == "datasets/lineitem.k-8-9.v-0-3.kvbin"


def test_trips_of_two_vintages(spark):
    a = spark.createDataFrame([(1, "2011-05-01 00:00:00", "2.5")], "VendorID int, Tpep_Pickup_Datetime string, Trip_Distance string")
    b = spark.createDataFrame([("x", "2010-05-01 00:00:00", 1), ("2", "2020-01-01 10:00:00", 3)], "vendorid string, tpep_pickup_datetime string, extra_column int")
    out = delimited.normalise_trips([a, b]).orderBy("tpep_pickup_datetime").collect()
    assert len(out[0]) == 19 and [(r.vendorid, r.trip_distance) for r in out] == [(1, 2.5), (2, None)]


def test_stream_of_runs(spark, tmp_path):
    from rangeloom.streaming.runs import merged, write_runs

    src = str(tmp_path / "src")
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.col("id").alias("v"))
    df.repartition(3).write.parquet(src)
    spec = SortSpec(("k",), None, ("v",), COUNT, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    write_runs(stream, spec, str(tmp_path / "runs"), str(tmp_path / "ck")).awaitTermination(120)
    assert len(list((tmp_path / "runs").glob("run=*"))) == 3
    assert [r.k for r in merged(spark, str(tmp_path / "runs"), spec).toLocalIterator()] == list(range(500))


def test_a_second_write_leaves_the_first(spark, tmp_path):
    path = str(tmp_path / "twice")
    first, second = [(b"a", b"1"), (b"b", b"2")], [(b"c", b"3")]
    binary.write_kvbin(binary.in_memory(spark, first, 2), path)
    binary.write_kvbin(binary.in_memory(spark, second), path)
    assert sorted((bytes(r.key), bytes(r.value)) for r in binary.read_kvbin(spark, path).collect()) == first + second


def test_gensort_folder_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randbytes(10), rng.randbytes(90)) for _ in range(1000)]
    path = str(tmp_path / "records")
    for part in (rows[:700], rows[700:]):
        binary.write_gensort(binary.in_memory(spark, part, 3), path)
    back = binary.read_gensort(spark, path, 5)
    assert sorted((bytes(r.key), bytes(r.value)) for r in back.collect()) == sorted(rows)
    with pytest.raises(Exception, match="must have 10 bytes"):
        binary.write_gensort(binary.in_memory(spark, [(b"short", b"x" * 90)]), path)
    assert binary.read_gensort(spark, path).count() == 1000
