import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, seq string, sha256 string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "é text " * (i % 90) + "</p>", None, None, None) for i in range(600)]
    rows += [(None, None, None, None, None, None), (7, "a\r\nb", "", None, None, None), (600, "http://x/600", "Content-Length: 3\r\n\r\nx\r\n\r\n" * 3, None, None, None), (601, "big", "y" * 300_000, None, None, None)]
    rows += [(5, "http://x/5", rows[5][2], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, pages, path, **kw):
    rows = warc.records(pages)
    plan = warc.manifest(rows, shard_bytes=20_000)
    warc.write_warc(rows, path, plan._shards)
    return rows, plan


def test_archive_round_trip(spark, pages, tmp_path):
    rows, plan = stored(spark, pages, str(tmp_path / "a"))
    assert plan._shards > 10
    back = warc.read_warc(spark, str(tmp_path / "a")).collect()
    want = sorted((r.record + warc.END).encode() for r in rows.collect())
    assert sorted(bytes(r.record) for r in back) == want
    at = {(r.shard, r.offset, hashlib.sha256(bytes(r.record)).hexdigest()) for r in back}
    assert at == {(r.shard, r.offset, r.sha256) for r in plan.collect()}
    assert all(b.startswith(b"WARC/1.1\r\n") for b in want)


def test_clean_replicas_agree(spark, pages, tmp_path):
    _, plan = stored(spark, pages, str(tmp_path / "a"))
    assert warc.audit(plan, warc.stored_leaves(spark, str(tmp_path / "a"))).count() == 0


def test_damage_is_located(spark, pages, tmp_path):
    _, plan = stored(spark, pages, str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("shard=*/*.gz"))
    shard = int(files[3].parent.name[6:])
    data = bytearray(gzip.decompress(files[3].read_bytes()))
    leaves = sorted((r.offset, r.seq, r.length) for r in plan.where(F.col("shard") == shard).collect())
    at, seq, n = leaves[len(leaves) // 2]
    data[at + n - 6] ^= 1
    files[3].write_bytes(gzip.compress(bytes(data)))
    for crc in (tmp_path / "a").glob("shard=*/.*.crc"):
        crc.unlink()
    bad = warc.audit(plan, warc.stored_leaves(spark, str(tmp_path / "a"))).collect()
    assert [(r.shard, r.node, r.lo, r.hi) for r in bad] == [(shard, seq, at, at + n)]
    files[5].unlink()  # a whole shard is missing
    gone = int(files[5].parent.name[6:])
    cut = gzip.decompress(files[6].read_bytes())[:-200]  # and one is cut short
    files[6].write_bytes(gzip.compress(cut))
    bad = warc.audit(plan, warc.stored_leaves(spark, str(tmp_path / "a"))).collect()
    lost = {r.node for r in bad if r.shard == gone}
    assert lost == {r.seq for r in plan.where(F.col("shard") == gone).collect()} and all(r.stored_hash is None for r in bad if r.shard == gone)
    short = [r for r in bad if r.shard == int(files[6].parent.name[6:])]
    assert short and len(short) < len(leaves)
    files[7].write_bytes(files[7].read_bytes()[:-40])  # damage to the compressed stream
    assert {r.shard for r in warc.audit(plan, warc.stored_leaves(spark, str(tmp_path / "a"))).collect()} >= {int(files[7].parent.name[6:])}


def test_only_paths_to_damage_differ(spark, pages):
    plan = warc.manifest(warc.records(pages), shard_bytes=1 << 30)
    other = plan.withColumn("sha256", F.when(F.col("seq") == 300, F.lit("0" * 64)).otherwise(F.col("sha256")))
    a, b = warc.merkle_levels(plan, 3), warc.merkle_levels(other, 3)
    for k in range(4):
        diff = a[k].select("shard", "node", "hash").exceptAll(b[k].select("shard", "node", "hash")).collect()
        assert [r.node for r in diff] == [300 >> (4 * k)]
    assert a[3].count() == 1


def test_split_records_and_empty(spark, tmp_path):
    rec = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert warc.split_records(rec * 2) == [(0, len(rec)), (len(rec), len(rec))]
    assert warc.split_records(rec + b"junk") == [(0, len(rec)), (len(rec), 4)] and warc.split_records(b"") == []
    assert warc.split_records(rec[:-1]) == [(0, len(rec) - 1)]
    none = spark.createDataFrame([], SCHEMA)
    _, plan = stored(spark, none, str(tmp_path / "e"))
    assert plan.count() == 0
